"""Search over a small corpus, against SQLite's own full-text index."""

import itertools
import sqlite3

import pytest

from shelfmark.errors import QueryError
from shelfmark.functions.stem import stem
from shelfmark.operators.boosts import ValueBoost
from shelfmark.operators.facets import facet_counts
from shelfmark.operators.filters import Field, Fields, Range
from shelfmark.operators.index import build
from shelfmark.operators.marks import marks
from shelfmark.operators.search import Request, Searcher
from shelfmark.operators.suggest import suggest
from shelfmark.operators.variants import term_variants
from shelfmark.plans.syntax import emit, parse

WORDS = "temple image stone gold kiln barque harbour café Ramses G7510 photograph photographs".split()
DOCS = [
    (i, f"{WORDS[i % 12]} {WORDS[(i * 5 + 1) % 12]}", " ".join(WORDS[(i * k + k * k) % 12] for k in range(1, 9 + i % 5)), ["en", "de", None][i % 3], 1900 + i, [["a", "b"], ["b"], None][i % 3])
    for i in range(40)
] + [(40, None, None, "en", None, []), (41, "", "", None, 2000, ["a", "a"])]
FIELDS = Fields(lang=Field("facet"), year=Field("facet", "integer"), tags=Field("facet", "string_array"), note=Field("store"))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "id long, title string, body string, lang string, year long, tags array<string>").cache()


@pytest.fixture(scope="module")
def index(spark, docs, tmp_path_factory):
    return build(docs, {"title": 10.0, "body": 1.0}, str(tmp_path_factory.mktemp("index") / "k1"), partitions=2)


@pytest.fixture(scope="module")
def lite():
    base = sqlite3.connect(":memory:")
    base.execute("create virtual table t using fts5(title, body, tokenize='unicode61 remove_diacritics 2')")
    base.executemany("insert into t(rowid, title, body) values (?, ?, ?)", [(d[0], d[1], d[2]) for d in DOCS])
    return base


QUERIES = ["temple", "temple imag", "temple image", '"temple image"', "temple OR kiln", "gold -stone", "title:gold", "near(temple gold, 3)", "near(stone kiln gold, 2)", "cafe", "G 7510", "photog", "(temple OR gold) harbour -kiln", "title:(gold OR kiln)", "kiln OR (gold temple)", 'stone "gold kiln"']


@pytest.mark.parametrize("text", QUERIES)
def test_matches_and_scores_as_sqlite(index, lite, text):
    searcher = Searcher(index, FIELDS)
    want = dict(lite.execute("select rowid, bm25(t, 10.0, 1.0) from t where t match ?", (emit(parse(text)),)).fetchall())
    plan = searcher.plan(text)
    plan.wide = plan.variant = plan.exact  # no corrections here
    got = {r.id: r.score for r in searcher.matches(plan).collect()}
    assert got.keys() == want.keys()
    for i in got:
        assert got[i] == pytest.approx(want[i], abs=1e-9)


def test_union_and_difference(index):
    ids = lambda q: {r.id for r in Searcher(index, FIELDS).found(Request(q, typing=False)).collect()}
    assert ids("temple OR kiln") == ids("temple") | ids("kiln")
    assert ids("temple -kiln") == ids("temple") - ids("kiln")


def test_pages_make_up_the_whole(index):
    searcher = Searcher(index, FIELDS)
    whole = [r.id for r in searcher.hits(Request("gold", limit=100)).orderBy("band", "proximity", "score", "id").collect()]
    parts = [[r.id for r in searcher.hits(Request("gold", limit=7, offset=o)).orderBy("band", "proximity", "score", "id").collect()] for o in range(0, len(whole) + 7, 7)]
    assert list(itertools.chain(*parts)) == whole and parts[-1] == []
    assert searcher.total(Request("gold")).first().total == len(whole)


def test_facets_skip_their_own_filter(index, docs):
    searcher = Searcher(index, FIELDS)
    counts = {(r.facet, r.value): r.n for r in searcher.facets(Request(filters={"lang": "en", "tags": ["a"]}, facets=["lang", "tags"])).collect()}
    rows = [d for d in DOCS]
    assert counts["lang", "en"] == sum(d[3] == "en" and "a" in (d[5] or []) for d in rows)
    assert ("lang", "de") not in counts or counts["lang", "de"] == sum(d[3] == "de" and "a" in (d[5] or []) for d in rows)
    assert counts["tags", "b"] == sum(d[3] == "en" and "b" in (d[5] or []) for d in rows)
    assert facet_counts(docs.limit(0), FIELDS, True).count() == 0


def test_an_answer_evaluates_its_matches_once(index):
    searcher = Searcher(index, FIELDS)
    request = Request("gold", {"lang": "en"}, facets=["lang"], typing=False)
    parts = searcher.answer(request)
    assert parts["total"].first().total == searcher.total(request).first().total
    assert {tuple(r) for r in parts["facets"].collect()} == {tuple(r) for r in searcher.facets(request).collect()}
    assert [r.id for r in parts["hits"].collect()] == [r.id for r in searcher.hits(request).collect()]
    for part in parts.values():
        assert "InMemoryTableScan" in part._jdf.queryExecution().executedPlan().toString()
    searcher.release()


def test_filters(index):
    ids = lambda f: {r.id for r in Searcher(index, FIELDS).found(Request(filters=f)).collect()}
    assert ids({"lang": []}) == set() and ids({"tags": []}) == set()
    assert ids({"lang": None}) == {d[0] for d in DOCS}
    assert ids({"year": Range(1905, 1910)}) == {5, 6, 7, 8, 9, 10}
    assert ids({"year": Range()}) == {d[0] for d in DOCS}
    for bad, message in (({"note": 1}, "store field"), ({"none": 1}, "Unknown")):
        with pytest.raises(QueryError, match=message):
            ids(bad)


def test_sorting_and_blank_queries(index):
    searcher = Searcher(index, FIELDS)
    first = searcher.hits(Request(sort="year", limit=1)).first()
    assert first.id == 40  # nulls come first
    assert searcher.hits(Request(limit=-1)).count() == 0
    assert searcher.total(Request("  ,.")).first().total == len(DOCS)
    with pytest.raises(QueryError):
        searcher.hits(Request(sort="tags2"))


def test_boosts_change_order_only(index):
    plain, lifted = Searcher(index, FIELDS), Searcher(index, FIELDS, (ValueBoost("lang", (("de", 50.0),)),))
    request = Request("gold", limit=100, typing=False)
    assert {r.id for r in plain.hits(request).collect()} == {r.id for r in lifted.hits(request).collect()}
    assert lifted.hits(Request("gold", limit=1, typing=False)).first().lang == "de"


def test_widening_bands(spark, index):
    index.variants = term_variants(index.vocabulary, [["Ramses", "gold"]], [])
    groups = {r.term: r.variants for r in index.variants.collect()}
    assert groups["photograph"] == ["photographs"] and groups["ramses"] == ["gold"]
    searcher = Searcher(index, FIELDS)
    bands = {r.band for r in searcher.matches(searcher.plan("ramses", typing=False)).collect()}
    assert bands == {0, 1}
    guess = searcher.plan("harbuor", typing=False)
    assert guess.corrections == {"harbuor": ["harbour"]} and {r.band for r in searcher.matches(guess).collect()} == {2}
    assert searcher.resolved(Request("harbuor", typing=False))["corrections"] == {"harbuor": ["harbour"]}
    index.variants = None


def test_suggestions(index):
    searcher = Searcher(index, FIELDS)
    assert [r.term for r in suggest(searcher, "photo").collect()] == ["photograph", "photographs"] or len(suggest(searcher, "photo").collect()) == 2
    assert suggest(searcher, "templ", "correction").first().term == "temple"
    assert suggest(searcher, " ").count() == 0 and suggest(searcher, "te", limit=0).count() == 0
    inside = {r.term: r.doc for r in suggest(searcher, "te", context="gold").collect()}
    assert inside["temple"] == searcher.total(Request("gold temple", typing=False)).first().total


def test_marks():
    assert marks("Café Notes on Ostraka", [(("cafe",), True)]) == [(0, 4)]
    assert marks("Photographs and photograph", [(("photog",), True)]) == [(0, 6), (16, 6)]
    assert marks("gold kiln gold", [(("gold", "kiln"), False), (("kiln",), False)]) == [(0, 9)]
    assert marks(None, [(("x",), False)]) == [] and marks("x", []) == []
    assert marks("café x", [(("cafe",), False)]) == [(0, 5)]


def test_stems_as_sqlite():
    base = sqlite3.connect(":memory:")
    base.execute("create virtual table t using fts5(x, tokenize='porter')")
    base.execute("create virtual table v using fts5vocab(t, 'row')")
    for word in "photographs ponies caresses relational hopping conflated happy sky hopefulness formalize adjustment controll roll statue status shining agreed oscillating".split():
        base.execute("delete from t")
        base.execute("insert into t values (?)", (word,))
        assert base.execute("select term from v").fetchone()[0] == stem(word)


def test_prefix_and_terms_reach_the_scan(index):
    searcher = Searcher(index, FIELDS)
    plan = searcher.matches(searcher.plan("gold tem"), ranked=False)._jdf.queryExecution().executedPlan().toString()
    assert "StartsWith" in plan or "startswith" in plan.lower()
    assert "PushedFilters" in plan
