"""Inputs that once gave wrong results or ended a build."""

import json
import random

import pytest
from pyspark.sql import functions as F

from shelfmark.config import load
from shelfmark.errors import BuildError, QueryError
from shelfmark.functions.coerce import canonical_json, coerce
from shelfmark.functions.text import composed
from shelfmark.functions.timestamps import normalize_timestamps
from shelfmark.operators.boosts import ValueBoost
from shelfmark.operators.compile import compile_site
from shelfmark.operators.filters import Field, Fields
from shelfmark.operators.index import build, open_index
from shelfmark.operators.marks import marks
from shelfmark.operators.profile import warnings
from shelfmark.operators.search import Request, Searcher
from shelfmark.operators.variants import term_variants
from shelfmark.sources.html import Source, parse_html, prune, select
from shelfmark.sources.records import checked_records
from shelfmark.sources.synthetic import dense_ids


def test_ids_are_dense_over_many_wide_rows(spark):
    wide = spark.range(200_000).select(F.sha2(F.col("id").cast("string"), 256).alias("url"), F.repeat(F.sha2(F.col("id").cast("string"), 512), 8).alias("wide"))
    got = dense_ids(wide, ["url"])
    row = got.agg(F.count("*").alias("n"), F.countDistinct("id").alias("d"), F.min("id").alias("a"), F.max("id").alias("b"), F.count("id").alias("held")).first()
    assert tuple(row) == (200_000, 200_000, 1, 200_000, 200_000)
    order = [r.url for r in got.where("id <= 500").select("id", "url").orderBy("id").collect()]
    assert order == sorted(order) and order[0] == wide.agg(F.min("url")).first()[0]
    assert dense_ids(wide.limit(0), ["url"]).count() == 0


@pytest.fixture(scope="module")
def titles(spark, tmp_path_factory):
    rng = random.Random(6)
    rows = [(i, f"T{rng.randrange(1000):03d} amber", "amber " * rng.randint(1, 5) + "stone " * rng.randint(0, 9), rng.choice(["en", "de", None])) for i in range(400)]
    return build(spark.createDataFrame(rows, "id long, title string, body string, lang string"), {"title": 10.0, "body": 1.0}, str(tmp_path_factory.mktemp("titles") / "k1"))


def test_pages_come_in_their_order(titles):
    searcher = Searcher(titles, Fields(lang=Field("facet")), (ValueBoost("lang", (("de", 9.0),)),))
    for request in (Request(sort="title", limit=50), Request(sort="title", descending=True, limit=50, offset=20), Request(sort="lang", limit=60), Request("amber", limit=50, typing=False), Request("amb", limit=30, offset=10), Request(limit=40, offset=5)):
        page = searcher.hits(request).collect()
        assert [r.place for r in page] == list(range(request.offset, request.offset + request.limit))
        joined = searcher.hits(request, ready=False).collect()
        assert [r.id for r in page] == [r.id for r in joined]
    rows = searcher.hits(Request(sort="title", limit=400)).collect()
    assert [(r.title, r.id) for r in rows] == sorted((r.title, r.id) for r in rows)
    best = searcher.hits(Request("amber", limit=400, typing=False)).collect()
    ranks = [r.score * (9.0 if r.lang == "de" else 1.0) for r in best]
    assert ranks == sorted(ranks)
    searcher.release()


def test_a_ranked_search_reads_its_postings_once(titles):
    searcher = Searcher(titles, Fields())
    plan = searcher.matches(searcher.plan("amber stone", typing=False))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("postings") == 1 and "lengths" not in plan
    plan = searcher.matches(searcher.plan('"amber stone" tit'))._jdf.queryExecution().executedPlan().toString()
    assert "InMemoryTableScan" in plan  # phrases are counted over rows that are kept
    searcher.release()


def test_only_the_pages_documents_are_read(titles):
    from shelfmark.operators.verify import pushed

    for limit in (3, 40):
        filters = " ".join(pushed(Searcher(titles, Fields()).hits(Request("amber", limit=limit, typing=False))))
        assert "EqualTo(id" in filters or limit == 3 and "In(id" in filters  # a long list is shown in part
    assert Searcher(titles, Fields()).hits(Request("amber", limit=1_000, typing=False)).count() == 400


def test_a_failed_build_leaves_the_former_index(spark, tmp_path):
    good = spark.createDataFrame([(1, "gold", "ring")], "id long, title string, body string")
    path = str(tmp_path / "ix")
    metrics: dict = {}
    build(good, {"title": 1.0, "body": 1.0}, path, metrics=metrics)
    assert metrics["documents"] == 1 and metrics["terms"] == 2 and "postings" in metrics["seconds"]
    bad = good.withColumn("body", F.raise_error(F.lit("no")).cast("string"))
    with pytest.raises(Exception):
        build(bad, {"title": 1.0, "body": 1.0}, path)
    assert open_index(spark, path).documents.first().title == "gold"
    build(good.withColumn("title", F.lit("kiln")), {"title": 1.0, "body": 1.0}, path)
    assert open_index(spark, path).documents.first().title == "kiln"


def test_long_stamps_are_read(spark):
    rows = [(1, " " * 250 + "2020-01-01"), (2, "2020-01-01" + "\t" * 100_000), (3, "Published: " + " " * 300 + "2020-01-01"), (4, "x" * 100_000), (5, "2020-01-01 " + "x" * 100_000), (6, "2020-01-01" + " " * 50_000 + "?"), (7, "\x1f" * 18), (8, "2020-01-01T10:00:00." + "9" * 5_000 + "Z")]
    got = {r.i: r.us for r in normalize_timestamps(spark.createDataFrame([(*r, "UTC", "dmy") for r in rows], "i int, v string, z string, o string"), "v", "z", "o", "us").collect()}
    day = 1577836800 * 10**6
    assert got == {1: day, 2: day, 3: day, 4: None, 5: None, 6: None, 7: None, 8: day + 10 * 3600 * 10**6 + 999_999}


def test_numbers(spark):
    cases = {"1d": None, "2f": None, "1e3": 1000.0, " +1.5 ": 1.5, ".5": 0.5, "5.": 5.0, "0x10": None, "": None, "1_000": 1000.0, "inf": float("inf")}
    rows = spark.createDataFrame([(k,) for k in cases], "v string").select("v", coerce(F.col("v"), "number").alias("x")).collect()
    assert {r.v: r.x for r in rows} == cases


def test_one_form_in_every_column(spark):
    two = "café"
    df = spark.createDataFrame([(1, two, [two, None], {"k": two}), (2, None, None, None), (3, "x", [], {})], "id long, s string, a array<string>, m map<string,string>")
    got = {r.id: (r.s, r.a, r.m) for r in composed(df, ["s", "a", "m"]).collect()}
    assert got == {1: ("café", ["café", None], {"k": "café"}), 2: (None, None, None), 3: ("x", [], {})}


def test_marks_count_utf16_units():
    assert marks("😀 gold", [(("gold",), False)]) == [(3, 4)]
    assert marks("gold 😀😀 gold", [(("gold",), False)]) == [(0, 4), (10, 4)]


def test_synonyms_of_words_that_no_document_holds(spark, titles):
    groups = {r.term: r.variants for r in term_variants(titles.vocabulary, [["amber", "elektron"]]).collect()}
    assert groups["elektron"] == ["amber"] and "elektron" in groups["amber"]
    titles.variants = term_variants(titles.vocabulary, [["amber", "elektron"]], generated=False)
    searcher = Searcher(titles, Fields())
    assert {r.band for r in searcher.matches(searcher.plan("elektron", typing=False)).collect()} == {1}
    titles.variants = None


def test_warnings_keep_the_least_few(spark):
    rows = [("a", None, i) for i in range(50)] + [("b", "x", 7), (None, None, 1)]
    df = spark.createDataFrame(rows, "code string, field string, at int").repartition(5)
    got = {(r.code, r.field): (r.n, r.paths) for r in warnings(df, ["code", "field"], F.col("at").cast("string"), F.col("at")).collect()}
    assert got == {("a", None): (50, ["0", "1", "2"]), ("b", "x"): (1, ["7"]), (None, None): (1, ["1"])}


PAGE = "<html><body><main id=m><p class='lead a'>one</p><p>two</p><section><p>three</p><em></em></section></main><aside data-k='x, y' lang='en-GB'><p>four</p><p>five <b>b</b></p></aside></body></html>"


@pytest.mark.parametrize("selector, texts", [
    ("main > p", ["one", "two"]), ("main p", ["one", "two", "three"]), ("p:not(.lead)", ["two", "three", "four", "five b"]), ("p:first-child", ["one", "three", "four"]), ("p:last-child", ["five b"]), ("p:nth-child(2)", ["two", "five b"]), ("p:nth-child(odd)", ["one", "three", "four"]),
    ("p + p", ["two", "five b"]), ("p ~ section p", ["three"]), ("[data-k='x, y'] p", ["four", "five b"]), ("p.lead, aside>p:nth-of-type(2)", ["one", "five b"]), ("aside:has(b) > p", ["four", "five b"]), ("em:empty", [""]), ("p:is(.lead, .a)", ["one"]), ("[lang|=en] b", ["b"]),
    ("body main > section > p", ["three"]), ("p:not(:nth-last-child(-n+1)):not(.a)", ["two", "three", "four"]), ("P.LEAD", []), ("aside[data-k*='X' i] b", ["b"]),
])
def test_selectors_with_combinators(selector, texts):
    assert [n.text() for n in select(parse_html(PAGE), selector)] == texts


@pytest.mark.parametrize("bad", ["", "p >", "> p", "p:unknown", "p:not(", "[a", "p,,b", ":nth-child(x)", "a)b", "p::before"])
def test_unreadable_selectors(bad):
    with pytest.raises(BuildError):
        select(parse_html(PAGE), bad)


def test_deep_pages_do_not_end_a_build():
    root = parse_html("<div>" * 5_000 + "deep<p>end")
    prune(root)
    assert Source.read("div p").values(root) == ["end"] and root.text() == "deep end"


GOOD = [{"id": 1, "url": "/a", "fields": {"title": "Gold"}, "facets": {"lang": "en", "tags": ["b", "a", "café", "café"], "year": 1900, "shown": True}, "store": {"extra": {"b": 1, "a": [2]}}}, {"id": "true", "url": " /b ", "fields": {"body": None}, "facets": {"tags": "[\"x\"]"}}]
BAD = [
    ({"id": 1.5, "url": "/x"}, "RECORD_INVALID"), ({"id": [1], "url": "/x"}, "RECORD_INVALID"), ({"id": "", "url": "/x"}, "RECORD_INVALID"), ({"id": None, "url": "/x"}, "RECORD_INVALID"), ({"id": False, "url": "/x"}, "RECORD_INVALID"), ({"id": 9}, "RECORD_INVALID"), ({"id": 9, "url": 5}, "RECORD_INVALID"),
    ({"id": 9, "url": "  "}, "RECORD_INVALID"), ({"id": 9, "url": "/x", "fields": {"title": 5}}, "RECORD_INVALID"), ({"id": 9, "url": "/x", "fields": {"body": {}}}, "RECORD_INVALID"), ({"id": 9, "url": "/x", "fields": []}, "RECORD_INVALID"), ({"id": 9, "url": "/x", "facets": {"tags": [1]}}, "RECORD_INVALID"),
    ({"id": 9, "url": "/x", "facets": {"tags": {"a": 1}}}, "RECORD_INVALID"), ({"id": 9, "url": "/x", "facets": {"lang": ["en"]}}, "RECORD_INVALID"), ({"id": 9, "url": "/x", "facets": {"lang": {"a": 1}}}, "RECORD_INVALID"), ({"id": 9, "url": "/x", "facets": {"year": "1d"}}, "FIELD_TYPE"),
    ({"id": 9, "url": "/x", "facets": {"other": 1}}, "RECORD_INVALID"), ([1], "RECORD_INVALID"), ("text", "RECORD_INVALID"),
]
RECORDS = {"input": "records", "facets": {"lang": {}, "tags": {"type": "string_array"}, "year": {"type": "integer"}, "shown": {"type": "boolean"}}, "store_fields": {"extra": {"type": "json"}}}


def test_records_are_checked_by_their_json_types(spark, tmp_path):
    config = load(RECORDS)
    lines = spark.createDataFrame([(json.dumps(r),) for r in [*GOOD, *(b for b, _ in BAD)]] + [("{broken",)], "raw string")
    declared = {"fields": ["title", "body"], "facets": ["lang", "tags", "year", "shown"], "store": ["extra"]}
    codes = [r.code for r in checked_records(lines, declared, config.fields).select("code").collect()]
    assert codes == [None, None, *(c for _, c in BAD), "RECORD_INVALID"]
    file = tmp_path / "r.jsonl"
    file.write_text("\n" + "\n\n".join(map(json.dumps, [GOOD[1], GOOD[0]])) + "\n")
    index = compile_site(spark, str(file), config, str(tmp_path / "ix"))
    docs = {r.record_id: r for r in index.documents.collect()}
    assert docs["true"].id == 1 and docs["1"].id == 2  # by line, not by address
    assert docs["1"].tags == ["a", "b", "café"] and docs["true"].tags == ['["x"]'] and docs["1"].year == 1900 and docs["1"].shown is True and docs["1"].extra == '{"b":1,"a":[2]}' and docs["true"].title == "/b"
    for bad, where in (({"id": 5, "url": 5}, ":3"), ({"id": "1", "url": "/z"}, ":3")):
        file.write_text(json.dumps(GOOD[0]) + "\n\n" + json.dumps(bad) + "\n")
        with pytest.raises(BuildError, match=where):
            compile_site(spark, str(file), config, str(tmp_path / "bad"))


def test_problems_that_do_not_end_a_build_are_reported(spark, tmp_path):
    (tmp_path / "site").mkdir()
    for n in range(5):
        (tmp_path / "site" / f"{n}.html").write_text(f"<html><body data-c='x'><i data-c='y'></i>page {n}</body></html>")
    config = load({"selectors": {"title": "h1"}, "facets": {"c": {"source": "[data-c]@data-c"}}, "variant_generation": False})
    metrics: dict = {}
    index = compile_site(spark, str(tmp_path / "site"), config, str(tmp_path / "ix"), metrics)
    assert metrics["warnings"] == [{"code": "FIELD_MULTIPLE_VALUES", "field": "c", "n": 5, "paths": ["0.html", "1.html", "2.html"]}, {"code": "SELECTOR_MISS", "field": "title", "n": 5, "paths": ["0.html", "1.html", "2.html"]}]
    assert index.variants.count() == 0


def test_batch_of_queries_as_single_queries(spark, titles):
    from shelfmark.operators.batch import ranked_pages

    asked = [(1, "amber"), (2, "stone amber"), (2, "stone amber"), (3, "  "), (4, None), (5, "zzz amber"), (6, "T001")]
    got = ranked_pages(titles, spark.createDataFrame(asked, "query_id long, q string"), "query_id", "q", limit=7, offset=2)
    pages = {}
    for r in got.orderBy("query_id", "place").collect():
        pages.setdefault(r.query_id, []).append((r.place, r.id, r.score))
    searcher = Searcher(titles, Fields())
    for key, text in ((1, "amber"), (2, "stone amber")):
        rows = sorted(((round(r.score, 9), r.id) for r in searcher.matches(searcher.plan(text, typing=False)).collect()))[2:9]
        assert [(i, pytest.approx(s)) for _, i, s in pages[key]] == [(i, s) for s, i in rows] and [p for p, _, _ in pages[key]] == list(range(2, 9))
    assert set(pages) <= {1, 2, 6}


def test_batch_shuffles_no_pairs_of_queries_and_documents(spark, tmp_path):
    from shelfmark.operators import batch

    docs = spark.createDataFrame([(i, f"t{i}", f"hall w{i % 7} " + "oak " * (i % 3)) for i in range(600)], "id long, title string, body string")
    index = build(docs, {"title": 10.0, "body": 1.0}, str(tmp_path / "ix"))
    asked = [(i, ("hall", f"hall w{i % 7}", "oak hall", f"w{i % 7} oak hall", "hall")[i % 5]) for i in range(200)]
    queries = spark.createDataFrame(asked, "query_id long, q string")
    store, none = spark._jsc.sc().statusStore(), spark._sc._gateway.new_array(spark._jvm.double, 0)
    stages = lambda: {s.stageId(): s.shuffleWriteRecords() for s in (lambda x: [x.apply(k) for k in range(x.size())])(store.stageList(None, False, False, none, None))}
    before = stages()
    size, batch.POSTINGS = batch.POSTINGS, 500  # several blocks of documents
    try:
        got = batch.ranked_pages(index, queries, "query_id", "q", limit=5).collect()
    finally:
        batch.POSTINGS = size
    spark._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    assert max(n for k, n in stages().items() if k not in before) <= 2_600  # postings of the asked words are 2,200 and ids, pairs 70,000
    pages = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.place)):
        pages.setdefault(r.query_id, []).append((r.id, pytest.approx(r.score)))
    searcher = Searcher(index, Fields())
    best = {text: sorted((round(r.score, 9), r.id) for r in searcher.matches(searcher.plan(text, typing=False)).collect())[:5] for text in {q for _, q in asked}}
    assert pages == {key: [(i, s) for s, i in best[text]] for key, text in asked}


def test_facets_without_a_value_are_named(spark, titles):
    from shelfmark.operators.facets import facet_counts

    rows = facet_counts(titles.documents.limit(0), Fields(lang=Field("facet")), ["lang"], named=True).collect()
    assert [(r.ord, r.facet, r.value, r.n) for r in rows] == [(0, "lang", None, 0)]


def test_written_tables_need_a_shared_folder_on_a_cluster(monkeypatch):
    from types import SimpleNamespace

    from shelfmark.plans import lineage

    def session(master):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: None))

    with pytest.raises(BuildError, match="NO_SHARED_DIR"):
        lineage.shared_dir(session("spark://host:7077"))
    assert lineage.shared_dir(session("local[2]")).startswith("file://")


def test_batches_are_compacted(spark, tmp_path):
    from shelfmark.operators.index import compact
    from shelfmark.streaming.append import follow

    path, columns, schema = str(tmp_path / "ix"), {"title": 10.0, "body": 1.0}, "id long, title string, body string"
    build(spark.createDataFrame([(10, "gold", "ring")], schema), columns, path)
    (tmp_path / "in").mkdir()

    def add(n):
        (tmp_path / "in" / f"{n}.json").write_text(json.dumps({"id": n, "title": "gold", "body": "gold kiln"}))
        follow(spark, str(tmp_path / "in"), schema, path, columns, str(tmp_path / "cp")).awaitTermination()

    def state(index):
        scores = Searcher(index, Fields())
        return sorted((r.id, round(r.score, 9)) for r in scores.matches(scores.plan("gold", typing=False)).collect()), {r.term: (r.doc, r.cnt) for r in index.vocabulary.collect()}

    add(1)
    add(2)
    before = state(open_index(spark, path))
    index = compact(spark, path)
    assert state(index) == before and index.size == (3, 8) and not list((tmp_path / "ix" / "postings").glob("batch=*"))
    add(3)
    assert {r.id for r in open_index(spark, path).documents.collect()} == {1, 2, 3, 10}


def test_percentiles_by_rank(spark):
    from shelfmark.operators.profile import nearest_rank

    rng = random.Random(4)
    values = [rng.randrange(40) for _ in range(997)]
    rows = spark.createDataFrame([(v,) for v in [*values, None, None]], "x int").repartition(7)
    want = {s: sorted(values)[max(1, -(-int(s * 1000) * 997 // 1000)) - 1] for s in (0.0, 0.25, 0.5, 0.95, 1.0)}
    assert {r.share: r.value for r in nearest_rank(rows, "x", list(want)).collect()} == want
    assert [(r.share, r.value) for r in nearest_rank(rows.limit(0), "x", [0.5]).collect()] == [(0.5, None)]


def test_facets_in_the_order_of_an_answer(titles):
    rows = Searcher(titles, Fields(lang=Field("facet"))).facets(Request("amber", facets=["lang"], typing=False)).collect()
    assert [(-r.n, r.value) for r in rows] == sorted((-r.n, r.value) for r in rows)


def test_manifest_holds_the_declaration(spark, tmp_path):
    file = tmp_path / "r.jsonl"
    file.write_text(json.dumps(GOOD[0]))
    config = load(RECORDS | {"synonyms": [["gold", "aurum"]]})
    compile_site(spark, str(file), config, str(tmp_path / "ix"))
    held = open_index(spark, str(tmp_path / "ix")).declared
    assert held["fields"]["year"] == {"role": "facet", "type": "integer", "required": False} and held["synonyms"] == [["gold", "aurum"]] and held["fingerprint"] == config.fingerprint


def test_json_in_one_form(spark):
    texts = ['{"b":1,"a":[2,"x"]}', '{ "b" : 1.50, "a" : [ ] }', '{"a":1e2}', '{"a":"\\u00e9"}', '{"a":"x y"}', "{broken", "", None, '{"a":1,"a":2}', "-0", "[1,2]", "5", '"x"']

    def one(t):
        try:
            return json.dumps(json.loads(t), ensure_ascii=False, separators=(",", ":")) if t is not None else None
        except ValueError:
            return None

    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", canonical_json(F.col("t")).alias("x")).collect()
    assert {r.i: r.x for r in rows} == {i: one(t) for i, t in enumerate(texts)}


def test_pages_of_asked_columns(titles):
    searcher = Searcher(titles, Fields())
    page = searcher.hits(Request("amber", limit=3, typing=False, columns=["title"]))
    assert page.columns == ["id", "title", "band", "proximity", "score", "place"] and page.count() == 3
    assert "body:string" not in page._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(QueryError):
        searcher.hits(Request(columns=["none"]))


def test_an_index_among_its_pages_and_files_left_out(spark, tmp_path):
    from shelfmark.sources.html import discovered, skipped

    for name in ("a.html", "b/c.html", "b/d.txt", "old/e.html"):
        (tmp_path / "site" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "site" / name).write_text("<title>x</title><body>gold")
    root = str(tmp_path / "site")
    assert {(r.path, r.reason) for r in skipped(spark, root, ["**/*.html"], ["old/**"]).collect()} == {("b/d.txt", "not included"), ("old/e.html", "excluded")}
    assert {r.path for r in discovered(spark, root, "/", ["**/*.html"], ["old/**"]).collect()} == {"a.html", "b/c.html"}
    with pytest.raises(BuildError, match="among its pages"):
        compile_site(spark, root, load({}), root + "/ix")
    metrics: dict = {}
    compile_site(spark, root, load({"allow_output_in_source": True, "result_fields": ["title"]}), root + "/ix", metrics)
    assert metrics["bytes"]["postings"] > 0 and {"documents", "lengths", "vocabulary", "manifest"} <= set(metrics["bytes"])
