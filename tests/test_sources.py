import json

import pytest

from shelfmark.config import load
from shelfmark.errors import BuildError
from shelfmark.functions.distance import edit_distance
from shelfmark.operators.compile import compile_site
from shelfmark.operators.filters import Fields
from shelfmark.operators.index import build, open_index
from shelfmark.operators.search import Request, Searcher
from shelfmark.sources.html import Source, discovered, parse_html, prune, select
from shelfmark.sources.synthetic import dense_ids, synthetic_corpus
from shelfmark.streaming.append import follow

PAGE = """<html data-category='{c}'><head><title>{t}</title><meta name="description" content="About {t}"><meta property='article:tag' content='{tags}'></head>
<body><main><h1>{t}</h1><p>{b}<p>Second<script>secret</script><div hidden>hidden</div><div style="display: none">gone</div></main></body></html>"""
RAW = {"base_url": "https://x.example", "selectors": {"title": "title", "body": "main"}, "facets": {"category": {"source": "data-category", "required": True}, "tags": {"source": "meta[property='article:tag']@content", "type": "string_array"}}, "synonyms": [["Khufu", "Cheops"]]}


@pytest.fixture()
def site(tmp_path):
    for path, title, body, tags in (("index.html", "Alpha Tombs", "A golden coffin and Khufu", "burial, ancient"), ("b/index.html", "Beta", "Cheops and photographs of a photograph", ""), ("c/page.html", "Gamma", "Nothing", "x")):
        (tmp_path / "site" / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "site" / path).write_text(PAGE.format(c="guide", t=title, b=body, tags=tags))
    return tmp_path


def test_pages_become_an_index(spark, site):
    config = load(RAW)
    index = compile_site(spark, str(site / "site"), config, str(site / "out"))
    rows = {r.url: r for r in index.documents.collect()}
    assert set(rows) == {"https://x.example/", "https://x.example/b/", "https://x.example/c/page.html"}
    assert rows["https://x.example/"].tags == ["ancient", "burial"] and rows["https://x.example/"].body == "Alpha Tombs A golden coffin and Khufu Second"
    searcher = Searcher(index, config.fields)
    urls = lambda q: {r.url for r in searcher.found(Request(q, typing=False)).collect()}
    assert urls("golden") == {"https://x.example/"} and urls("secret") == set() and urls("khufu") == {"https://x.example/", "https://x.example/b/"}


def test_declared_includes_alone_choose_the_pages(spark, site):
    for name in ("d.xhtml", "b/e.php", "F.HTML", "notes.txt"):
        (site / "site" / name).write_text(PAGE.format(c="guide", t=name, b="Amber", tags=""))
    urls = lambda *include: {r.url for r in discovered(spark, str(site / "site"), "https://x.example", list(include)).select("url").collect()}
    pages = {f"https://x.example/{p}" for p in ("", "b/", "c/page.html")}
    assert urls("**/*.html") == pages
    assert urls("**/*.html", "**/*.xhtml", "**/*.php", "**/*.HTML") == pages | {f"https://x.example/{p}" for p in ("d.xhtml", "b/e.php", "F.HTML")}
    assert len(urls("**/*")) == 7


def test_missing_required_field_is_an_error(spark, site):
    page = (site / "site" / "c" / "page.html")
    page.write_text(page.read_text().replace("data-category='guide'", ""))
    with pytest.raises(BuildError, match="FIELD_REQUIRED_MISSING"):
        compile_site(spark, str(site / "site"), load(RAW), str(site / "out"))


def test_records(spark, tmp_path):
    rows = [{"id": 1, "url": "/a", "fields": {"title": "Gold", "body": "one"}, "facets": {"lang": "en", "tags": ["b", "a", "a"]}}, {"id": "x", "url": "/b", "fields": {"body": "gold two"}, "facets": {"tags": "z"}}]
    file = tmp_path / "r.jsonl"
    file.write_text("\n".join(map(json.dumps, rows)) + "\n\n")
    config = load({"input": "records", "facets": {"lang": {}, "tags": {"type": "string_array"}}})
    index = compile_site(spark, str(file), config, str(tmp_path / "out"))
    docs = {r.record_id: r for r in index.documents.collect()}
    assert docs["1"].tags == ["a", "b"] and docs["x"].tags == ["z"] and docs["x"].title == "/b"
    assert Searcher(index, config.fields).total(Request("gold")).first().total == 2
    for bad, code in (({"id": 1, "url": "/c", "zzz": 1}, "RECORD_INVALID"), ({"id": 1, "url": "/c"}, "RECORD_DUPLICATE"), ({"id": True, "url": "/c"}, "RECORD_INVALID"), ({"id": 3, "url": "/c", "facets": {"other": 1}}, "RECORD_INVALID")):
        file.write_text("\n".join(map(json.dumps, [*rows, bad])))
        with pytest.raises(BuildError, match=code):
            compile_site(spark, str(file), config, str(tmp_path / "bad"))


@pytest.mark.parametrize("bad", [
    {"nope": 1}, {"input": "csv"}, {"weights": {"title": -1}}, {"weights": {"other": 1}}, {"facets": {"a b": {"source": "x"}}}, {"facets": {"a": {"source": "x", "type": "json"}}}, {"facets": {"a": {"source": "x", "kind": 1}}},
    {"search_fields": [{"name": "title", "source": "x"}]}, {"facets": {"a": {"source": "[["}}}, {"boosts": {"a": {"values": {"x": 2}}}}, {"facets": {"a": {"source": "x"}}, "boosts": {"a": {"recency": {}}}},
    {"facets": {"a": {"source": "x"}}, "composite_indices": [["a"]]}, {"synonyms": [["two words", "x"]]}, {"sort_fields": {"a": {}}}, {"result_fields": ["zzz"]},
])
def test_bad_declarations(bad):
    with pytest.raises(BuildError, match="CONFIG_INVALID"):
        load(bad)


def test_fingerprint_is_stable():
    assert load(RAW).fingerprint == load(dict(reversed(RAW.items()))).fingerprint != load(RAW | {"positions": False}).fingerprint


def test_selectors():
    root = parse_html("<div id=a class='x y'><p>one<p>two<br>three</div><ul><li>1<li>2</ul><a href='/q' rel>z</a>")
    assert [n.text() for n in select(root, "div.x p")] == ["one", "two three"] and len(select(root, "#a, li")) == 3
    assert Source.read("a[rel]@href").values(root) == ["/q"] and Source.read("data-k").attribute == "data-k"
    prune(root)


def test_numbers_and_corpus(spark):
    made = synthetic_corpus(spark, 300, seed=3)
    assert made.exceptAll(synthetic_corpus(spark, 300, seed=3)).count() == 0 and made.where("body LIKE '%uid7 %'").count() == 1
    rows = dense_ids(made.select("url"), ["url"]).collect()
    assert [r.url for r in sorted(rows, key=lambda r: r.id)] == sorted(r.url for r in rows) and {r.id for r in rows} == set(range(1, 301))


def test_distance():
    assert edit_distance("amendmnet", "amendment", 2) == 1 and edit_distance("ca", "abc", 3) == 3 and edit_distance("abc", "xyz", 2) == 3 and edit_distance("", "ab", 2) == 2


def test_stream_adds_documents(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for n in range(2):
        (tmp_path / "in" / f"{n}.json").write_text(json.dumps({"id": n, "title": "gold", "body": "gold kiln"}))
        follow(spark, str(tmp_path / "in"), "id long, title string, body string", str(tmp_path / "ix"), ["title", "body"], str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "ix" / "postings")).where("term = 'gold'").count() == 4


@pytest.mark.parametrize("built", [False, True])
def test_followed_index_is_opened_and_searched(spark, tmp_path, built):
    path, columns, schema = str(tmp_path / "ix"), {"title": 10.0, "body": 1.0}, "id long, title string, body string"
    if built:
        build(spark.createDataFrame([(10, "gold", "ring")], schema), columns, path)
    (tmp_path / "in").mkdir()
    for n, title in enumerate(("cafe\u0301 gold", "kiln")):
        (tmp_path / "in" / f"{n}.json").write_text(json.dumps({"id": n, "title": title, "body": "gold kiln"}))
        follow(spark, str(tmp_path / "in"), schema, path, columns, str(tmp_path / "cp")).awaitTermination()
    index = open_index(spark, path)
    assert index.columns == columns
    assert {r.term: (r.doc, r.cnt) for r in index.vocabulary.collect()} == {"cafe": (1, 1), "gold": (2 + built, 3 + built), "kiln": (2, 3)} | ({"ring": (1, 1)} if built else {})
    search = lambda text: {r.id for r in Searcher(index, Fields()).found(Request(text, typing=False)).collect()}
    assert search("café") == {0} and search("gold") == {0, 1} | ({10} if built else set()) and search("kiln") == {0, 1}
    assert {r.id for r in index.lengths.collect()} == {r.id for r in index.documents.collect()} == {0, 1} | ({10} if built else set())


def test_phrases_of_two_and_three_words(spark, tmp_path):
    import re
    from collections import Counter
    from itertools import product

    from shelfmark.operators.profile import STOP
    from shelfmark.queries import phrase_df

    rows = [(1, "Golden coffin", "of the golden coffin with amber, amber bead 2020"), (2, None, "Κόσμος λίθος κήπος και golden coffin bead"), (3, "x", None), (4, None, None), (5, "Coffin", "bead which bead golden bead coffin"), (6, "Cafe\u0301 noir", "一二三四 五六七八")]
    spark.createDataFrame(rows, "doc_id long, title string, body string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.gram: r.df for r in phrase_df(spark, str(tmp_path)).collect()}
    plain = {"café": "cafe", "κόσμος": "κόσμοσ", "λίθος": "λίθοσ", "κήπος": "κήποσ"}
    want = Counter()
    for _, title, body in rows:
        text = " ".join(x for x in (title, body) if x is not None).lower().replace("e\u0301", "é")
        words = [plain.get(w, w) for w in re.findall(r"[^\W_]+", text) if len(w) >= 4]
        runs = {tuple(words[i : i + n]) for n, i in product((2, 3), range(len(words))) if i + n <= len(words)}
        want.update(" ".join(r) for r in runs if len(set(r)) == len(r) and not set(r) & set(STOP))
    assert got == dict(want)
    assert got["golden coffin"] == 2 and got["amber bead 2020"] == 1 and got["κόσμοσ λίθοσ κήποσ"] == 1


def test_profiles_cover_every_column():
    import __spark_entry__ as entry
    from shelfmark.queries import PAGE_COLUMNS

    assert len(PAGE_COLUMNS) == 14
    for name in ("payload_all_columns", "high_cardinality_all_columns", "dup_all_columns"):
        assert name in entry.queries() and all(f"'{c}'" in entry.oracle_sql()[name] for c in PAGE_COLUMNS)
