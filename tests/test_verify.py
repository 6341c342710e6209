import json

import pytest

from shelfmark.__main__ import main
from shelfmark.errors import BuildError
from shelfmark.operators.filters import Fields
from shelfmark.operators.index import build
from shelfmark.operators.profile import alike_columns, nearest_frequency, ngrams, payload, prefix_bound, warnings
from shelfmark.operators.verify import check_index, decoded, fingerprint, human_bytes, human_seconds, index_fingerprint, payload_report, pushed


def test_index_checks(spark, tmp_path):
    docs = spark.createDataFrame([(1, "Gold", "gold kiln"), (2, None, "gold"), (3, "", None)], "id long, title string, body string")
    index = build(docs, {"title": 10.0, "body": 1.0}, str(tmp_path / "ix"))
    assert check_index(index, Fields()) == {"documents": 3, "terms": 2, "tokens": 4}
    assert pushed(index.postings.where("term = 'gold'"))
    again = build(docs.repartition(3), {"title": 10.0, "body": 1.0}, str(tmp_path / "iy"), partitions=3)
    assert index_fingerprint(index) == index_fingerprint(again)
    assert fingerprint(docs) != fingerprint(docs.union(docs.limit(1)))
    assert {(r.part, r.field) for r in payload_report(index, ["title"]).collect()} == {("stored", "title"), ("index", "title"), ("index", "body")}
    index.documents = docs.union(docs)
    with pytest.raises(BuildError, match="INDEX_IDS"):
        check_index(index, Fields())


def test_profiles(spark):
    rows = spark.createDataFrame([("a", "a", 1), ("b", "b", 2), (None, None, 3), ("é", "x", 4)], "x string, y string, z int")
    assert [tuple(r) for r in alike_columns(rows, ["x", "y", "z"], 0.7).collect()] == [("x", "y", 3, 4)]
    sizes = {r.field: tuple(r)[1:] for r in payload(rows, ["x", "y"]).collect()}
    assert sizes == {"x": (4, 1.0, 3), "y": (3, 0.75, 3)}
    counts = spark.createDataFrame([("ab", 3), ("ac", 5), ("b", 9)], "term string, doc long")
    assert {r.prefix: r.bound for r in prefix_bound(counts, ["a", "ac", "z"]).collect()} == {"a": 8, "ac": 5}
    assert {(r.target, r.term) for r in nearest_frequency(counts, "term", "doc", [4, 100]).collect()} == {(4, "ab"), (100, "b")}
    texts = spark.createDataFrame([(1, "one two two one two"), (2, "one two"), (3, None), (4, "")], "id long, t string")
    assert {r.gram: r.df for r in ngrams(texts, "id", "t").collect()} == {"one two": 2, "two one": 1}
    events = spark.createDataFrame([("c", f"p{i}", i) for i in range(5)], "code string, path string, i int")
    from pyspark.sql import functions as F

    assert warnings(events, ["code"], F.col("path"), F.col("i")).first().paths == ["p0", "p1", "p2"]


def test_stored_json(spark):
    page = spark.createDataFrame([('{"k": [1, 2]}',), ("no",), (None,)], "props string")
    assert [r[0] for r in decoded(page, "props").selectExpr("try_variant_get(props, '$.k[1]', 'int')").collect()] == [2, None, None]


def test_human_forms():
    assert (human_bytes(10), human_bytes(2048), human_seconds(0.5), human_seconds(75)) == ("10 B", "2.0 KiB", "500 ms", "1 min 15 s")


def test_command_line(tmp_path, capsys):
    config = tmp_path / "c.json"
    config.write_text(json.dumps({"input": "records"}))
    assert main(["validate", str(config)]) == 0 and json.loads(capsys.readouterr().out)["ok"]
    config.write_text("{\"nope\": 1}")
    assert main(["validate", str(config)]) == 1
