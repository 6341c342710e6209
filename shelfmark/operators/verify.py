"""Checks, fingerprints and reports of a finished index."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.errors import BuildError
from shelfmark.operators import profile
from shelfmark.operators.filters import Fields
from shelfmark.operators.index import Index
from shelfmark.operators.search import Request, Searcher


def fingerprint(df: DataFrame) -> str:
    """A checksum of a table's rows that does not depend on their order or files; repeated rows count."""
    columns = sorted(df.columns)
    row = F.xxhash64(*[F.col(c).cast("string") if t.startswith(("map", "variant")) else F.col(c) for c, t in ((c, dict(df.dtypes)[c]) for c in columns)])
    got = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(row.cast("decimal(38,0)")), F.lit(0)).alias("s")).first()
    return f"{got.n:x}-{int(got.s) & ((1 << 64) - 1):016x}"


def index_fingerprint(index: Index) -> str:
    return "/".join(fingerprint(t) for t in (index.documents, index.postings, index.lengths))


def check_index(index: Index, fields: Fields) -> dict:
    """What a finished index must satisfy; the first thing that fails is an error.

    Ids are unique, postings belong to documents, vocabulary and lengths agree
    with the postings, a word of a document finds it, a filter finds the documents
    of its value, and a term is a filter of the scan.
    """
    searcher = Searcher(index, fields)
    total = index.documents.count()
    if index.documents.select("id").distinct().count() != total:
        raise BuildError("INDEX_IDS", "two documents have one id")
    if not index.postings.join(index.documents.select("id"), "id", "left_anti").isEmpty():
        raise BuildError("INDEX_ORPHANS", "a posting belongs to no document")
    tokens = index.lengths.agg(F.sum("n")).first()[0] or 0
    counted = index.vocabulary.agg(F.sum("cnt")).first()[0] or 0
    if index.positions and tokens != counted:
        raise BuildError("INDEX_COUNTS", f"lengths hold {tokens} terms, the vocabulary {counted}")
    smoke = index.vocabulary.where(F.col("term").rlike("^[a-z]{2,}$")).orderBy(F.desc("doc"), "term").limit(1).collect()
    if smoke:
        found = searcher.total(Request(smoke[0].term, typing=False)).first().total
        if found != smoke[0].doc:
            raise BuildError("INDEX_SMOKE", f"{smoke[0].term} is in {smoke[0].doc} documents, a search finds {found}")
        if not pushed(index.postings.where(F.col("term") == smoke[0].term)):
            raise BuildError("INDEX_PLAN", "a term is no filter of the scan of postings")
    for name, f in sorted(fields.items()):
        if f.role == "facet" and f.type == "string" and name in index.documents.columns:
            held = index.documents.where(F.col(name).isNotNull()).groupBy(name).count().orderBy(F.desc("count"), name).limit(1).collect()
            if held and searcher.total(Request(filters={name: held[0][0]})).first().total != held[0]["count"]:
                raise BuildError("INDEX_SMOKE", f"a filter on {name} finds other documents than hold {held[0][0]!r}")
            if held:
                break
    return {"documents": total, "terms": index.vocabulary.count(), "tokens": tokens}


def pushed(df: DataFrame) -> list[str]:
    """The filters that reach the scans of a plan."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [f for part in re.findall(r"PushedFilters: \[([^\]]*)\]", plan) for f in re.split(r", (?=[A-Z])", part) if f]


def variants_report(index: Index) -> str:
    """The groups of words as JSON, in order."""
    rows = [] if index.variants is None else index.variants.orderBy("term").toLocalIterator()
    terms = {r.term: list(r.variants) for r in rows}
    return json.dumps({"row_count": len(terms), "terms": terms}, ensure_ascii=False)


def payload_report(index: Index, columns: list[str]) -> DataFrame:
    """Sizes of stored columns and of the index by search column, in one table (part, field, size, values)."""
    stored = profile.payload(index.documents, columns).select(F.lit("stored").alias("part"), "field", F.col("bytes").alias("size"), F.col("distinct_values").alias("values"))
    names = F.array(*[F.lit(c) for c in index.columns])
    held = profile.index_columns(index.postings).select(F.lit("index").alias("part"), F.get(names, F.col("col")).alias("field"), F.col("occurrences").alias("size"), F.col("terms").alias("values"))
    return stored.unionByName(held)


def decoded(hits: DataFrame, field: str) -> DataFrame:
    """A page of hits with a stored JSON field as a value that can be asked by path."""
    return hits.withColumn(field, F.try_parse_json(field))


def human_bytes(size: int) -> str:
    for unit in ("B", "KiB", "MiB", "GiB", "TiB"):
        if size < 1024 or unit == "TiB":
            return f"{size} B" if unit == "B" else f"{size:.1f} {unit}"
        size /= 1024
    return ""


def human_seconds(seconds: float) -> str:
    return f"{seconds * 1000:.0f} ms" if seconds < 1 else f"{seconds:.1f} s" if seconds < 60 else f"{int(seconds // 60)} min {int(seconds % 60)} s"
