"""The inverted index: postings, document lengths and vocabulary as tables."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.errors import BuildError
from shelfmark.functions.text import composed, tokens

VERSION = 2


@dataclass
class Index:
    """Tables of an index and what a planner must know of it.

    ``documents`` (id, stored columns), ``postings`` (term, id, col, positions,
    n: the document's length, lead: the document's first posting of the term),
    ``lengths`` (id, n), ``vocabulary`` (term, doc, cnt); ``columns`` are the
    search columns with their weights, in the order of their numbers; ``size``
    is the number of documents and of their terms, where it is known;
    ``declared`` what the declaration says of fields and boosts.
    """

    documents: DataFrame
    postings: DataFrame
    lengths: DataFrame
    vocabulary: DataFrame
    columns: dict[str, float]
    positions: bool = True
    variants: DataFrame | None = None
    size: tuple[int, int] | None = None
    declared: dict | None = None

    @property
    def spark(self) -> SparkSession:
        return self.documents.sparkSession

    def totals(self) -> tuple[int, int]:
        """Documents and terms: from the manifest, or counted once."""
        if self.size is None:
            got = self.lengths.agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()  # one row
            self.size = (got.docs, got.terms)
        return self.size


def runs_with_positions(words: Column) -> Column:
    """Each distinct (term, col) of an array of (term, col, at) with the list of its places, within the row: the array is sorted and cut into runs. ``lead`` marks the first run of a term."""
    pairs = F.array_sort(words)

    def cut(sorted_: Column) -> Column:
        differs = lambda i: (F.get(sorted_, i)["term"] != F.get(sorted_, i - 1)["term"]) | (F.get(sorted_, i)["col"] != F.get(sorted_, i - 1)["col"])
        starts = F.filter(F.sequence(F.lit(0), F.size(sorted_) - 1), lambda i: (i == 0) | differs(i))
        return F.element_at(F.transform(F.array(starts), lambda s: take(sorted_, s)), 1)

    def take(sorted_: Column, starts: Column) -> Column:
        end = lambda k: F.coalesce(F.get(starts, k + 1), F.size(sorted_))
        lead = lambda p: (p == 0) | (F.get(sorted_, p)["term"] != F.get(sorted_, p - 1)["term"])
        return F.transform(
            starts,
            lambda p, k: F.struct(F.get(sorted_, p)["term"].alias("term"), F.get(sorted_, p)["col"].alias("col"), F.transform(F.slice(sorted_, p + 1, end(k) - p), lambda x: x["at"]).alias("positions"), lead(p).alias("lead")),
        )

    return F.when(F.size(words) > 0, F.element_at(F.transform(F.array(pairs), cut), 1))


def words_of(docs: DataFrame, columns: list[str]) -> DataFrame:
    """(id, words, n): all terms of a document as (term, col, at), and how many they are."""
    placed = lambda k: lambda w, i: F.struct(w.alias("term"), F.lit(k).alias("col"), i.alias("at"))
    each = [F.transform(tokens(F.col(c)), placed(k)) for k, c in enumerate(columns)]
    none = F.array().cast("array<struct<term:string,col:int,at:int>>")
    return docs.select("id", F.concat(*[F.coalesce(e, none) for e in each]).alias("words")).withColumn("n", F.size("words").cast("long"))


def postings_from(words: DataFrame) -> DataFrame:
    return words.select("id", "n", F.explode(runs_with_positions(F.col("words"))).alias("p")).select("p.term", "id", "p.col", "p.positions", "n", "p.lead")


def postings_of(docs: DataFrame, columns: list[str]) -> DataFrame:
    """(term, id, col, positions, n, lead): one row for each term of each search column of each document. No shuffle: a document's postings are made where it is read."""
    return postings_from(words_of(docs, columns))


def lengths_of(docs: DataFrame, columns: list[str]) -> DataFrame:
    sizes = [F.coalesce(F.size(tokens(F.col(c))), F.lit(0)) for c in columns]
    return docs.select("id", sum(sizes[1:], sizes[0]).cast("long").alias("n"))


def vocabulary_of(postings: DataFrame) -> DataFrame:
    """(term, doc, cnt): documents and occurrences of each term, added up before anything is shuffled; documents count by the first posting that they have of a term."""
    return postings.groupBy("term").agg(F.count_if("lead").alias("doc"), F.sum(F.size("positions")).alias("cnt"))


def build(docs: DataFrame, columns: dict[str, float], path: str | None = None, positions: bool = True, variants: DataFrame | None = None, partitions: int | None = None, metrics: dict | None = None, finish: Callable[[DataFrame], dict[str, DataFrame]] | None = None, declared: dict | None = None) -> Index:
    """The index of ``docs`` (id, search columns, stored columns).

    With ``path`` the tables are written: documents in ranges of ids, so that a
    page of hits is read from few row groups, postings and vocabulary in ranges
    of terms, so that a term or prefix is. Else they are plans over ``docs``.
    Null texts hold no terms. Ids must be unique.

    Tables are made in a folder beside ``path`` and put in its place when the
    last of them, the manifest, is written: a build that fails leaves the former
    index as it was. ``metrics`` receives the seconds of each phase and counts;
    ``finish`` makes further tables of the index from its vocabulary, ``declared``
    is kept in the manifest.
    """
    names = list(columns)
    if path is None:
        docs = composed(docs, names)
        postings = postings_of(docs, names)
        if not positions:
            postings = postings.withColumn("positions", F.lit(None).cast("array<int>"))
        return Index(docs, postings, lengths_of(docs, names), vocabulary_of(postings_of(docs, names)), dict(columns), positions, variants)
    spark, took, start = docs.sparkSession, {}, time.perf_counter()

    def phase(name: str) -> None:
        nonlocal start
        took[name], start = round(time.perf_counter() - start, 3), time.perf_counter()

    at = f"{path.rstrip('/')}.building-{uuid.uuid4().hex[:8]}"
    ranges = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    # composed where they have been spread: the pass that finds the ranges need not do it
    composed(docs.repartitionByRange(ranges, "id").sortWithinPartitions("id"), names).write.parquet(f"{at}/documents")
    docs = spark.read.parquet(f"{at}/documents")
    phase("documents")
    words_of(docs, names).write.option("compression", "zstd").parquet(f"{at}/words")
    words = spark.read.parquet(f"{at}/words")
    words.select("id", "n").write.parquet(f"{at}/lengths")
    phase("words")
    # ranges are found by a pass of their own, which reads finished postings and makes none; the id splits terms that most documents hold
    postings_from(words).write.option("compression", "zstd").parquet(f"{at}/unordered")
    unordered = spark.read.parquet(f"{at}/unordered")
    unordered.repartitionByRange(ranges, "term", "id").sortWithinPartitions("term", "id", "col").write.parquet(f"{at}/postings")
    phase("postings")
    vocabulary_of(unordered).repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{at}/vocabulary")
    _remove(spark, f"{at}/unordered")
    _remove(spark, f"{at}/words")
    phase("vocabulary")
    more = {"variants": variants} if variants is not None else {}
    more |= finish(spark.read.parquet(f"{at}/vocabulary")) if finish else {}
    for name, table in more.items():
        table.write.parquet(f"{at}/{name}")
    phase("further tables")
    total = spark.read.parquet(f"{at}/lengths").agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()  # one row
    write_manifest(spark, at, columns, positions, "variants" in more, (total.docs, total.terms), declared)
    _replace(spark, at, path)
    phase("manifest")
    if metrics is not None:
        metrics |= {"seconds": took, "documents": total.docs, "terms": total.terms, "documents_per_second": round(total.docs / max(1e-9, sum(took.values())), 1), "bytes": sizes_of(spark, path)}
    return open_index(spark, path)


def write_manifest(spark: SparkSession, path: str, columns: dict[str, float], positions: bool = True, variants: bool = False, size: tuple[int, int] | None = None, declared: dict | None = None) -> None:
    text = json.dumps({"version": VERSION, "columns": list(columns.items()), "positions": positions, "variants": variants, "size": size, "declared": declared}, sort_keys=True)
    place, files = _place(spark, f"{path}/manifest/manifest.json")
    out = files.create(place, True)
    out.write(bytearray(text + "\n", "utf-8"))
    out.close()


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def found(spark: SparkSession, pattern: str) -> bool:
    place, files = _place(spark, pattern)
    return bool(files.globStatus(place))


def _remove(spark: SparkSession, path: str) -> None:
    place, files = _place(spark, path)
    files.delete(place, True)


def _replace(spark: SparkSession, made: str, path: str) -> None:
    """Puts a finished folder in the place of another, which is removed last."""
    new, files = _place(spark, made)
    place, _ = _place(spark, path)
    former, _ = _place(spark, f"{made}-former")
    files.mkdirs(place.getParent())
    had = files.exists(place)
    if had and not files.rename(place, former):
        raise BuildError("INDEX_WRITE", f"cannot move the former index at {path}")
    if not files.rename(new, place):
        raise BuildError("INDEX_WRITE", f"cannot put the new index at {path}")
    if had:
        files.delete(former, True)


def open_index(spark: SparkSession, path: str) -> Index:
    """A written index; one of another version is refused. Where batches were added, the vocabulary is counted from all postings."""
    manifest = json.loads(spark.read.text(f"{path}/manifest").first()[0])
    if manifest["version"] != VERSION:
        raise BuildError("INDEX_VERSION", f"the index has version {manifest['version']}, this library reads {VERSION}")
    added = found(spark, f"{path}/postings/batch=*")
    # files of the build and of batches lie in one folder, which Spark else takes for one of batches alone
    reader = lambda: spark.read.option("recursiveFileLookup", True).option("mergeSchema", True) if added else spark.read
    table = lambda name: reader().parquet(f"{path}/{name}")
    postings = table("postings")
    vocabulary = vocabulary_of(postings) if added else table("vocabulary")
    if not manifest["positions"]:
        postings = postings.withColumn("positions", F.lit(None).cast("array<int>"))
    size = tuple(manifest["size"]) if manifest.get("size") and not added else None
    return Index(table("documents"), postings, table("lengths"), vocabulary, dict(manifest["columns"]), manifest["positions"], spark.read.parquet(f"{path}/variants") if manifest["variants"] else None, size, manifest.get("declared"))


def compact(spark: SparkSession, path: str, partitions: int | None = None) -> Index:
    """Rewrites an index to which batches were added as one set of tables in ranges of ids and terms, with its vocabulary and size; not while batches arrive.

    The new tables replace the old ones when all are there, as in ``build``.
    """
    manifest = json.loads(spark.read.text(f"{path}/manifest").first()[0])
    index = open_index(spark, path)
    at = f"{path.rstrip('/')}.building-{uuid.uuid4().hex[:8]}"
    ranges = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    postings = spark.read.option("recursiveFileLookup", True).option("mergeSchema", True).parquet(f"{path}/postings")  # with positions, whether they are used or not
    index.documents.repartitionByRange(ranges, "id").sortWithinPartitions("id").write.parquet(f"{at}/documents")
    index.lengths.repartitionByRange(ranges, "id").write.parquet(f"{at}/lengths")
    postings.repartitionByRange(ranges, "term", "id").sortWithinPartitions("term", "id", "col").write.parquet(f"{at}/postings")
    vocabulary_of(spark.read.parquet(f"{at}/postings")).repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{at}/vocabulary")
    if index.variants is not None:
        index.variants.write.parquet(f"{at}/variants")
    total = spark.read.parquet(f"{at}/lengths").agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()  # one row
    write_manifest(spark, at, dict(manifest["columns"]), manifest["positions"], index.variants is not None, (total.docs, total.terms), manifest.get("declared"))
    _replace(spark, at, path)
    return open_index(spark, path)


def sizes_of(spark: SparkSession, path: str) -> dict[str, int]:
    """Bytes of each table of an index, on any file system."""
    place, files = _place(spark, path)
    return {status.getPath().getName(): files.getContentSummary(status.getPath()).getLength() for status in files.listStatus(place)}


def size_of(path: str) -> int:
    """Bytes of the files under a local path."""
    return sum(p.stat().st_size for p in Path(path).rglob("*") if p.is_file())
