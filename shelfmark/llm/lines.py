"""Lines repeated across the documents of one source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WHITE = r"[\s\p{Z}\x1c-\x1f\x85]+"


def line_form(line: Column) -> Column:
    """A line trimmed, with single plain spaces, in lower case, every run of digits as one zero."""
    return F.regexp_replace(F.lower(F.btrim(F.regexp_replace(line, WHITE, " "))), r"\p{Nd}+", "0")


def repeated_lines(docs: DataFrame, key: str, source: str, body: str, dates: DataFrame | None = None, min_docs: int = 5, min_share: float = 0.02, min_letters: int = 3, min_clusters: int = 1, min_dates: int = 1) -> DataFrame:
    """(source, form_id, n_docs, n_clusters, n_dates) of the lines repeated excessively within their source.

    Copies of a document (same source, same forms of all lines) fall into one
    cluster before lines are counted; ``n_clusters`` and ``n_dates`` count
    distinct clusters and distinct publication dates of them, so that an article
    published again can be told from boilerplate by ``min_clusters`` and
    ``min_dates``. ``n_docs`` counts all documents and decides with
    ``min_docs`` and ``min_share``, the share of the source's documents with a
    body. ``dates`` has (key, published_on); documents without one count as one
    date in ``n_dates``, but as a date each against ``min_dates``, so that
    missing dates hold no line back. Documents without source or body, and lines
    with fewer than ``min_letters`` letters, do not count.
    """
    lines = _lines(docs, key, source, body, min_letters)
    if dates is not None:
        lines = lines.join(dates.groupBy(F.col(key).alias("__key")).agg(F.min("published_on").alias("on")), "__key", "left")
    else:
        lines = lines.withColumn("on", F.lit(None).cast("date"))
    # a document's distinct lines; the cluster in the key spreads a line that a whole source repeats
    forms = lines.select("source", "cluster", "on", F.explode(F.array_distinct("forms")).alias("form_id")).where("form_id IS NOT NULL")
    clusters = forms.groupBy("source", "form_id", "cluster").agg(F.count("*").alias("n"), F.min("on").alias("on"))
    sums = [F.sum("n").alias("n_docs"), F.sum("c").alias("n_clusters"), F.count("*").alias("n_dates")]
    if dates is None:
        # one date for all, so there is nothing to tell apart
        days = clusters.withColumn("c", F.lit(1).cast("long"))
        sums[2] = F.lit(1).cast("long").alias("n_dates")
    else:
        days = clusters.groupBy("source", "form_id", "on").agg(F.sum("n").alias("n"), F.count("*").alias("c"))
    if min_dates > 1:
        sums.append((F.count("*") + F.sum(F.when(F.col("on").isNull(), F.col("c") - 1).otherwise(0))).alias("possible"))
    counts = days.groupBy("source", "form_id").agg(*sums)
    sizes = docs.where(F.col(body).isNotNull() & F.col(source).isNotNull()).groupBy(F.col(source).alias("source")).agg(F.count("*").alias("size"))
    kept = counts.where((F.col("n_docs") >= min_docs) & (F.col("n_clusters") >= min_clusters))
    if min_dates > 1:
        kept = kept.where(F.col("possible") >= min_dates).drop("possible")
    return kept.join(sizes, "source").where(F.col("n_docs") >= F.col("size") * min_share).drop("size")


def _lines(docs: DataFrame, key: str, source: str, body: str, min_letters: int) -> DataFrame:
    """A row for each document: source, the forms' ids, of 96 bits, in the order of its lines (null: too few letters), and the id of all forms together."""
    forms = F.transform(F.split(F.col(body), "\n"), line_form)
    held = docs.where(F.col(body).isNotNull() & F.col(source).isNotNull()).select(F.col(key).alias("__key"), F.col(source).alias("source"), forms.alias("texts"))
    ids = F.transform("texts", lambda t: F.when(t.rlike(r"(?:\p{L}\P{L}*){" + str(min_letters) + "}"), F.struct(F.xxhash64(t).alias("a"), F.hash(t).alias("b"))))
    return held.select("__key", "source", ids.alias("forms"), F.xxhash64("texts").alias("cluster"))


def excessive_lines(docs: DataFrame, key: str, source: str, body: str, **limits) -> DataFrame:
    """(key, line_no) of every line that is repeated excessively in its source; lines count from 1, blank ones too."""
    found = repeated_lines(docs, key, source, body, **limits).select("source", "form_id")
    lines = _lines(docs, key, source, body, limits.get("min_letters", 3)).select("__key", "source", F.posexplode("forms").alias("pos", "form_id")).where("form_id IS NOT NULL")
    # few lines are this common; by its size at run time the table is broadcast, or hot keys are split
    return lines.join(found, ["source", "form_id"], "left_semi").select(F.col("__key").alias(key), (F.col("pos") + 1).cast("long").alias("line_no"))


def without_lines(docs: DataFrame, key: str, body: str, found: DataFrame) -> DataFrame:
    """``docs`` with the lines (key, line_no) of ``found`` taken out of ``body``; a body of which nothing is left is empty, a null one stays null."""
    gone = found.groupBy(F.col(key).alias("__gone_key")).agg(F.collect_set("line_no").alias("__gone"))
    kept = F.array_join(F.filter(F.split(F.col(body), "\n"), lambda line, i: ~F.coalesce(F.array_contains("__gone", (i + 1).cast("long")), F.lit(False))), "\n")
    return docs.join(gone, F.col(key) == F.col("__gone_key"), "left").withColumn(body, F.when(F.col("__gone").isNull(), F.col(body)).otherwise(kept)).drop("__gone", "__gone_key")
