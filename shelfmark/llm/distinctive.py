"""How distinctive a term is of a record: smoothed positive pointwise mutual information."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.terms import counted, joined, terms
from shelfmark.plans.lineage import written


def distinctive_terms(docs: DataFrame, key: str, fields: list[str], alpha: float = 0.75, min_tf: int = 1, max_df: int | None = None, pattern: str | None = None) -> DataFrame:
    """(key, term, tf, df, ppmi): every term of every record with its score.

    With n(t,d) occurrences of term t in record d, n(t) of the term, n(d) of
    the record, the score is max(0, ln(n(t,d) Z / (n(t) n(d)^alpha))), where Z
    sums n(d)^alpha over all records: pointwise mutual information whose
    context counts are smoothed by the exponent ``alpha``. Each row is a record.
    ``min_tf``, ``max_df`` and ``pattern`` keep only some pairs of the result;
    the counts behind the scores always cover all terms of all records.
    Null and empty fields hold no terms; a record without terms has no rows.

    Counting within a record needs no shuffle. One shuffle carries a partial
    count per term, one brings the kept pairs and the counts together.
    """
    rows = docs.select(F.col(key).alias("__key"), F.sort_array(terms(joined(*fields))).alias("__words")).where("size(__words) > 0")
    pairs = rows.select("__key", F.size("__words").alias("n_d"), F.explode(counted(F.col("__words"))).alias("pair")).select("__key", "n_d", "pair.term", "pair.tf")
    # the empty term stands for the whole collection: its row holds the totals
    weighed = rows.select(
        F.pow(F.size("__words").cast("double"), F.lit(alpha)).alias("w"), F.size("__words").alias("n_d"), F.explode(F.concat(F.array(F.struct(F.lit("").alias("term"), F.lit(0).alias("tf"))), counted(F.col("__words")))).alias("pair")
    )
    stats = weighed.groupBy("pair.term").agg(F.count("*").alias("df"), F.sum("pair.tf").alias("n_t"), F.sum(F.when(F.col("pair.term") == "", F.col("w"))).alias("z"))
    if max_df is not None:
        stats = stats.where((F.col("df") <= max_df) | (F.col("term") == ""))
    stats = written(stats, "term-counts")
    total = stats.where("term = ''").select("z").first()  # one row
    z = total.z if total else 1.0
    if min_tf > 1:
        pairs = pairs.where(F.col("tf") >= min_tf)
    if pattern is not None:
        pairs = pairs.where(F.col("term").rlike(pattern))
    scored = pairs.join(stats.where("term <> ''").select("term", "df", "n_t"), "term")
    ppmi = F.greatest(F.lit(0.0), F.log(F.col("tf") * F.lit(z) / (F.col("n_t") * F.pow(F.col("n_d").cast("double"), F.lit(alpha)))))
    return scored.select(F.col("__key").alias(key), "term", F.col("tf").cast("long").alias("tf"), "df", ppmi.alias("ppmi"))
