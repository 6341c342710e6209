"""Profiles of columns and of an index: sizes, distinct values, look-alike columns, warnings, n-grams."""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfmark.functions.text import tokens
from shelfmark.plans.lineage import written


def index_columns(postings: DataFrame) -> DataFrame:
    """(col, terms, postings, occurrences) of each search column."""
    return postings.groupBy("col").agg(F.countDistinct("term").alias("terms"), F.count("*").alias("postings"), F.sum(F.size("positions")).alias("occurrences"))


def payload(df: DataFrame, columns: list[str]) -> DataFrame:
    """(field, bytes, mean, distinct_values): UTF-8 size and variety of each column, in one pass over long form."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("v")) for c in columns])).alias("x")).select("x.*")
    # values meet by field and value first, so that the second count is small
    each = long.groupBy("field", "v").agg(F.count("*").alias("k"))
    size = F.sum(F.coalesce(F.octet_length("v"), F.lit(0)).cast("long") * F.col("k"))
    return each.groupBy("field").agg(size.alias("bytes"), (size / F.sum("k")).alias("mean"), F.count("v").alias("distinct_values"))


def high_cardinality(df: DataFrame, columns: list[str], limit: int = 1000) -> DataFrame:
    """(field, distinct_values) of columns with more than ``limit`` values."""
    return payload(df, columns).where(F.col("distinct_values") > limit).select("field", "distinct_values")


def alike_columns(df: DataFrame, columns: list[str], share: float = 0.9) -> DataFrame:
    """(a, b, same, rows): pairs of columns that are equal (nulls too) in at least ``share`` of the rows, and equal and not null in some. One scan for all pairs."""
    pairs = list(combinations(columns, 2))
    text = lambda c: F.col(c).cast("string")
    sums = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.count_if(text(a).eqNullSafe(text(b))).alias("same"), F.count_if(text(a) == text(b)).alias("held"), F.count("*").alias("rows")) for a, b in pairs]
    found = df.agg(F.array(*sums).alias("p")).select(F.explode("p").alias("x")).select("x.*")
    return found.where((F.col("same") >= F.col("rows") * share) & (F.col("held") > 0)).select("a", "b", "same", "rows")


def warnings(events: DataFrame, keys: list[str], path: Column, order: Column, samples: int = 3) -> DataFrame:
    """(keys, n, paths): warnings of a kind counted, with the first paths in order.

    Only the least few of a kind are kept, in each task before anything is
    shuffled, so a kind of any size takes no more room than another.
    """
    ranked = events.select(*keys, order.alias("ord"), path.alias("path"))
    least = ranked.withColumn("at", F.row_number().over(Window.partitionBy(*keys).orderBy("ord", "path"))).where(F.col("at") <= samples)
    counted = ranked.groupBy(*keys).agg(F.count("*").alias("n"))
    both = least.select(*keys, F.lit(0).cast("long").alias("n"), F.struct("at", "path").alias("x")).unionByName(counted.withColumn("x", F.lit(None).cast("struct<at:int,path:string>")))
    gathered = both.groupBy(*keys).agg(F.sum("n").alias("n"), F.array_sort(F.collect_list("x")).alias("x"))
    return gathered.select(*keys, "n", F.transform("x", lambda x: x["path"]).alias("paths"))


def ngrams(docs: DataFrame, key: str, text: str, size: int = 2, valid: str = r"^[a-z]{3,}$") -> DataFrame:
    """(gram, df): runs of ``size`` neighbouring valid words, all different, with the number of documents that hold them."""
    words = docs.select(F.col(key).alias("id"), tokens(F.col(text)).alias("w")).where(f"size(w) >= {size}")
    grams = F.transform(F.sequence(F.lit(0), F.size("w") - size), lambda i: F.slice("w", i + 1, F.lit(size)))
    fit = F.filter(grams, lambda g: (F.size(F.array_distinct(g)) == size) & F.forall(g, lambda x: x.rlike(valid)))
    each = words.select("id", F.explode(F.array_distinct(F.transform(fit, lambda g: F.array_join(g, " ")))).alias("gram"))
    return each.groupBy("gram").agg(F.count("*").alias("df"))


STOP = (
    "able about across after almost also among because been cannot could dear either else ever every from have however into just least like likely might most must neither often only other "
    "rather said says should since some than that their them then there these they this wants were what when where which while whom will with would your"
).split()


def phrases(docs: DataFrame, key: str, texts: list[str], sizes: tuple[int, ...] = (2, 3), least: int = 4, stop: list[str] = STOP) -> DataFrame:
    """(gram, df): runs of neighbouring words of each of ``sizes``, all different and none in ``stop``, with the number of documents that hold them.

    The texts of a document are read one after another. Words of fewer than
    ``least`` characters are passed over, so their neighbours meet; a word in
    ``stop`` parts its neighbours.
    """
    both = F.concat_ws(" ", *texts)
    words = docs.select(F.col(key).alias("id"), F.filter(tokens(both), lambda w: F.length(w) >= least).alias("w"))
    # a stop word becomes null, which no run may hold
    words = words.withColumn("w", F.transform("w", lambda w: F.when(~w.isin(stop), w)))

    def of(size: int) -> Column:
        starts = F.when(F.size("w") >= size, F.sequence(F.lit(1), F.size("w") - size + 1)).otherwise(F.array().cast("array<int>"))
        runs = F.transform(starts, lambda i: F.slice("w", i, F.lit(size)))
        return F.transform(F.filter(runs, lambda g: (F.size(F.array_distinct(g)) == size) & ~F.exists(g, lambda x: x.isNull())), lambda g: F.array_join(g, " "))

    each = words.select("id", F.explode(F.array_distinct(F.concat(*map(of, sizes)))).alias("gram"))
    return each.groupBy("gram").agg(F.count("*").alias("df"))


def prefix_bound(vocabulary: DataFrame, prefixes: list[str]) -> DataFrame:
    """(prefix, bound): the documents of all words with a prefix, added up."""
    matched = F.filter(F.array(*map(F.lit, prefixes)), lambda p: F.startswith(F.col("term"), p))
    return vocabulary.select(F.explode(matched).alias("prefix"), "doc").groupBy("prefix").agg(F.sum("doc").alias("bound"))


def nearest_frequency(counts: DataFrame, name: str, count: str, targets: list[int]) -> DataFrame:
    """(target, name, count): for each target the entry of the nearest count, ties by name."""
    rows = counts.select(name, count, F.explode(F.array(*[F.lit(t) for t in targets])).alias("target"))
    best = rows.groupBy("target").agg(F.min(F.struct(F.abs(F.col(count) - F.col("target")).alias("off"), F.col(name).alias("x"), F.col(count).alias("c"))).alias("b"))
    return best.select("target", F.col("b.x").alias(name), F.col("b.c").alias(count))


def nearest_rank(df: DataFrame, column: str, shares: list[float]) -> DataFrame:
    """(share, value): nearest-rank percentiles of the values that are not null; null where there are none.

    Equal values are counted together, the counts added up in ranges of values,
    and the ranges one after another, so no task sees more than a range.
    """
    spark = df.sparkSession
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    held = written(counts.repartitionByRange(ranges, "value").withColumn("part", F.spark_partition_id()), "ranges")
    before, starts = 0, []
    for part, n in sorted(held.groupBy("part").agg(F.sum("n")).collect()):  # a row for each range
        starts.append((part, before))
        before += n
    ranks = [(float(s), max(1, math.ceil(s * before - 1e-9))) for s in shares]
    upto = F.sum("n").over(Window.partitionBy("part").orderBy("value")) + F.col("before")
    placed = held.join(F.broadcast(spark.createDataFrame(starts, "part int, before long")), "part").withColumn("upto", upto)  # as many rows as ranges
    hit = F.filter(F.array(*[F.struct(F.lit(s).alias("share"), F.lit(r).alias("rank")) for s, r in ranks]), lambda x: (x["rank"] <= F.col("upto")) & (x["rank"] > F.col("upto") - F.col("n")))
    found = placed.select("value", F.explode(hit).alias("x")).select("x.share", "value")
    return spark.createDataFrame([(s,) for s, _ in ranks], "share double").join(found, "share", "left")
