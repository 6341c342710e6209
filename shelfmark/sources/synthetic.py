"""A synthetic corpus with known selectivities, made where it is read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.plans.lineage import written

ADJECTIVES = "Quiet Northern Crooked Tidal Borrowed Winter Mended Hollow Brass Salted".split()
NOUNS = "Lantern Orchard Ferry Compass Granary Loom Quarry Bridge Almanac Anchor".split()
COMMON = "river timber market rope window bread candle meadow signal copper".split()
RARE = "astrolabe sextant hurdygurdy theodolite caravel gnomon orrery spinnet armillary bathyscaphe chronometer dulcimer phaeton quadrant zoetrope".split()


def synthetic_corpus(spark: SparkSession, count: int, seed: int = 7) -> DataFrame:
    """(id, url, title, body, category, year, rating, featured, tags), the same for the same count and seed. Every document holds ``uid<i>``, ``grp<i % 1000>`` and ``cohort<i % 50>``."""
    pick = lambda words, *salt: F.element_at(F.array(*map(F.lit, words)), (F.pmod(F.xxhash64("id", F.lit(seed), *map(F.lit, salt)), F.lit(len(words))) + 1).cast("int"))
    chance = lambda *salt: F.pmod(F.xxhash64("id", F.lit(seed), *map(F.lit, salt)), F.lit(1_000_000)) / 1_000_000
    words = F.transform(
        F.sequence(F.lit(1), F.lit(60)),
        lambda k: F.when(
            F.pmod(F.xxhash64(F.col("id"), F.lit(seed), k, F.lit("kind")), F.lit(100)) < 85, F.element_at(F.array(*map(F.lit, COMMON)), (F.pmod(F.xxhash64(F.col("id"), F.lit(seed), k), F.lit(len(COMMON))) + 1).cast("int"))
        ).otherwise(F.element_at(F.array(*map(F.lit, RARE)), (F.pmod(F.xxhash64(F.col("id"), F.lit(seed), k), F.lit(len(RARE))) + 1).cast("int"))),
    )
    rows = spark.range(1, count + 1)
    i = F.col("id").cast("string")
    body = F.concat(F.array_join(words, " "), F.lit(". uid"), i, F.lit(" grp"), (F.col("id") % 1000).cast("string"), F.lit(" cohort"), (F.col("id") % 50).cast("string"), F.lit("."))
    return rows.select(
        "id", F.concat(F.lit("/page/"), i, F.lit("/")).alias("url"), F.concat_ws(" ", pick(ADJECTIVES, "a"), pick(NOUNS, "n"), i).alias("title"), body.alias("body"),
        F.when(chance("c") < 0.55, "object").when(chance("c") < 0.75, "site").when(chance("c") < 0.9, "media").when(chance("c") < 0.96, "publication").otherwise("constituent").alias("category"),
        (2024 - F.floor(125 * chance("y") * chance("y"))).cast("int").alias("year"), F.round(5 * chance("r"), 2).alias("rating"), (chance("f") < 0.2).alias("featured"),
        F.slice(F.array(F.lit("archive"), F.lit("burial"), F.lit("loan"), F.lit("survey")), F.lit(1), F.floor(4 * chance("t")).cast("int")).alias("tags"),
    )


def dense_ids(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` with ``id`` from 1 in the order of some columns, without bringing all rows to one task: ranges are sorted in parallel, then counted, then numbered.

    The ranges are written once and numbered as they were written, since two
    runs of a plan may draw them differently. Rows equal in ``order`` follow
    each other in any order.
    """
    spark = df.sparkSession
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    ranged = df.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    held = written(ranged.withColumns({"__part": F.spark_partition_id(), "__place": place}), "numbered")
    sizes = sorted(held.groupBy("__part").agg(F.count("*").alias("n")).collect())  # a row for each range
    before, starts = 0, []
    for part, n in sizes:
        starts.append((part, before))
        before += n
    offsets = F.broadcast(spark.createDataFrame(starts, "__part int, __before long"))  # as many rows as ranges
    return held.join(offsets, "__part").withColumn("id", F.col("__place") + F.col("__before") + 1).drop("__part", "__place", "__before")
