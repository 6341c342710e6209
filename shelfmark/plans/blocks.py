"""Every block of one table with every block of another, without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.plans.lineage import written

ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def crossed(left: DataFrame, right: DataFrame, work, schema: str, name: str, on: Column | None = None) -> DataFrame:
    """The rows of ``work``, which gets each row of ``left`` with each of ``right``, one a batch; stored.

    Rows hold packed blocks and come from written tables: a block is read from
    its file for every block that it meets, so meeting takes no disk.
    """
    spark = left.sparkSession
    kept = spark.conf.get(ROWS)
    spark.conf.set(ROWS, "1")  # two blocks are large enough
    try:
        return written(left.hint("shuffle_replicate_nl").join(right, F.lit(True) if on is None else on).mapInArrow(work, schema), name)
    finally:
        spark.conf.set(ROWS, kept)
