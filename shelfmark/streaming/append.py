"""Documents as a stream: each batch of records is added to an index's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from shelfmark.functions.text import composed
from shelfmark.operators.index import found, lengths_of, postings_of, write_manifest


def follow(spark: SparkSession, source: str, schema: str, path: str, columns: list[str] | dict[str, float], checkpoint: str) -> StreamingQuery:
    """Reads JSON lines from a folder as they arrive and writes documents, postings and lengths.

    A batch goes to folders of its own number and replaces them, so that a batch
    that is repeated after a failure is not counted twice. Vocabulary counts
    follow from the postings when the index is opened. ``columns`` are those of
    the index; one that is not built yet takes them with their weights, 1 for a
    list.
    """
    names = list(columns)
    if not found(spark, f"{path}/manifest"):
        write_manifest(spark, path, dict(columns) if isinstance(columns, dict) else dict.fromkeys(names, 1.0))

    def add(batch: DataFrame, number: int) -> None:
        batch = composed(batch, names).persist()
        for name, part in (("documents", batch), ("postings", postings_of(batch, names)), ("lengths", lengths_of(batch, names))):
            part.write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")
        batch.unpersist()

    return spark.readStream.schema(schema).json(source).writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
