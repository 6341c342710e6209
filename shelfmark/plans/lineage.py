"""Cutting lineage through tables in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from shelfmark.errors import BuildError

_own: str | None = None  # where no folder is named
_FOLDERS: dict[str, str] = {}  # of each application


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Where none is named, a local session takes a temporary one; on a cluster, whose executors could not read it, that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise BuildError("NO_SHARED_DIR", "set spark.checkpoint.dir to a folder that all executors share")
        global _own
        _own = _own or "file://" + tempfile.mkdtemp(prefix="shelfmark-")
        named = _own
    return named.rstrip("/")


def own_dir(spark: SparkSession) -> str:
    """A folder of this application within the shared one; it is removed when the driver's JVM ends."""
    at = spark.sparkContext.applicationId
    if at not in _FOLDERS:
        folder = f"{shared_dir(spark)}/shelfmark-{at}-{uuid.uuid4().hex[:8]}"
        place = spark._jvm.org.apache.hadoop.fs.Path(folder)
        files = place.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(place)  # only what exists can be marked
        files.deleteOnExit(place)
        _FOLDERS[at] = folder
    return _FOLDERS[at]


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` stored as a compressed table in the application's shared folder and read back.

    What has been read back depends on no executor, so a lost one costs a
    re-read and not the computation. Tables live as long as the application,
    since plans that read them may run at any later time.
    """
    path = f"{own_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
