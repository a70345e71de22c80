"""The folder that driver and executors share, and tables in it that cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; a local folder only where none is set and all run on this machine."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not getattr(spark, "_own_shared_dir", None):
            spark._own_shared_dir = "file://" + tempfile.mkdtemp(prefix="namewright-")
        d = spark._own_shared_dir
    return d.rstrip("/")


def stored(df: DataFrame, what: str, scratch: list[str] | None = None) -> DataFrame:
    """Writes df as a table in the shared folder, once, and reads it again. Its path is added to scratch, for callers that drop it when nothing reads it any more."""
    path = f"{shared_dir(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if scratch is not None:
        scratch.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, scratch: list[str]) -> None:
    """Deletes such tables."""
    while scratch:
        p = spark._jvm.org.apache.hadoop.fs.Path(scratch.pop())
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
