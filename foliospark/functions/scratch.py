"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir. Only where a session has none (tests, a
    laptop) is a temporary one made and set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if found:
        if not sc._jsc.sc().getCheckpointDir().isDefined():
            sc.setCheckpointDir(found)
        return found.rstrip("/")
    set_before = sc._jsc.sc().getCheckpointDir()
    if set_before.isDefined():
        return set_before.get().rstrip("/")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stash(df: DataFrame, name: str, codec: str = "zstd", by: list[str] | None = None) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: cuts the lineage and survives the loss
    of executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write.option("compression", codec)
    (writer.partitionBy(*by) if by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
