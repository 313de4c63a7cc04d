"""The event log as a table: appended in numbered batches, laid out by day and kind, bucketed by portfolio.

A batch that is written again replaces its own rows and adds none: every batch has its own folders under each day and kind.
Readers name days and kinds and read those folders only; a portfolio's events lie in one bucket in their order, so running
aggregates over portfolios and their symbols start without a shuffle.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LAYOUT = ("event_date", "event_type", "batch")


def open_log(spark: SparkSession, name: str, path: str, like: DataFrame, buckets: int | None = None) -> None:
    """Names the table at a path of the shared storage, new or with what was written there before. like: has the columns; buckets: by
    default the number of shuffle partitions, and the same for one path always."""
    if not {"portfolio_id", "ts", "event_type"} <= set(like.columns) or {"event_date", "batch"} & set(like.columns):
        raise ValueError("a log has portfolio_id, ts and event_type, and no columns event_date and batch")
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in like.schema if f.name != "event_type")
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({columns}, event_date date, event_type string, batch bigint) USING parquet PARTITIONED BY ({', '.join(LAYOUT)}) "
        f"CLUSTERED BY (portfolio_id) SORTED BY (portfolio_id, ts) INTO {n} BUCKETS LOCATION '{path}'"
    )
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(folder)
    spark.sql(f"ALTER TABLE {name} RECOVER PARTITIONS")


def append_batch(events: DataFrame, name: str, batch: int) -> None:
    """Writes the events of a batch, or writes them again; fits foreachBatch. A row without ts is kept, under no day. One shuffle, by
    portfolio, gives each bucket one file in a folder."""
    spark = events.sparkSession
    table = spark.table(name)
    buckets = int(spark.sql(f"DESCRIBE EXTENDED {name}").where("col_name = 'Num Buckets'").first()["data_type"])
    rows = events.withColumns({"event_date": F.to_date("ts"), "batch": F.lit(batch).cast("long")})
    mode = "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(mode)
    spark.conf.set(mode, "dynamic")
    try:
        rows.select(*table.columns).repartition(buckets, "portfolio_id").write.insertInto(name, overwrite=True)
    finally:
        spark.conf.set(mode, before)


def read_log(spark: SparkSession, name: str, kinds: list[str] | None = None, first: dt.date | None = None, last: dt.date | None = None) -> DataFrame:
    """The events of some kinds and days, both ends included; all by default. Other folders are not read."""
    rows = spark.table(name)
    if kinds is not None:
        rows = rows.where(F.col("event_type").isin(*kinds))
    if first is not None:
        rows = rows.where(F.col("event_date") >= F.lit(first))
    if last is not None:
        rows = rows.where(F.col("event_date") <= F.lit(last))
    return rows.drop("event_date", "batch")
