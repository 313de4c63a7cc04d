"""What the corpus operators share: the shared scratch folder, stashed tables, row keys."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliospark.functions.scratch import new_path, stash  # noqa: F401

#: A word is a maximal run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def discard(df: DataFrame) -> None:
    """Delete the files of a stashed table that nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once, however often and deep inside lambdas it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def id_bucket(col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; NULL for a NULL id."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % modulus


def bounded_labels(labels: DataFrame, label: str, modulus: int, held_out: int, max_rows: int) -> DataFrame:
    """At most max_rows labelled ids (id, y) outside the held-out fold, the first by a hash of the id.

    The bound makes the result safe to broadcast. Several labels of one id count as their maximum.
    """
    return (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (id_bucket("doc_id", modulus) != held_out))
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_rows)
    )


def labelled_texts(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """doc_id, y, text: one row for each id of a bounded sample, so as many rows at most, however often an id repeats. Of
    rows of one id that with the smallest hash of its text, found inside the tasks first."""
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    one = rows.groupBy("doc_id", "y").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t"))
    return one.select("doc_id", "y", "t.text")


def within(rows: DataFrame, size: str, most: int) -> DataFrame:
    """The rows, in the order of a hash of the id, whose sizes together reach at most `most`. rows: bounded in number, as
    only ids and sizes meet in one window."""
    order = W.orderBy(F.xxhash64("doc_id"), "doc_id")
    kept = rows.select("doc_id", F.sum(size).over(order).alias("_s")).where(F.col("_s") <= most).select("doc_id")
    return rows.join(F.broadcast(kept), "doc_id", "left_semi")


def is_held_out(modulus: int, held_out: int) -> Column:
    """A NULL id is in no fold: not held out (and never learned from)."""
    return F.coalesce(id_bucket("doc_id", modulus) == held_out, F.lit(False))
