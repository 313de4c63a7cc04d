"""Line dedup over levelled sorted runs of line hashes.

A run is a table (h1, h2, n), bucketed and sorted by the 128-bit hash of a line: n rows of documents hold that
line. All runs share one layout, so they meet bucket by bucket in merge joins, without a shuffle. Each new batch of
documents is counted, merge-anti-joined against the lines that the runs already know to be frequent, and adds the
counts of the rest as a run of level 0. `fanout` runs of one level are merged into one of the next, so that there
are few runs of geometrically growing size.

The texts are read twice: once to hash their lines into a stashed table, from which batches and positions are
fed, and once to leave the frequent lines out.

Defined results: NULL or empty text is one empty line; a key shorter than `min_chars` is never dropped; a
repeated row is a document of its own; a line that repeats inside one row counts once; NULL ids are kept.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm.common import discard, let, new_path, read, stash

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACE = " \t\n\x0b\x0c\r"
HASH = ["h1", "h2"]


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACE)), UPPER, LOWER)


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def hash_pair(key: Column) -> Column:
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2"))


def distinct_hashes(hashes: Column) -> Column:
    """The distinct entries but NULL of an array of hashes, by sorting: n log n for texts of many lines."""
    ranked = F.array_sort(F.filter(hashes, lambda h: h.isNotNull()))
    return let(ranked, lambda a: F.filter(a, lambda h, i: (i == 0) | (h != F.get(a, i - 1))))


@dataclass
class LineRuns:
    """The levelled runs. add() takes a batch of line hashes; frequent() gives the lines in at least min_docs rows.
    buckets: the layout of all runs, by default as many as shuffle partitions."""

    spark: SparkSession
    min_docs: int = 10
    fanout: int = 2
    buckets: int = 0
    levels: list[list[str]] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.buckets = self.buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions"))

    def merged(self, names: list[str]) -> DataFrame:
        """The runs as one, counts added up, by merge joins of equal buckets."""

        def merge(a: DataFrame, b: DataFrame) -> DataFrame:
            both = a.join(b.withColumnRenamed("n", "m").hint("merge"), HASH, "full_outer")
            return both.select(*HASH, (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n"))

        return reduce(merge, [self.spark.table(n) for n in names])

    def frequent(self) -> DataFrame:
        names = [n for level in self.levels for n in level]
        if not names:
            return self.spark.createDataFrame([], "h1 long, h2 long")
        return self.merged(names).where(F.col("n") >= self.min_docs).select(*HASH)

    def add(self, lines: DataFrame) -> None:
        """lines: (hashes), a row for each document. Leaves out what is known to be frequent, adds the rest as a run."""
        batch = lines.select(F.explode(distinct_hashes(F.col("hashes"))).alias("h")).groupBy("h.h1", "h.h2").agg(F.count("*").alias("n"))
        if any(self.levels):
            batch = batch.join(self.frequent().hint("merge"), HASH, "left_anti")
        self.put(0, batch)

    def put(self, level: int, rows: DataFrame) -> None:
        name = f"line_run_{uuid.uuid4().hex}"
        laid = rows.repartition(self.buckets, *HASH)
        laid.write.format("parquet").bucketBy(self.buckets, *HASH).sortBy(*HASH).option("path", new_path(self.spark, name)).saveAsTable(name)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) >= self.fanout:
            old, self.levels[level] = self.levels[level], []
            self.put(level + 1, self.merged(old))
            self.drop(old)

    def drop(self, names: list[str]) -> None:
        for name in names:
            discard(self.spark.table(name))
            self.spark.sql(f"DROP TABLE {name}")

    def close(self) -> None:
        self.drop([n for level in self.levels for n in level])
        self.levels = []


def row_key() -> Column:
    """The id and a hash of the text: equal rows share one result."""
    return F.struct(F.coalesce(F.col("doc.doc_id").cast("string"), F.lit("")).alias("id"), F.xxhash64(F.lit(2), "doc.text").alias("t"))


def hashed_lines(docs: DataFrame, batches: int, min_chars: int) -> DataFrame:
    """row, hashes (of each line; NULL for one too short to be dropped), batch."""
    keys = F.transform(lines_of(F.col("doc.text")), line_key)
    hashes = F.transform(keys, lambda k: F.when(F.length(k) >= min_chars, hash_pair(k)))
    return docs.select(row_key().alias("row"), hashes.alias("hashes"), F.pmod(F.xxhash64(row_key()), F.lit(batches)).cast("int").alias("batch"))


def kept_text() -> Column:
    """The text of a row of line_dedup() without its frequent lines: the slices between them, joined."""

    def kept(s: Column) -> Column:
        before = lambda k: F.when(k == 0, -1).otherwise(F.get(s["drop"], k - 1))
        after = lambda k: F.coalesce(F.get(s["drop"], k), F.size(s["lines"]))
        return F.flatten(F.transform(F.sequence(F.lit(0), F.size(s["drop"])), lambda k: F.slice(s["lines"], before(k) + 2, after(k) - before(k) - 1)))

    lines = let(F.struct(lines_of(F.col("doc.text")).alias("lines"), F.col("drop").alias("drop")), lambda s: F.array_join(kept(s), "\n"))
    return F.when(F.col("drop").isNull(), F.coalesce(F.col("doc.text"), F.lit(""))).otherwise(lines)


def line_dedup(docs: DataFrame, batches: int = 3, min_docs: int = 10, min_chars: int = 1, fanout: int = 2) -> DataFrame:
    """docs (doc_id, text, any others) -> doc (the whole row as a struct, so no name can clash) and drop (the
    positions of its frequent lines in order, NULL for none). Feeds the runs in batches; then only (row, position,
    hash) travels to the frequent lines, and the texts are shuffled once, to meet the positions of their row."""
    spark = docs.sparkSession
    whole = docs.select(F.struct(*docs.columns).alias("doc"))
    lines = stash(hashed_lines(whole, batches, min_chars), "line-hashes", by=["batch"])
    runs = LineRuns(spark, min_docs, fanout)
    for k in range(batches):
        runs.add(lines.where(F.col("batch") == k))
    frequent = stash(runs.frequent(), "frequent-lines")
    runs.close()
    at = lines.select("row", F.posexplode("hashes").alias("pos", "h")).where("h IS NOT NULL").select("row", "pos", "h.h1", "h.h2")
    drops = at.join(frequent, HASH, "left_semi").groupBy("row").agg(F.sort_array(F.collect_set("pos")).alias("drop"))
    keyed = whole.select("doc", row_key().alias("row"))
    return keyed.join(drops, "row", "left").drop("row")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select(
        "doc.doc_id",
        F.size(lines_of(F.col("doc.text"))).cast("long").alias("n_lines"),
        F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped"),
        F.sha2(kept_text().cast("binary"), 256).alias("kept_sha256"),
    )


SQL = r"""
WITH l AS (
  SELECT doc_id, generate_subscripts(s, 1) AS pos, unnest(s) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents)
), k AS (
  SELECT doc_id, pos, line,
         translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l
), f AS (
  SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10
)
SELECT k.doc_id, count(*)::BIGINT AS n_lines, count(f.key)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(k.line, chr(10) ORDER BY k.pos) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f ON k.key = f.key GROUP BY k.doc_id
"""
