"""Phrase collocations by SETM: occurrence relations, kept sorted, that grow by merge joins.

The relation of length k holds one row for each occurrence of a frequent phrase of k words: (row, at, g), with the row of the
table, the place of its first word, and the phrase. Places go up by one inside a piece and leave a gap between pieces, so
`(row, at)` names piece and position in one. Relations are tables bucketed and sorted by them. The next length is
1. a merge join of the relation with itself at adjacent places, bucket by bucket, without an exchange;
2. a count of the groups (first phrase, second phrase), aggregated before it is shuffled;
3. a join with the frequent groups only, which names them anew and is written as the next relation.
A phrase is frequent only if its first and last k - 1 words are, so no occurrence that matters is lost.

Words are counted first, as strings; an occurrence carries a 64-bit key of its language and word until it meets the
frequent words. Were two words of the table to share a key, the counts are made again under another seed, so results are exact.

Defined results: NULL text is empty, NULL lang is `und`; repeated rows are occurrences of their own; a word that
repeats makes overlapping phrases, all counted; a language without candidates has no rows. Other columns are not read.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliospark.llm.common import discard, new_path, read, stash

LONGEST, LEAST, TOP = 4, 30, 2000
#: Rows of a bucket of a relation, and of a table that may be broadcast.
BUCKET, SMALL = 1 << 21, 1_000_000
#: Words that a worker remembers, or counts before it sends them.
WORDS = 200_000
UPPER, LOWER = bytes(range(65, 91)), bytes(range(97, 123))
#: A-Z in lower case, ends of pieces as line feeds, tabs as spaces; UTF-8 keeps these bytes for these characters.
PLAIN = bytes.maketrans(UPPER + b".,;:!?\x0b\x0c\r\t", LOWER + b"\n" * 9 + b" ")


class Keys(dict):
    """word -> 64-bit key of the word in a language."""

    def __init__(self, lang: str, seed: int, bits: int):
        self.prefix, self.seed, self.drop = lang.encode() + b"\0", seed, 64 - bits

    def __missing__(self, word: bytes) -> int:
        if len(self) > WORDS:
            self.clear()
        h = xxhash.xxh3_64_intdigest(self.prefix + word, self.seed) >> self.drop
        self[word] = key = h - (h >> 63 << 64)
        return key


class Languages(dict):
    """lang -> Keys; emptied when it holds 64."""

    def __init__(self, seed: int, bits: int):
        self.seed, self.bits = seed, bits

    def __missing__(self, lang: str) -> Keys:
        if len(self) >= 64:
            self.clear()
        self[lang] = keys = Keys(lang, self.seed, self.bits)
        return keys


def texts_of(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))


def word_counts(docs: DataFrame, seed: int, bits: int) -> DataFrame:
    """lang, word, key, a: all words of all texts, added up in the tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}
        languages = Languages(seed, bits)

        def out() -> pa.RecordBatch:
            rows = [(g, w, languages[g][w], n) for g, c in counts.items() for w, n in c.items()]
            g, w, k, n = zip(*rows) if rows else ([], [], [], [])
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array(g, pa.string()), pa.array(w, pa.binary()).cast(pa.string()), pa.array(k, pa.int64()), pa.array(n, pa.int64())], ["lang", "word", "key", "a"])

        for b in batches:
            for g, t in zip(b.column(0).to_pylist(), b.column(1)):
                counts.setdefault(g, Counter()).update(t.as_py().encode().translate(PLAIN).split())
                if sum(map(len, counts.values())) > WORDS:
                    yield out()
        yield out()

    sent = texts_of(docs).mapInArrow(run, "lang string, word string, key long, a long")
    return sent.groupBy("lang", "word", "key").agg(F.sum("a").alias("a"))


def occurrences(docs: DataFrame, seed: int, bits: int, buckets: int) -> DataFrame:
    """row, at, key: every word of a piece of two words or more. The texts are dealt to buckets once, so that all rows
    that a task makes are of one bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages = Languages(seed, bits)
        for b in batches:
            rows, sizes, places, keys = [], [], [], []
            for k, (row, g, t) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2))):
                get, at, before = languages[g].__getitem__, 0, len(keys)
                for piece in t.as_py().encode().translate(PLAIN).split(b"\n"):
                    words = piece.split()
                    if len(words) > 1:
                        keys += map(get, words)
                        places += range(at, at + len(words))
                        at += len(words) + 1
                rows.append(row)
                sizes.append(len(keys) - before)
                if len(keys) > 1 << 20 or k + 1 == b.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(rows, np.int64), sizes)), pa.array(places, pa.int64()), pa.array(keys, pa.int64())], ["row", "at", "key"])
                    rows, sizes, places, keys = [], [], [], []

    dealt = texts_of(docs).withColumn("row", F.monotonically_increasing_id()).repartition(buckets, "row")
    return dealt.select("row", "lang", "text").mapInArrow(run, "row long, at long, key long")


@contextmanager
def merged_by_bucket(spark: SparkSession) -> Iterator[None]:
    """Joins on (row, at) may use tables bucketed by row alone, and the order they were written in."""
    wanted = {"spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.legacy.bucketedTableScan.outputOrdering": "true"}
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def keep(rows: DataFrame, buckets: int) -> str:
    """Writes an occurrence relation, bucketed by row and sorted by place; gives its name."""
    name = f"occurrences_{uuid.uuid4().hex}"
    writer = rows.write.format("parquet").option("compression", "zstd").bucketBy(buckets, "row").sortBy("row", "at")
    writer.option("path", new_path(rows.sparkSession, name)).saveAsTable(name)
    return name


def drop(spark: SparkSession, name: str) -> None:
    discard(spark.table(name))
    spark.sql(f"DROP TABLE {name}")


def is_small(table: DataFrame) -> bool:
    """May a table of numbers be broadcast? Counted, up to the limit."""
    return table.limit(SMALL + 1).count() <= SMALL


def adjacent(relation: DataFrame) -> DataFrame:
    """row, at, p, q: phrase q one place after phrase p."""
    first = relation.select("row", "at", F.col("g").alias("p"))
    second = relation.select("row", (F.col("at") - 1).alias("at"), F.col("g").alias("q"))
    return first.join(second.hint("merge"), ["row", "at"])


def numbered(table: DataFrame, name: str) -> DataFrame:
    """table with g, a number of each row, written so that it stays."""
    return stash(table.withColumn("g", F.monotonically_increasing_id()), name)


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """(lang, n), and lang, words (array), a of every phrase of 1 to `longest` words that occurs at least `least` times."""
    spark = docs.sparkSession
    for seed in range(1 << 16):
        counted = stash(word_counts(docs, seed, bits), "phrase-words")
        if not counted.groupBy("key").count().where("count > 1").limit(1).count():
            break
        discard(counted)
    sizes = stash(counted.groupBy("lang").agg(F.sum("a").alias("n")), "phrase-sizes")
    words = numbered(counted.where(F.col("a") >= least), "phrase-frequent")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET))
    known, small = words.select("key", "g"), is_small(words)
    placed = occurrences(docs, seed, bits, buckets).join(F.broadcast(known) if small else known, "key").select("row", "at", "g")
    relation = keep(placed if small else placed.repartition(buckets, "row"), buckets)
    found = words.select("lang", F.array("word").alias("words"), "a", "g")
    every = [found]
    for k in range(2, longest + 1):
        with merged_by_bucket(spark):
            pairs = adjacent(spark.table(relation))
            groups = numbered(pairs.groupBy("p", "q").agg(F.count("*").alias("a")).where(F.col("a") >= least), "phrase-groups")
            if k < longest:
                names, small = groups.drop("a"), is_small(groups)
                placed = adjacent(spark.table(relation)).join(F.broadcast(names) if small else names, ["p", "q"]).select("row", "at", "g")
                after = keep(placed if small else placed.repartition(buckets, "row"), buckets)
        drop(spark, relation)
        first, last = (found.select(F.col("g").alias(c), "lang", F.col("words").alias(f"_{c}")) for c in "pq")
        named = groups.join(first, "p").join(last.drop("lang"), "q")
        found = stash(named.select("lang", F.concat("_p", F.slice("_q", -1, 1)).alias("words"), "a", "g"), "phrases")
        every.append(found)
        relation = after if k < longest else ""
    out = every[0]
    for t in every[1:]:
        out = out.unionByName(t)
    return sizes, out.drop("g")


def phrase(words: Column) -> Column:
    return F.array_join(words, " ")


def scored(phrases: DataFrame) -> DataFrame:
    """Candidates (phrases of two words or more) by lang and words: a, and of the cut with the lowest score l, r and score.
    Quotients are of decimals, so no product is rounded or overflows."""
    counts = phrases.select("lang", phrase(F.col("words")).alias("part"), F.col("a").alias("f"))
    cuts = phrases.where(F.size("words") > 1).withColumn("k", F.explode(F.sequence(F.lit(1), F.size("words") - 1)))
    cuts = cuts.withColumns({"head": phrase(F.slice("words", F.lit(1), F.col("k"))), "tail": phrase(F.slice("words", F.col("k") + 1, F.size("words")))})
    cuts = cuts.join(counts.select("lang", F.col("part").alias("head"), F.col("f").alias("l")), ["lang", "head"])
    cuts = cuts.join(counts.select("lang", F.col("part").alias("tail"), F.col("f").alias("r")), ["lang", "tail"])
    score = F.expr("cast(cast(2000000 as decimal(7, 0)) * cast(a as decimal(20, 0)) div (cast(l as decimal(20, 0)) + cast(r as decimal(20, 0))) as long)")
    best = cuts.groupBy("lang", "words", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("best"))
    return best.select("lang", "words", phrase(F.col("words")).alias("phrase"), "a", "best.l", "best.r", "best.score")


def not_contained(candidates: DataFrame, share: int = 80) -> DataFrame:
    """Without those that a longer candidate contains, which occurs at least `share` % as often."""
    longer = candidates.where(F.size("words") > 2)
    size = F.size("words")
    inside = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda k: F.transform(F.sequence(F.lit(1), size - k + 1), lambda i: phrase(F.slice("words", i, k)))))
    parts = longer.select("lang", F.col("a").alias("f"), F.explode(inside).alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("f"))
    wide = "cast({} as decimal(20, 0))".format
    covered = F.expr(f"coalesce(100 * {wide('f')} >= {share} * {wide('a')}, false)")
    return candidates.join(parts, ["lang", "phrase"], "left").where(~covered).drop("f")


def top_collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, share: int = 80, bits: int = 64) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first `top` of each language. Ranked in 64 parts of a language first."""
    sizes, phrases = frequent_phrases(docs, least, longest, bits)
    left = not_contained(stash(scored(phrases), "phrase-scores"), share).withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    first = left.withColumn("rank", F.row_number().over(W.partitionBy("lang", "_part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_collocations(read(spark, sf_dir, "documents"))


SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM documents
), n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY lang),
o AS (
  SELECT lang, k, w[i:i+k-1] AS ws FROM p, LATERAL (SELECT unnest(generate_series(1, 4)) AS k), LATERAL (SELECT unnest(generate_series(1, len(w) - k + 1)) AS i)
), f AS (SELECT lang, k, ws, array_to_string(ws, ' ') AS phrase, count(*) AS a FROM o GROUP BY lang, k, ws HAVING count(*) >= 30),
c AS (SELECT * FROM f WHERE k > 1),
cut AS (SELECT c.*, j, array_to_string(ws[1:j], ' ') AS head, array_to_string(ws[j+1:k], ' ') AS tail FROM c, LATERAL (SELECT unnest(generate_series(1, k - 1)) AS j)),
s AS (
  SELECT cut.lang, cut.phrase, cut.a, x.a AS l, y.a AS r, (2000000::HUGEINT * cut.a // (x.a::HUGEINT + y.a))::BIGINT AS score, j
  FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = head JOIN f y ON y.lang = cut.lang AND y.phrase = tail
), best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inside AS (
  SELECT DISTINCT c.lang, array_to_string(ws[i:i+m-1], ' ') AS phrase, c.a AS f FROM c, LATERAL (SELECT unnest(generate_series(2, k - 1)) AS m), LATERAL (SELECT unnest(generate_series(1, k - m + 1)) AS i) WHERE k > 2
), kept AS (SELECT * FROM best WHERE NOT EXISTS (SELECT 1 FROM inside i WHERE i.lang = best.lang AND i.phrase = best.phrase AND 100::HUGEINT * i.f >= 80::HUGEINT * best.a)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""
