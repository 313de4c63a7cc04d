"""Mixing sources to target weights by Sainte-Lague apportionment; DataFrame functions only.

Water-filling gives each source a target of at most `max_repeat` times its size. Blocks of equal size
are apportioned to sources, and inside a source to its shards, by highest Sainte-Lague quotients. Their size is a
`FINE`-th of the smallest target, of 1 to `block` words, so that a seat more or less is little to any source. A shard
then takes whole passes over its documents and, for the rest of its quota, blocks of its word stream that a
seeded permutation picks, each a `FINE`-th of its source's target or `block` words.

A source so gets its target but for 2 % or one word. Defined results: NULL or blank text has size 0 and takes 0; a NULL source is a source of its own, the last;
equal rows are interchangeable; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliospark.llm.common import WORD, read, stash


#: Blocks that a target is divided into at least, where words allow.
FINE = 128


def seeded(seed: int, *cols: Column) -> Column:
    """A seeded hash as hexadecimal text; md5, so that any SQL engine can follow it. NULL hashes as ''."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("")) for c in cols]).cast("binary"))


def seeded_long(seed: int, *cols: Column) -> Column:
    return F.conv(F.substring(seeded(seed, *cols), 1, 8), 16, 10).cast("long")


def water_fill(sources: DataFrame, max_repeat: int = 3) -> DataFrame:
    """(source, source_size, ...) -> target. One row per source: the windows hold no documents.

    Sources in the order of cap per weight: those up to the first whose cap the common level does not
    reach are capped, the others get level times weight.
    """
    ordered = sources.withColumn("_i", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    ordered = ordered.withColumn("_w", (1 + F.col("_i") % 3).cast("double")).withColumn("_cap", max_repeat * F.col("source_size").cast("double"))
    by_cap = W.orderBy(F.col("_cap") / F.col("_w"), "_i")
    before, after = by_cap.rowsBetween(W.unboundedPreceding, -1), by_cap.rowsBetween(0, W.unboundedFollowing)
    whole = W.partitionBy(F.lit(0))
    total = F.sum(F.col("source_size").cast("double")).over(whole)
    level = (total - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(after)
    free = F.col("_cap") >= F.col("_level") * F.col("_w")
    levelled = ordered.withColumn("_level", level)
    common = F.min(F.when(free, F.struct(F.col("_cap") / F.col("_w"), "_i", "_level"))).over(whole)
    return (
        levelled.withColumn("_common", common["_level"])
        .withColumn("target", F.coalesce(F.least("_cap", F.col("_common") * F.col("_w")), F.col("_cap")))
        .drop("_i", "_w", "_cap", "_level", "_common")
    )


def sainte_lague(parties: DataFrame, votes: str, seats: Column, within: list[str], tie: str) -> DataFrame:
    """Adds `quota`: `seats` seats among the rows of each group, by highest votes / (2k - 1).

    Rounded shares miss the total by at most half a seat per party, so that only quotients next to a
    party's share can decide: a party lists those, not all its seats. Ties go by `tie`.
    """
    group = W.partitionBy(*within) if within else W.partitionBy(F.lit(0))
    shared = (
        parties.withColumn("_seats", seats)
        .withColumn("_n", F.count("*").over(group))
        .withColumn("_all", F.sum(votes).over(group))
        .withColumn("_share", F.when(F.col("_all") > 0, F.col("_seats") * F.col(votes) / F.col("_all")).otherwise(0.0))
    )
    reach = F.ceil(F.when(F.col("_seats") > 0, F.col("_share") * F.col("_n") / (2 * F.col("_seats"))).otherwise(0)) + 2
    based = shared.withColumn("_base", F.greatest(F.lit(0), F.round("_share") - reach).cast("long")).withColumn("_top", (F.round("_share") + reach).cast("long"))
    open_seats = based.withColumn("_open", F.col("_seats") - F.sum("_base").over(group))
    quotients = open_seats.withColumn("_k", F.explode(F.sequence(F.col("_base") + 1, F.col("_top") + 1)))
    ranked = quotients.withColumn("_rank", F.row_number().over(group.orderBy(F.desc(F.col(votes) / (2 * F.col("_k") - 1)), tie, "_k")))
    won = F.sum(F.when((F.col("_rank") <= F.col("_open")) & (F.col(votes) > 0), 1).otherwise(0))
    keys = [c for c in parties.columns]
    return ranked.groupBy(*keys, "_base").agg(won.alias("_won")).withColumn("quota", F.col("_base") + F.col("_won")).drop("_base", "_won")


def mix(docs: DataFrame, block: int = 128, shard_words: int = 1 << 21, shard_rows: int = 1 << 17, max_repeat: int = 3, seed: int = 17) -> DataFrame:
    """(doc_id, text, source) -> one row per document: doc_id, source, size, source_size, target, taken,
    and what realises it: passes (whole copies) and the block range and rule of the partial pass."""
    sized = stash(
        docs.select(
            "doc_id", "source",
            F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            F.xxhash64(F.lit(seed), "text").alias("_t"),
            seeded(seed, F.col("doc_id")).alias("_order"),
        ),
        "mix-sizes",
    )
    whole = W.partitionBy(F.lit(0))
    grain = lambda target: F.greatest(F.lit(1), F.least(F.lit(block), F.floor(target / FINE))).cast("long")
    filled = water_fill(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_rows")), max_repeat)
    smallest = F.min(F.when(F.col("target") > 0, F.col("target"))).over(whole)
    sources = stash(filled.withColumns({"_unit": grain(smallest), "block": grain(F.col("target"))}), "mix-sources")
    # a large source is dealt to shards by its words and rows, so that no window holds a whole source
    s = sources.withColumnRenamed("source", "_s").withColumn("_shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words), F.ceil(F.col("_rows") / shard_rows))).drop("_rows")
    placed = sized.join(F.broadcast(s) if _few(sources) else s, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    placed = placed.withColumn("shard", seeded_long(seed + 1, F.col("doc_id")) % F.col("_shards")).drop("_shards")
    shards = placed.groupBy("source", "shard").agg(F.sum("size").alias("shard_size"))
    blocks = F.round(F.sum("target").over(whole) / F.col("_unit")).cast("long")
    source_quota = sainte_lague(sources.drop("_rows", "block"), "target", blocks, [], "source").select(F.col("source").alias("_s"), F.col("quota").alias("_q"))
    quotas = sainte_lague(
        shards.join(source_quota, F.col("source").eqNullSafe(F.col("_s"))).drop("_s"), "shard_size", F.col("_q"), ["source"], "shard"
    ).select(F.col("source").alias("_s"), F.col("shard").alias("_h"), "shard_size", "quota")
    quotas = stash(quotas, "mix-quotas")
    stream = W.partitionBy("source", "shard").orderBy("_order", "doc_id", "size", "_t").rowsBetween(W.unboundedPreceding, -1)
    laid = placed.withColumn("_from", F.coalesce(F.sum("size").over(stream), F.lit(0)))
    laid = laid.join(quotas, F.col("source").eqNullSafe(F.col("_s")) & (F.col("shard") == F.col("_h"))).drop("_s", "_h")
    block, words = F.col("block"), F.col("quota") * F.col("_unit")
    passes = F.least(F.lit(max_repeat), F.floor(words / F.greatest(F.col("shard_size"), F.lit(1)))).cast("long")
    laid = laid.withColumn("n_blocks", F.ceil(F.col("shard_size") / block).cast("long")).withColumn("passes", passes)
    left = F.least(F.col("n_blocks"), F.round((words - F.col("passes") * F.col("shard_size")) / block).cast("long"))
    laid = laid.withColumn("picked", F.when(F.col("passes") >= max_repeat, 0).otherwise(F.greatest(F.lit(0), left)))
    first, last = F.floor(F.col("_from") / block), F.floor((F.col("_from") + F.col("size") - 1) / block)
    inside = lambda j: F.least(F.col("_from") + F.col("size"), (j + 1) * block) - F.greatest(F.col("_from"), j * block)
    partial = F.aggregate(F.sequence(first, last), F.lit(0).cast("long"), lambda acc, j: acc + F.when(block_picked(j, seed), inside(j)).otherwise(0))
    return laid.withColumn("partial", F.when((F.col("size") > 0) & (F.col("picked") > 0), partial).otherwise(0)).withColumn("taken", F.col("passes") * F.col("size") + F.col("partial"))


def block_picked(j: Column, seed: int) -> Column:
    """Is block j among the `picked` of `n_blocks`? An affine permutation j -> (a j + c) mod n, with a prime
    that does not divide n, spreads the picks over the shard; c comes from the seed and the shard."""
    prime = F.when(F.col("n_blocks") % 1_000_003 != 0, F.lit(1_000_003)).otherwise(F.lit(1_000_033))
    shift = seeded_long(seed + 2, F.col("source"), F.col("shard")) % F.col("n_blocks")
    return F.pmod(j * prime + shift, F.col("n_blocks")) < F.col("picked")


def _few(sources: DataFrame, limit: int = 2000) -> bool:
    """May the source table be broadcast? Counted, up to the limit."""
    return sources.limit(limit + 1).count() <= limit


def mixed_rows(docs: DataFrame, plan: DataFrame, seed: int = 17) -> DataFrame:
    """The mix itself: a document appears once per whole pass, and once more, cut to its picked words, if
    the partial pass takes some. Columns as those of docs; n_chars, if there, follows the text."""
    keyed = docs.select(F.struct(*docs.columns).alias("doc")).withColumn("_u", F.xxhash64(F.lit(seed), "doc.text"))
    rule = F.min(F.struct("_from", "shard", "n_blocks", "picked", "block", "size", "passes", "partial")).alias("p")  # repeated rows share one
    own = plan.where("taken > 0").groupBy("doc_id", "_t", "source").agg(rule).select("doc_id", "_t", "source", "p.*")
    both = keyed.join(own, F.col("doc.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("_u") == F.col("_t")) & F.col("doc.source").eqNullSafe(F.col("source")))
    words = F.regexp_extract_all("doc.text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    cut = F.array_join(F.filter(words, lambda x, i: block_picked(F.floor((F.col("_from") + i) / F.col("block")), seed)), "")
    copies = F.concat(F.array_repeat(F.col("doc.text"), F.col("passes").cast("int")), F.when(F.col("partial") > 0, F.array(cut)).otherwise(F.array().cast("array<string>")))
    out = both.select("doc", F.explode(copies).alias("text"))
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return out.select(*[new[c].alias(c) if c in new else F.col(f"doc.`{c}`").alias(c) for c in docs.columns])


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


#: Plain form of the same rules: every quotient is ranked, every block is a row.
SQL = r"""
WITH RECURSIVE z AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n_rows, (row_number() OVER (ORDER BY source NULLS LAST) - 1) AS i
  FROM z GROUP BY source
), w AS (SELECT *, (1 + i % 3)::DOUBLE AS w, 3.0::DOUBLE * source_size AS cap FROM s),
fill(step, level, n_capped) AS (
  SELECT 0, (SELECT sum(source_size) / sum(w) FROM w), 0::BIGINT
  UNION ALL
  SELECT f.step + 1, g.level, g.n FROM fill f, LATERAL (
    SELECT ((SELECT sum(source_size) FROM w)::DOUBLE - coalesce(sum(cap) FILTER (cap < f.level * w), 0)) / sum(w) FILTER (cap >= f.level * w) AS level,
           count(*) FILTER (cap < f.level * w) AS n FROM w) g
  WHERE g.n > f.n_capped
), t AS (
  SELECT w.*, least(cap, (SELECT level FROM fill ORDER BY step DESC LIMIT 1) * w) AS target,
         greatest(1, ceil(source_size / 2097152.0), ceil(n_rows / 131072.0))::BIGINT AS shards FROM w
), u AS (SELECT greatest(1, least(128, floor(min(target) FILTER (target > 0) / 128)))::BIGINT AS unit FROM t),
b AS (SELECT round(sum(target) / any_value(unit))::BIGINT AS blocks FROM t, u),
q AS (
  SELECT i, count(*) AS quota FROM (
    SELECT i, row_number() OVER (ORDER BY target / (2 * k - 1) DESC, source, k) AS r
    FROM t, LATERAL (SELECT unnest(generate_series(1, (SELECT blocks FROM b))) AS k) WHERE target > 0)
  WHERE r <= (SELECT blocks FROM b) GROUP BY i
), d AS (
  SELECT z.doc_id, z.size, t.i, t.source, t.source_size, t.target, greatest(1, least(128, floor(t.target / 128)))::BIGINT AS block, coalesce(q.quota, 0) AS source_quota,
         md5('17:' || coalesce(z.doc_id::VARCHAR, '')) AS ord,
         ('0x' || substr(md5('18:' || coalesce(z.doc_id::VARCHAR, '')), 1, 8))::BIGINT % t.shards AS shard
  FROM z JOIN t ON z.source IS NOT DISTINCT FROM t.source LEFT JOIN q USING (i)
), h AS (
  SELECT i, shard, any_value(source) AS source, any_value(source_quota) AS source_quota, any_value(block) AS block, sum(size)::BIGINT AS shard_size FROM d GROUP BY i, shard
), hq AS (
  SELECT i, shard, count(*) AS quota FROM (
    SELECT i, shard, source_quota, row_number() OVER (PARTITION BY i ORDER BY shard_size::DOUBLE / (2 * k - 1) DESC, shard, k) AS r
    FROM h, LATERAL (SELECT unnest(generate_series(1, source_quota)) AS k) WHERE shard_size > 0)
  WHERE r <= source_quota GROUP BY i, shard
), p AS (
  SELECT h.*, coalesce(hq.quota, 0) * (SELECT unit FROM u) AS words, ceil(shard_size / block::DOUBLE)::BIGINT AS n_blocks,
         least(3, floor(coalesce(hq.quota, 0) * (SELECT unit FROM u) / greatest(shard_size, 1)::DOUBLE))::BIGINT AS passes
  FROM h LEFT JOIN hq USING (i, shard)
), p2 AS (
  SELECT *, CASE WHEN passes >= 3 THEN 0 ELSE greatest(0, least(n_blocks, round((words - passes * shard_size) / block::DOUBLE)::BIGINT)) END AS picked,
         ('0x' || substr(md5('19:' || coalesce(source, '') || ':' || shard::VARCHAR), 1, 8))::BIGINT AS shift
  FROM p
), laid AS (
  SELECT d.*, p2.n_blocks, p2.passes, p2.picked, p2.shift,
         coalesce(sum(d.size) OVER (PARTITION BY d.i, d.shard ORDER BY d.ord, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS from_word
  FROM d JOIN p2 USING (i, shard)
), part AS (
  SELECT doc_id, sum(least(from_word + size, (j + 1) * block) - greatest(from_word, j * block)) AS partial
  FROM laid, LATERAL (SELECT unnest(generate_series(from_word // block, (from_word + size - 1) // block)) AS j)
  WHERE size > 0 AND (j * (CASE WHEN n_blocks % 1000003 <> 0 THEN 1000003 ELSE 1000033 END) + shift % n_blocks) % n_blocks < picked
  GROUP BY doc_id
)
SELECT laid.doc_id, size, source_size, round(target, 6) AS target, (passes * size + coalesce(partial, 0))::BIGINT AS taken
FROM laid LEFT JOIN part USING (doc_id)
"""
