"""Exact top-k search over binary codes by incremental multi-index hashing.

A code's bits are cut into m segments; the index holds (segment, value) -> code. Round a looks up every value
at distance a from a query's segments, so after it all codes within m (a + 1) - 1 bits are verified. A query
leaves as soon as its kth verified distance is within that bound; the others go on with a larger radius. Values to
look up are made on the executors. Should a radius have more of them than there are codes, the queries still open are
verified against all codes, in blocks; with segments of log2 n bits that takes neighbours farther than random ones lie.

Codes are looked up once, however many rows share them: a code carries its k + 1 smallest ids, which is all
that ties by id can ever need. So a vector that a third of the rows repeat costs one index entry.

Defined results: a NULL vector is neither query nor neighbour; NULL elements and missing ones give bit 0;
ties go to the smaller id; a row is not its own neighbour, its copies are; fewer than k rows give fewer.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliospark.llm.common import discard, read, stash

BITS = 64
#: Values a query may look up in a round in any case; beyond it, and beyond the number of codes, all codes are verified.
LARGE, SCAN = 1 << 16, 1024


def sign_code(vector: Column, bits: int = BITS) -> Column:
    """One bit per element: 1 if it is over 0. bits up to 64, in a long."""
    bit = lambda i: F.when(F.coalesce(F.get(vector, F.lit(i)), F.lit(0.0)) > 0, F.shiftleft(F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))
    code = bit(0)
    for i in range(1, bits):
        code = code.bitwiseOR(bit(i))
    return code


def cuts(bits: int, m: int) -> list[tuple[int, int]]:
    """(first bit, width) of m segments of nearly equal width."""
    return [(i * bits // m, (i + 1) * bits // m - i * bits // m) for i in range(m)]


def segments(code: Column, bits: int, m: int) -> Column:
    return F.array(*[F.struct(F.lit(i).alias("seg"), F.lit(width).alias("width"), F.shiftrightunsigned(code, at).bitwiseAND(F.lit((1 << width) - 1)).alias("value")) for i, (at, width) in enumerate(cuts(bits, m))])


def probes_at(queries: DataFrame, bits: int, m: int, radius: int) -> DataFrame:
    """(code) -> q, seg, value: the values at exactly `radius` bits from each segment's own, made where the query is, a bit
    after the other in rising order."""
    rows = queries.select(F.col("code").alias("q"), F.explode(segments(F.col("code"), bits, m)).alias("s")).select("q", "s.*", F.lit(-1).alias("bit"))
    for _ in range(radius):
        rows = rows.where("bit + 1 < width").withColumn("bit", F.explode(F.sequence(F.col("bit") + 1, F.col("width") - 1)))
        rows = rows.withColumn("value", F.col("value").bitwiseXOR(F.expr("shiftleft(1L, bit)")))
    return rows.select("q", "seg", "value")


def nearest_codes(hits: DataFrame, k: int) -> DataFrame:
    """The k + 1 codes of each query with the smallest (distance, first id): the best k + 1 rows are rows of these. Each
    task drops the rest before the shuffle."""
    return hits.withColumn("_r", F.row_number().over(W.partitionBy("q").orderBy("distance", "first"))).where(F.col("_r") <= k + 1).drop("_r")


def distance_of() -> Column:
    return F.bit_count(F.col("q").bitwiseXOR(F.col("code"))).cast("long")


def all_verified(queries: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """Verifies every code for queries whose next radius has more values than there are codes, a block of them at a time:
    a block of about `SCAN` codes is what every task gets."""
    blocks = max(1, -(-queries.count() // SCAN))
    every = index.select("code", F.get("ids", F.lit(0)).alias("first"))
    out = None
    for b in range(blocks):
        own = queries.where(F.pmod(F.xxhash64("code"), F.lit(blocks)) == b).select(F.col("code").alias("q"))
        hits = every.crossJoin(F.broadcast(own)).withColumn("distance", distance_of())
        done = stash(nearest_codes(hits, k), "mih-all").select("q", "code", "first", "distance")
        out = done if out is None else out.unionByName(done)
    return out


def top_ids(codes: DataFrame, k: int) -> DataFrame:
    """code -> its k smallest ids, in order. The rank limit is applied before the shuffle as well."""
    rank = F.row_number().over(W.partitionBy("code").orderBy("id"))
    return codes.withColumn("_r", rank).where(F.col("_r") <= k).groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def hamming_top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, bits: int = BITS, m: int | None = None) -> DataFrame:
    """vectors, queries: (id, code) -> query_id, rank, neighbor_id, distance."""
    spark = vectors.sparkSession
    index = stash(top_ids(vectors, k + 1), "mih-codes")
    n = index.count()
    m = m or max(2, int(bits / max(8.0, math.log2(max(n, 2)))))  # segments of log2 n bits or more: about one code per value
    entries = stash(index.select("code", F.get("ids", F.lit(0)).alias("first"), F.explode(segments(F.col("code"), bits, m)).alias("s")).select("s.seg", "s.value", "code", "first"), "mih-index")
    open_ = stash(queries.select("code").distinct(), "mih-open")
    found, done = None, []
    widths = [width for _, width in cuts(bits, m)]
    for radius in range(max(widths) + 1):
        if sum(math.comb(w, radius) for w in widths) > max(n, LARGE):
            done.append(all_verified(open_, index, k))
            break
        # merged by a hint: the planner sees the few queries, not the many values that they become, and would broadcast them
        hits = probes_at(open_, bits, m, radius).hint("merge").join(entries, ["seg", "value"]).select("q", "code", "first").distinct().withColumn("distance", distance_of())
        every = hits if found is None else hits.unionByName(found).distinct()
        best = stash(nearest_codes(every, k), f"mih-found-{radius}")
        covered = m * (radius + 1) - 1
        rows = best.join(index.select("code", F.size("ids").alias("rows")), "code").groupBy("q").agg(F.sum(F.when(F.col("distance") <= covered, F.col("rows")).otherwise(0)).alias("sure"), F.count("*").alias("codes"))
        closed = rows.where((F.col("sure") > k) | (F.col("codes") == n)).select("q")  # k and the query itself, or all there is
        done.append(stash(best.join(closed, "q", "left_semi"), f"mih-done-{radius}"))
        left = stash(open_.join(closed, open_["code"] == closed["q"], "left_anti"), "mih-open")
        found = stash(best.join(closed, "q", "left_anti"), f"mih-rest-{radius}")
        for gone in (open_, best):
            discard(gone)
        open_ = left
        if not left.take(1):
            break
    else:
        done.append(found)  # fewer than k rows in all: every code has been verified
    codes = done[0]
    for d in done[1:]:
        codes = codes.unionByName(d)
    near = codes.join(index, "code").select("q", "distance", F.explode("ids").alias("neighbor_id"))
    # a query code's k + 1 best rows serve all its queries: each drops itself and keeps k
    best_rows = near.withColumn("_r", F.row_number().over(W.partitionBy("q").orderBy("distance", "neighbor_id"))).where(F.col("_r") <= k + 1).drop("_r")
    lists = best_rows.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("distance", "neighbor_id"))).alias("list"))
    own = queries.select(F.col("id").alias("query_id"), F.col("code").alias("q"))
    mine = own.join(lists, "q").withColumn("list", F.slice(F.filter("list", lambda x: x["neighbor_id"] != F.col("query_id")), 1, k))
    return mine.select("query_id", F.posexplode("list").alias("at", "x")).select("query_id", (F.col("at") + 1).cast("long").alias("rank"), F.col("x.neighbor_id").alias("neighbor_id"), F.col("x.distance").alias("distance"))


def op2_hamming_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings").where(F.col("embedding").isNotNull() & F.col("vec_id").isNotNull())
    codes = vectors.select(F.col("vec_id").alias("id"), sign_code(F.col("embedding")).alias("code"))
    return hamming_top_k(codes, codes.where(F.col("id") % 100 == 0))


SQL = """
WITH d AS (
  SELECT q.vec_id AS query_id, v.vec_id AS neighbor_id,
         list_sum(list_transform(generate_series(1, 64), lambda i: ((coalesce(q.embedding[i], 0) > 0) <> (coalesce(v.embedding[i], 0) > 0))::INT))::BIGINT AS distance
  FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id
  WHERE q.vec_id % 100 = 0 AND q.embedding IS NOT NULL AND v.embedding IS NOT NULL
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS rank, neighbor_id, distance FROM d
)
SELECT * FROM r WHERE rank <= 10
"""
