"""Near-duplicate documents: MinHash bands propose, odd sketches screen, full shingle sets confirm.

A document is its set of distinct shingles (64-bit hashes) of `words` words: 4 in op3, 5 where copies are removed. Equal sets are one node, so copies are never
paired. 200 MinHash values give 40 bands of 5, which miss a pair at similarity 0.8 with a chance of 1e-7; their
parities, folded into a bitmap of 512 bits, make an odd sketch. The XOR population count of two sketches
estimates high similarities closely: a pair is dropped only beyond `SCREEN`, five standard deviations past
what similarity 0.8 gives. What is left is confirmed on the full sets.

Links are found in two steps, so that no group of n members makes n * n rows:
1. each bucket's members against its smallest id (linear in the bucket);
2. only buckets whose members are still in different components: small ones by a join on the bucket, large ones
   in blocks of `BLOCK` members. There the bucket's largest component is never compared within itself: only the strays
   are compared, with it and with each other, on sketches and bands. Full sets follow only for members that a sketch
   leaves open, and a task then works from the closest pair on, skips what it has already joined and returns at
   most one link per member;
3. buckets with more than `CROWD` strays, as pages of one template below the similarity make them, are left for a prefix
   filter, which is exact: with its shingles ordered from the rare on, a member's first ninth or fifth (at 0.8, as the smaller
   or larger of a pair) has to hold one of the other's. What pages share with all others comes last in that order,
   so pages of a template make no buckets there, and the work follows their number. Nothing is capped.

Defined results: NULL, empty or blank text has no shingles and is its own component; fewer words than a shingle
holds are one shingle; repeated rows and equal sets share a component; a NULL id is never a component's name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm.common import discard, read, stash

WORDS, STAGE_WORDS, BANDS, ROWS = 4, 5, 40, 5
HASHES = BANDS * ROWS
SKETCH = 512
SCREEN = 120
SMALL, BLOCK, CROWD = 48, 512, 64
#: Counters of shingles for the order of the prefix filter, as a power of two. Any order is right, a rough count separates templates.
SLOTS = 18
U = np.uint64
_RNG = np.random.default_rng(20_011)
MULTIPLY = _RNG.integers(1, 2**63, HASHES, np.uint64) * U(2) + U(1)
FLIP = _RNG.integers(0, 2**63, HASHES, np.uint64)
FOLD = _RNG.integers(1, 2**63, max(WORDS, ROWS) + 1, np.uint64) * U(2) + U(1)


class WordHashes(dict):
    """word -> 64-bit hash, remembered; emptied when 200,000 words are in it."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(31))) * FOLD[0]
    return x ^ (x >> U(29))


def shingles(text: str | None, hashes: WordHashes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct shingle hashes. bytes.lower and bytes.split know ASCII letters and white space only."""
    found = (text or "").encode().lower().split()
    n = len(found)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, found), np.uint64, n)
    width = min(words, n)
    rolled = np.full(n - width + 1, width, np.uint64)
    for i in range(width):
        rolled = rolled * FOLD[1] + h[i : n - width + 1 + i]
    return np.unique(mixed(rolled))


def signature(s: np.ndarray) -> np.ndarray:
    low = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), 2048):
        np.minimum(low, ((s[None, at : at + 2048] ^ FLIP[:, None]) * MULTIPLY[:, None]).min(axis=1), out=low)
    return low


def odd_sketch(low: np.ndarray) -> np.ndarray:
    bits = (mixed(low + np.arange(HASHES, dtype=np.uint64) * FOLD[2]) >> U(64 - SKETCH.bit_length() + 1)).astype(np.int64)
    return np.packbits(np.bincount(bits, minlength=SKETCH).astype(np.uint8) & 1).view(np.int64)


def bands(low: np.ndarray) -> np.ndarray:
    table = low.reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * FOLD[3]
    for i in range(ROWS):
        key = mixed(key * FOLD[4] + table[:, i])
    return key.view(np.int64)


def profile(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, text) -> doc_id, n_shingles, set_hash, sketch, bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            n, key, sketch, band = [], [], [], []
            for t in b.column(1):
                s = shingles(t.as_py(), hashes, words)
                n.append(len(s))
                key.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                low = signature(s) if len(s) else None
                sketch.append(odd_sketch(low) if len(s) else None)
                band.append(bands(low) if len(s) else None)
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(sketch, longs), pa.array(band, longs)], ["doc_id", "n_shingles", "set_hash", "sketch", "bands"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, set_hash binary, sketch array<long>, bands array<long>")


def shingle_rows(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(id, text) -> id, s: the full sorted set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            sets = [shingles(t.as_py(), hashes, words).view(np.int64) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64()))], ["id", "s"])

    return docs.select("id", "text").mapInArrow(run, "id long, s array<long>")


def differing(a: Column, b: Column) -> Column:
    """XOR population count of two sketches."""
    total = F.lit(0)
    for i in range(SKETCH // 64):
        total = total + F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i))))
    return total


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity."""
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return both.where(100 * common >= percent * (F.size("sa") + F.size("sb") - common)).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """(a, b) -> id, component: the smallest id reachable. Alternating large-star and small-star steps, each
    a grouping and a join; the links of the next round are stashed, so the lineage stays short."""
    edges = stash(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "cc")
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionByName(low.where("m < u").select("u", F.col("m").alias("v"))).distinct()
        small_low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = stash(small.unionByName(small_low.select("u", F.col("m").alias("v"))).distinct(), "cc")
        now = tuple(after.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.col("v").cast("decimal(20,0)"))).first())
        discard(edges)
        edges = after
        if now == seen:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
        seen = now


TASK = ["band", "kind", "i", "j"]


def largest_components(members: DataFrame) -> DataFrame:
    """band, _main (the largest component), _n (its members), _all, and _m, how many rows are marked as first, where that is a column."""
    first = F.sum(F.col("first").cast("int")) if "first" in members.columns else F.sum(F.lit(1))
    sizes = members.groupBy("band", "component").agg(F.count("*").alias("_c"), first.alias("_f"))
    return sizes.groupBy("band").agg(F.max_by("component", F.struct("_c", "component")).alias("_main"), F.max("_c").alias("_n"), F.sum("_c").alias("_all"), F.sum("_f").alias("_m"))


def dealt(members: DataFrame) -> DataFrame:
    """(band, id, component, and more) -> the same and side, kind, i, j: the block pairs that a member takes part in.
    Kind 0 sets a block of the bucket's largest component against one of strays, kind 1 two blocks of strays. n members
    with k strays make about 2 n k / BLOCK rows, n of them for a single stray. With a column `first`, a pair needs a row so
    marked; where fewer are marked than are strays, they take the strays' part."""
    largest = stash(largest_components(members), "nd-largest")  # a row for each bucket; apart from its grouping, the join below can split a hot bucket
    rows = members.join(largest, "band")
    k, other = F.col("_all") - F.col("_n"), F.col("component") != F.col("_main")
    few, other = (F.least(k, "_m"), F.when(F.col("_m") < k, F.col("first")).otherwise(other)) if "first" in members.columns else (k, other)
    rows = rows.withColumn("side", other.cast("int"))
    main, stray = (F.ceil(c / BLOCK).cast("int") for c in (F.col("_all") - few, few))
    is_stray = F.col("side") == 1
    rows = rows.withColumns({"_own": F.pmod(F.xxhash64("id"), F.when(is_stray, stray).otherwise(main)).cast("int"), "_stray": stray, "_other": F.when(is_stray, main).otherwise(stray)})
    task = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"))
    upto = lambda n: F.filter(F.sequence(F.lit(0), n), lambda k: k < n)
    own = F.col("_own")
    across = F.transform(upto(F.col("_other")), lambda k: F.when(is_stray, task(0, k, own)).otherwise(task(0, own, k)))
    among = F.transform(upto(F.col("_stray")), lambda k: task(1, F.least(own, k), F.greatest(own, k)))
    tasks = F.when(is_stray, F.concat(across, among)).otherwise(across)
    return rows.withColumn("_t", F.explode(tasks)).select(*members.columns, "side", "_own", "_t.*")


def slot_of(s: np.ndarray) -> np.ndarray:
    return (s.view(np.uint64) >> U(64 - SLOTS)).astype(np.int64)


def slot_counts(sets: DataFrame) -> np.ndarray:
    """How many members hold a shingle, by 2^SLOTS hashed counters. A task sends one row for each counter in use at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SLOTS, np.int64)
        for b in batches:
            for s in b.column(0):
                counts += np.bincount(slot_of(np.array(s.values)), minlength=1 << SLOTS)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["slot", "n"])

    out = np.zeros(1 << SLOTS, np.int64)
    for slot, n in sets.select("s").mapInArrow(count, "slot long, n long").groupBy("slot").sum("n").collect():  # 2^SLOTS rows at most
        out[slot] = n
    return out


def prefix_lengths(n: int, percent: int) -> tuple[int, int]:
    """Of n shingles, how many of the rarest have to meet another's: as the smaller of a pair, and as the larger."""
    return n - -(-2 * percent * n // (100 + percent)) + 1, n - -(-percent * n // 100) + 1


def prefixes(sets: DataFrame, counts: np.ndarray, percent: int) -> DataFrame:
    """(id, component, s) -> band (a shingle), id, component, first: the member's rarest shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bands, sizes, first = [np.zeros(0, np.int64)], [], []
            for s in b.column(2):
                x = np.array(s.values)
                small, large = prefix_lengths(len(x), percent)
                bands.append(x[np.lexsort((x, counts[slot_of(x)]))[:large]])
                sizes.append(large)
                first.append(np.arange(large) < small)
            of = np.repeat(np.arange(b.num_rows), sizes)
            marked = np.concatenate(first) if first else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(bands)), b.column(0).take(pa.array(of)), b.column(1).take(pa.array(of)), pa.array(marked)], ["band", "id", "component", "first"])

    return sets.select("id", "component", "s").mapInArrow(run, "band long, id long, component long, first boolean")


def block_sides(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The rows of the two blocks of a task."""
    kind, i, j = (t.column(c)[0].as_py() for c in TASK[1:])
    own = t.column("_own" if kind else "side").to_numpy()
    return np.flatnonzero(own == (i if kind else 0)), np.flatnonzero(own == (j if kind else 1))


def open_pairs(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distance and places of the pairs across the two blocks of a task that their sketches leave open, in different
    components. A pair belongs to its first common bucket alone."""
    left, right = block_sides(t)
    sketch, band = (np.array(t.column(c).to_pylist(), np.int64) for c in ("sketch", "bands"))
    sketch, comp, this = sketch.view(np.uint64), t.column("component").to_numpy(), t.column("band")[0].as_py()
    apart = np.zeros((len(left), len(right)), np.uint16)
    for k in range(sketch.shape[1]):
        apart += np.bitwise_count(sketch[left, k][:, None] ^ sketch[right, k][None, :])
    open_ = (apart <= SCREEN) & (comp[left][:, None] != comp[right][None, :])
    if t.column("kind")[0].as_py() and t.column("i")[0] == t.column("j")[0]:
        open_ &= left[:, None] < right[None, :]
    x, y = np.nonzero(open_)
    distance, x, y = apart[x, y], left[x], right[y]
    if not band.size:  # buckets of a prefix filter: a pair may be seen in several
        return distance, x, y
    first = [(band[p] == band[q]).argmax(axis=1) for p, q in zip(np.array_split(x, len(x) // 65536 + 1), np.array_split(y, len(y) // 65536 + 1))]
    here = band[x, np.concatenate(first)] == this
    return distance[here], x[here], y[here]


def block_links(members: DataFrame, marks: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links inside large buckets. members: band, id, component; marks: id, sketch, bands; sets: id, s."""

    def screen(t: pa.Table) -> pa.Table:
        _, x, y = open_pairs(t)
        return t.select([*TASK, "id", "component", "side", "_own", "sketch", "bands"]).take(pa.array(np.union1d(x, y)))

    def link(t: pa.Table) -> pa.Table:
        ids, comp = (t.column(c).to_numpy() for c in ("id", "component"))
        sets = [np.array(s.values) for s in t.column("s").combine_chunks()]
        distance, x, y = open_pairs(t)
        order = np.argsort(distance, kind="stable")
        root: dict[int, int] = {}

        def find(c: int) -> int:
            while root.get(c, c) != c:
                root[c] = root.get(root[c], root[c])
                c = root[c]
            return c

        a, b = [], []
        for p, q in zip(x[order].tolist(), y[order].tolist()):
            cp, cq = find(int(comp[p])), find(int(comp[q]))
            if cp == cq:
                continue
            common = len(np.intersect1d(sets[p], sets[q], assume_unique=True))
            if 100 * common >= percent * (len(sets[p]) + len(sets[q]) - common):
                root[max(cp, cq)] = min(cp, cq)
                a.append(int(ids[p]))
                b.append(int(ids[q]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    light = dealt(members.join(marks, "id"))
    kept = light.groupBy(*TASK).applyInArrow(screen, "band long, kind int, i int, j int, id long, component long, side int, _own int, sketch array<long>, bands array<long>")
    return kept.join(sets, "id").groupBy(*TASK).applyInArrow(link, "a long, b long")


def small_links(members: DataFrame, sketches: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links inside small buckets: all pairs of different components that the sketches leave open. With a column `first`, a pair
    needs a row so marked."""
    rows = members.join(sketches, "id")
    marked = "first" in members.columns
    x, y = (rows.select("band", F.col("id").alias(i), F.col("component").alias(f"c{i}"), F.col("sketch").alias(f"_{i}"), *[F.col("first").alias(f"f{i}")] * marked) for i in "ab")
    near = x.join(y, (x["band"] == y["band"]) & (F.col("a") > F.col("b")) & (F.col("ca") != F.col("cb")) & (F.col("fa") | F.col("fb") if marked else F.lit(True)) & (differing(F.col("_a"), F.col("_b")) <= SCREEN))
    return confirmed(near.select("a", "b").distinct(), sets, percent)


def prefix_links(members: DataFrame, marks: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """All links between members (id, component) of different components, by buckets of a prefix filter in place of bands."""
    own = stash(members.join(sets, "id"), "nd-crowded-sets")
    rows = prefixes(own, slot_counts(own), percent)
    split = F.col("first") & (F.col("_a") != F.col("_z"))
    groups = rows.groupBy("band").agg(F.count("*").alias("n"), F.max("first").alias("first"), F.min("component").alias("_a"), F.max("component").alias("_z")).where((F.col("n") > 1) & split)
    rest = stash(rows.join(groups.select("band", "n"), "band"), "nd-prefixes")
    bare = marks.select("id", "sketch", F.array().cast("array<bigint>").alias("bands"))
    found = small_links(rest.where(F.col("n") <= SMALL).drop("n"), marks.select("id", "sketch"), sets, percent)
    return found.unionByName(block_links(rest.where(F.col("n") > SMALL).drop("n"), bare, sets, percent))


def near_duplicates(docs: DataFrame, percent: int = 80, words: int = WORDS) -> DataFrame:
    """(doc_id, text) -> doc_id, n_shingles, component_id, kept."""
    profiles = stash(profile(docs, words), "nd-profiles")
    nodes = profiles.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("set_hash").agg(F.min("doc_id").alias("node"))
    nodes = stash(nodes, "nd-nodes")
    ids = nodes.select(F.col("node").alias("id")).distinct()
    reps = profiles.where("n_shingles > 0").select(F.col("doc_id").alias("id"), "sketch", "bands").join(ids, "id", "left_semi")
    placed = reps.select("id", F.explode("bands").alias("band")).distinct()
    buckets = placed.groupBy("band").agg(F.min("id").alias("hub"), F.count("*").alias("n")).where("n > 1")
    members = stash(placed.join(buckets, "band"), "nd-members")
    candidates = members.select("id").distinct()
    texts = docs.select(F.col("doc_id").alias("id"), "text").join(candidates, "id", "left_semi")
    sets = stash(shingle_rows(texts, words), "nd-sets", "snappy")
    marks = stash(reps.join(candidates, "id", "left_semi"), "nd-marks")
    sketches = marks.select("id", "sketch")

    def screened(pairs: DataFrame) -> DataFrame:
        a, b = (sketches.select(F.col("id").alias(x), F.col("sketch").alias(f"_{x}")) for x in "ab")
        return pairs.join(a, "a").join(b, "b").where(differing(F.col("_a"), F.col("_b")) <= SCREEN).select("a", "b")

    stars = members.where("id <> hub").select(F.col("id").alias("a"), F.col("hub").alias("b")).distinct()
    links = stash(confirmed(screened(stars), sets, percent), "nd-links")
    found = components(links)
    joined = members.drop("hub").join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    split = joined.groupBy("band").agg(F.min("component").alias("_a"), F.max("component").alias("_z")).where("_a <> _z").select("band")
    rest = stash(joined.join(split, "band", "left_semi"), "nd-rest")
    more = small_links(rest.where(F.col("n") <= SMALL).select("band", "id", "component"), sketches, sets, percent)
    large = rest.where(F.col("n") > SMALL).select("band", "id", "component")
    one_set, one_mark = sets.dropDuplicates(["id"]), marks.dropDuplicates(["id"])
    crowded = stash(largest_components(large).where(F.col("_all") - F.col("_n") > CROWD).select("band"), "nd-crowded")
    if crowded.take(1):
        more = more.unionByName(prefix_links(large.join(crowded, "band", "left_semi").select("id", "component").distinct(), one_mark, one_set, percent))
        large = large.join(crowded, "band", "left_anti")
    more = stash(more.unionByName(block_links(large, one_mark, one_set, percent)), "nd-more")
    final = components(links.unionByName(more)) if more.take(1) else found
    named = nodes.join(final, nodes["node"] == final["id"], "left").select("set_hash", F.coalesce("component", "node").alias("component"))
    out = profiles.select("doc_id", "n_shingles", "set_hash").join(named, "set_hash", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, words: int = STAGE_WORDS) -> DataFrame:
    """docs without the near copies: of each component the row with its smallest id stays (repeated rows of
    that id are one document and stay as they are). All columns pass through."""
    gone = near_duplicates(docs, words=words).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), words=4)


#: Plain form: every pair that shares a shingle, then the transitive closure.
SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
         ELSE list_transform(generate_series(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+3], ' ')) END) AS ss FROM w
), e AS (SELECT doc_id, len(ss) AS n, unnest(ss) AS sh FROM s),
link AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.sh = b.sh AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN link l ON r.other = l.a
), c AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT s.doc_id, len(ss)::BIGINT AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept FROM s JOIN c USING (doc_id)
"""
