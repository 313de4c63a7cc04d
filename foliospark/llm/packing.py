"""Lexical retrieval packing into windows of a fixed number of tokens.

Texts are tokenized once into a stashed table of ids; document frequencies of the token ids are counted over
all documents (the vocabulary bounds that table, so every task gets it). A document's lexical key is a few of its ids,
drawn in proportion to their weight by the same draws in all documents, so two documents draw the same one with a
chance of their weighted similarity. Keys are ranked over the whole corpus and documents go to shards of `SHARD`
in that order, so texts alike meet wherever they lie, and a group of any size is cut into shards. Each shard has a
BM25 inverted index: a seed document opens a window, its best unused neighbours, by all terms, fill it, the last one is
cut at the window's end and its rest opens the next window. So only a shard's last window can need padding; that one
gets the next power of two. Nothing depends on how the rows lie in files or partitions. The neighbour search is not
exact over the corpus: it is exact within a shard.

Defined results: NULL or empty text is one end id, in one piece; repeated rows are packed each as a document of its
own; ids are never dropped; the string of an added token of the vocabulary is that token.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm.common import read, stash

WINDOW, END = 1024, 0
#: Documents of a shard, ids of a lexical key, parts at most (beyond, parts hold more shards), tokens of a shard.
SHARD, DRAWN, MAX_PARTS, SHARD_TOKENS = 2048, 3, 65_536, 4_000_000
#: Documents and bytes of ids (but for a single document) that keys are drawn for together.
TOGETHER, TOGETHER_BYTES = 128, 4_000_000
#: The pattern without its lookahead, which only chooses where white space meets white space: no backtracking.
PLAIN, ADJACENT = public_tokenizers.PATTERN.replace(r"\s+(?!\S)|", ""), re.compile(r"\s\s")


def added_tokens(path: str) -> dict[str, int]:
    """Strings and ids of the added tokens of a .json vocabulary."""
    with open(path, encoding="utf-8") as f:
        return {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}


class Encoder:
    """The byte-level BPE of a .tiktoken file. Its ids are those of the .json file of the same vocabulary; it
    encodes some five times as fast. Texts without adjacent white space are split by the plain pattern."""

    def __init__(self, path: str, added: dict[str, int]):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.full, self.plain = (
            tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens=added) for pattern in (public_tokenizers.PATTERN, PLAIN)
        )
        self.allowed = set(added)

    def encode(self, text: str) -> np.ndarray:
        return (self.full if ADJACENT.search(text) else self.plain).encode_to_numpy(text, allowed_special=self.allowed)


@lru_cache(maxsize=2)
def encoder(path: str, added: tuple[tuple[str, int], ...]) -> Encoder:
    """One vocabulary a worker process."""
    return Encoder(path, dict(added))


def tokenize(docs: DataFrame, vocabulary: str | None = None, added: str | None = None) -> DataFrame:
    """(doc_id, text) -> doc_id, ids: 16-bit little-endian ids, the end id last."""
    path = vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken")
    special = tuple(added_tokens(added or public_tokenizers.path("byte_bpe_50k.json")).items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, special)
        for b in batches:
            ids = [np.append(e.encode(t.as_py() or ""), END).astype("<u2").tobytes() for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids binary")


def frequencies(tokens: DataFrame) -> tuple[np.ndarray, float, int]:
    """Document frequency of each id, mean length and number of documents, over all of them. A task sends
    one row of counts; they are added up in two rounds, so that no task or driver gets a row per task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, length = np.zeros(1 << 16, np.int64), 0, 0
        for b in batches:
            for ids in b.column(0):
                x = np.frombuffer(ids.as_py(), "<u2")
                df[x] += 1  # once for each id, however often x holds it
                n += 1
                length += len(x)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({"id": np.append(at, [-1, -2]), "n": np.append(df[at], [n, length])})

    total = tokens.select("ids").mapInArrow(count, "id long, n long").groupBy("id").sum("n")
    got = {r[0]: r[1] for r in total.collect()}  # at most 65,538 rows, whatever the input
    df = np.zeros(1 << 16)
    for k, v in got.items():
        if k >= 0:
            df[k] = v
    n = got.get(-1, 0)
    return df, got.get(-2, 0) / max(n, 1), n


def weights(doc: np.ndarray, term: np.ndarray, tf: np.ndarray, sizes: np.ndarray, idf: np.ndarray, mean: float, k1: float = 1.2, b: float = 0.75) -> np.ndarray:
    return idf[term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * sizes[doc] / max(mean, 1e-9)))


class Bm25:
    """Inverted index over the documents of a shard: postings of each id with BM25 weights, from the frequencies over all
    documents; the postings of an id that an eighth of them hold are a row of all documents. A document's query is all
    of its ids. When half of the indexed documents are used, they leave the index."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float):
        sizes = np.array([len(d) for d in docs])
        keys, tf = np.unique(np.repeat(np.arange(len(docs)), sizes) << 16 | np.concatenate(docs).astype(np.int64), return_counts=True)
        doc, term = keys >> 16, keys & 0xFFFF
        self.queries = np.split(term, np.searchsorted(doc, np.arange(1, len(docs))))
        self.left, self.asked = np.arange(len(docs)), (-1, np.zeros(0))
        self._post(doc, term, weights(doc, term, tf, sizes, idf, mean).astype(np.float32))

    def _post(self, doc: np.ndarray, term: np.ndarray, weight: np.ndarray) -> None:
        """doc: places in self.left, in order."""
        self.all = doc, term, weight
        count = np.bincount(term, minlength=1 << 16)
        often = 8 * count >= len(self.left)
        self.row = np.where(often, np.cumsum(often) - 1, -1)
        in_row = often[term]
        self.rows = np.zeros((int(often.sum()), len(self.left)), np.float32)
        self.rows[self.row[term[in_row]], doc[in_row]] = weight[in_row]
        doc, term, weight = doc[~in_row], term[~in_row], weight[~in_row]
        by_term = np.argsort(term, kind="stable")
        self.doc, self.weight = doc[by_term], weight[by_term].astype(np.float64)
        self.first = np.cumsum(np.where(often, 0, count)) - np.where(often, 0, count)
        self.count = np.where(often, 0, count)

    def scores(self, i: int, unused: np.ndarray) -> np.ndarray:
        """Score of every unused document for the query of document i."""
        if 2 * int(unused.sum()) < len(self.left):
            keep = unused[self.left]
            doc, term, weight = self.all
            stay = keep[doc]
            self.left = self.left[keep]
            self._post((np.cumsum(keep) - 1)[doc[stay]], term[stay], weight[stay])
        q = self.queries[i]
        row, sizes = self.row[q], self.count[q]
        ends = np.cumsum(sizes)
        where = np.repeat(self.first[q] - ends + sizes, sizes) + np.arange(ends[-1])
        out = np.zeros(len(unused))
        out[self.left] = np.bincount(self.doc[where], self.weight[where], minlength=len(self.left)) + self.rows[row[row >= 0]].sum(axis=0)
        return out

    def nearest_unused(self, i: int, unused: np.ndarray) -> int:
        """The unused document with the highest score; the first unused one if none shares an id."""
        if self.asked[0] != i:
            self.asked = i, self.scores(i, unused)
        score = self.asked[1] * unused
        best = int(score.argmax())
        return best if score[best] > 0 else int(unused.argmax())


def chain(docs: list[np.ndarray], idf: np.ndarray, mean: float) -> list[int]:
    """The order in which a shard's documents fill windows: each next one is the best unused neighbour of
    the document that opened the window."""
    index = Bm25(docs, idf, mean)
    unused = np.ones(len(docs), bool)
    order, seed, filled = [], 0, 0
    while True:
        at = seed if unused[seed] else index.nearest_unused(seed, unused)
        unused[at] = False
        order.append(at)
        if len(order) == len(docs):
            return order
        before, filled = filled // WINDOW, filled + len(docs[at])
        if filled // WINDOW > before:  # the window is full: what is left of this document opens the next
            seed = at


KEY = [*(f"k{i}" for i in range(DRAWN)), "node", "id"]


def together(ids: pa.Array) -> Iterator[list[bytes]]:
    group, held = [], 0
    for x in ids:
        raw = x.as_py()
        if group and (len(group) == TOGETHER or held + len(raw) > TOGETHER_BYTES):
            yield group
            group, held = [], 0
        group.append(raw)
        held += len(raw)
    if group:
        yield group


def lexical_keys(ids: pa.Array, doc_ids: list[int | None], draws: np.ndarray) -> list[tuple[int, ...]]:
    """Of each document the ids drawn first, a hash of all ids and the document's: an order of the whole corpus."""
    by_draw = np.argsort(draws, kind="stable")
    rank = np.empty(1 << 16, np.int32)
    rank[by_draw] = np.arange(1 << 16)
    by_draw = np.append(by_draw, 0)  # of fewer different ids than are drawn, the rest is 0
    drawn: list[tuple[int, ...]] = []
    for group in together(ids):
        sizes = np.array([len(raw) // 2 for raw in group])
        left, starts, least = rank[np.frombuffer(b"".join(group), "<u2")], np.cumsum(sizes) - sizes, []
        for _ in range(DRAWN):
            least.append(np.minimum.reduceat(left, starts))
            left[left == np.repeat(least[-1], sizes)] = 1 << 16
        nodes = np.array([xxhash.xxh3_64_intdigest(raw) for raw in group], np.uint64).view(np.int64)
        drawn += zip(*(by_draw[x].tolist() for x in least), nodes.tolist())
    return [(*d, -(1 << 63) if i is None else i) for d, i in zip(drawn, doc_ids, strict=True)]


def lexical_draws(idf: np.ndarray, df: np.ndarray) -> np.ndarray:
    draws = np.random.default_rng(8_011).exponential(size=1 << 16) / np.maximum(idf, 1e-9)
    return np.where(df > 1, draws, draws * 1e6).astype(np.float32)  # what no other document holds comes last


def part_bounds(tokens: DataFrame, draws: np.ndarray) -> list[tuple[int, ...]]:
    """The first key of each part: parts are runs of whole shards in the order of all keys, some four for each shuffle
    partition. Only keys are sorted; the driver gets a row for each part and partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = lexical_keys(b.column(1), b.column(0).to_pylist(), draws)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*keys)] if keys else [pa.array([], pa.int64())] * len(KEY), KEY)

    spark = tokens.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = stash(tokens.select("doc_id", "ids").mapInArrow(run, ", ".join(f"{k} long" for k in KEY)), "pack-keys")
    ranked = keys.repartitionByRange(partitions, *KEY).sortWithinPartitions(*KEY).withColumn("_m", F.monotonically_increasing_id())
    ranked = stash(ranked.withColumns({"_p": F.shiftright("_m", 33), "_r": F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))}), "pack-ranks")
    counts = sorted(map(tuple, ranked.groupBy("_p").count().collect()))
    total = sum(c for _, c in counts)
    step = SHARD * max(1, total // (SHARD * min(4 * partitions, MAX_PARTS)))
    before, offsets = 0, []
    for p, c in counts:
        offsets.append((p, before))
        before += c
    at = ranked.join(F.broadcast(spark.createDataFrame(offsets, "_p long, _o long")), "_p").where((F.col("_o") + F.col("_r")) % step == 0)
    return sorted(map(tuple, at.select(*KEY).collect()))


def placed(tokens: DataFrame, draws: np.ndarray, bounds: list[tuple[int, ...]]) -> DataFrame:
    """doc_id, ids -> part, the key, doc_id, raw (ids, compressed), size."""
    names = ["part", *KEY, "doc_id", "raw", "size"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(1).to_pylist()
            keys = lexical_keys(b.column(1), b.column(0).to_pylist(), draws)
            parts = [max(0, bisect_right(bounds, k) - 1) for k in keys]
            columns = list(zip(*keys)) or [()] * len(KEY)
            raw = [pa.compress(x, "zstd", asbytes=True) for x in ids]
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), *(pa.array(c, pa.int64()) for c in columns), b.column(0), pa.array(raw, pa.binary()), pa.array(map(len, ids), pa.int64())], names)

    return tokens.select("doc_id", "ids").mapInArrow(run, f"part int, {', '.join(f'{k} long' for k in KEY)}, doc_id long, raw binary, size long")


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, padded long"


def pack(dealt: DataFrame, idf: np.ndarray, mean: float, window: int = WINDOW) -> DataFrame:
    """Pieces of a table (part, doc_id, raw, size), sorted in its partitions. A sequence id is made of the part and a
    count in it."""
    idf = idf.astype(np.float32)

    def lay(ids: list, docs: list[np.ndarray], sequence: int) -> tuple[list, int]:
        rows, room = [], window
        first, total = sequence, sum(map(len, docs))
        for at in chain(docs, idf, mean):
            whole, start = docs[at], 0
            while start < len(whole):
                n = min(room, len(whole) - start)
                rows.append((ids[at], start, n, zlib.crc32(whole[start : start + n].astype("<u4").tobytes()), len(whole), sequence, window - room, window))
                start, room = start + n, room - n
                if not room:
                    sequence, room = sequence + 1, window
        if rest := total % window:
            short = 1 << (rest - 1).bit_length()
            rows = [(*r[:-1], short) if r[5] == first + total // window else r for r in rows]
            sequence += 1
        return rows, sequence

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, sequence, ids, docs, held = -1, 0, [], [], 0
        names = [x.split()[0] for x in PIECES.split(", ")]
        out = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names)
        for b in batches:
            for this, i, raw, size in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3).to_pylist()):
                if docs and (this != part or len(docs) >= SHARD or held >= SHARD_TOKENS):
                    rows, sequence = lay(ids, docs, sequence)
                    yield out(rows)
                    ids, docs, held = [], [], 0
                if this != part:
                    part, sequence = this, this << 40
                ids.append(i)
                docs.append(np.frombuffer(pa.decompress(raw.as_py(), size, "zstd"), "<u2"))
                held += len(docs[-1])
        if docs:
            yield out(lay(ids, docs, sequence)[0])

    return dealt.select("part", "doc_id", "raw", "size").mapInArrow(run, PIECES)


def pack_documents(docs: DataFrame, vocabulary: str | None = None, added: str | None = None) -> DataFrame:
    tokens = stash(tokenize(docs, vocabulary, added), "tokens")
    df, mean, n = frequencies(tokens)
    idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
    draws = lexical_draws(idf, df)
    bounds = part_bounds(tokens, draws)
    dealt = placed(tokens, draws, bounds).repartitionById(max(1, len(bounds)), "part").sortWithinPartitions("part", *KEY)
    return pack(dealt, idf, mean)


def op8_bm25_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"))
