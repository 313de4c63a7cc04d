"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the distinct hashes of words, of their stems (first `STEMS` letters; inflected and compound forms of a
word share them), word pairs and pairs that skip a word, over the whole text. FTRL
keeps a learning rate for each coordinate, and its L1 term leaves most weights at exactly 0, so the model is a
short list of (index, weight) that goes to every task. The parameters were chosen by cross-validation inside the
learning rows (README); the held-out fold has no part in them.

It learns from at most `max_rows` labelled rows (documented bound; the first by a hash of the id, one row each) of at most
`max_features` features together (128 MB), which one task can hold. Scoring covers every row. Defined results: NULL or empty text scores by the intercept alone;
with no labelled rows every score is 0; a NULL id is scored but never learned from.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm.common import bounded_labels, is_held_out, labelled_texts, read, stash, within

STEMS = (4, 6)
TOKEN = re.compile(r"[^\W_]+")
ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


@dataclass(frozen=True)
class FtrlParams:
    bits: int = 20
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 10.0
    l2: float = 0.0
    epochs: int = 4
    max_rows: int = 16_000
    max_features: int = 32_000_000


class WordHashes(dict):
    """word -> 64-bit hash, remembered; emptied when 200,000 words are in it."""

    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word.encode())
        return h


class StemHashes(dict):
    """word -> hashes of its stems, those that are shorter than the word; emptied like WordHashes."""

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > 200_000:
            self.clear()
        self[word] = h = tuple(xxhash.xxh3_64_intdigest(f"{word[:n]}*".encode()) for n in STEMS if len(word) > n)
        return h


class Hashes:
    def __init__(self) -> None:
        self.words, self.stems = WordHashes(), StemHashes()


def features(text: str | None, hashes: Hashes, bits: int) -> np.ndarray:
    """Distinct feature indices of a text."""
    words = TOKEN.findall((text or "").lower())
    h = np.fromiter(map(hashes.words.__getitem__, words), np.uint64, len(words))
    stems = np.fromiter(chain.from_iterable(map(hashes.stems.__getitem__, set(words))), np.uint64)
    pairs = h[:-1] * ODD[0] + h[1:] * ODD[1]
    skips = h[:-2] * ODD[2] + h[2:] * ODD[3]
    mixed = np.concatenate((h * ODD[3], stems, pairs, skips))
    mixed ^= mixed >> np.uint64(29)
    return np.unique((mixed * ODD[0]) >> np.uint64(64 - bits)).astype(np.int32)


@dataclass(frozen=True)
class FtrlModel:
    index: np.ndarray
    weight: np.ndarray
    bias: float | None
    bits: int

    def dense(self) -> np.ndarray:
        w = np.zeros(1 << self.bits, np.float64)
        w[self.index] = self.weight
        return w

    def score(self, found: np.ndarray, dense: np.ndarray) -> float:
        if self.bias is None:
            return 0.0
        return float(1 / (1 + np.exp(-np.clip(self.bias + dense[found].sum(), -30, 30))))


def train(rows: list[np.ndarray], labels: np.ndarray, p: FtrlParams) -> FtrlModel:
    z, n = np.zeros((1 << p.bits) + 1), np.zeros((1 << p.bits) + 1)
    bias = 1 << p.bits
    l1 = np.float64(p.l1)

    def weights(x: np.ndarray) -> np.ndarray:
        zx = z[x]
        w = -(zx - np.sign(zx) * l1) / ((p.beta + np.sqrt(n[x])) / p.alpha + p.l2)
        return np.where(np.abs(zx) <= l1, 0.0, w)

    order = np.random.default_rng(5)
    for _ in range(p.epochs):
        for k in order.permutation(len(rows)):
            x = np.append(rows[k], bias)
            w = weights(x)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - labels[k]
            step = (np.sqrt(n[x] + g * g) - np.sqrt(n[x])) / p.alpha
            z[x] += g - step * w
            n[x] += g * g
    if not rows:
        return FtrlModel(np.zeros(0, np.int32), np.zeros(0), None, p.bits)
    every = weights(np.arange(bias + 1))
    keep = np.flatnonzero(every[:bias]).astype(np.int32)
    return FtrlModel(keep, every[keep], float(every[bias]), p.bits)


def training_rows(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, params: FtrlParams) -> DataFrame:
    """doc_id, y, x (feature indices), n (their number): the bounded rows that are fitted, hashed where they are."""
    bits = params.bits

    def hash_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for b in batches:
            xs = [features(t.as_py(), hashes, bits) for t in b.column(2)]
            sizes = pa.array(map(len, xs), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x.tobytes() for x in xs], pa.binary()), sizes], ["doc_id", "y", "x", "n"])

    sample = bounded_labels(labels, label, modulus, held_out, params.max_rows)
    hashed = labelled_texts(docs, sample).mapInArrow(hash_rows, "doc_id long, y int, x binary, n long")
    return within(stash(hashed, "labelled-features"), "n", params.max_features)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", modulus: int = 5, held_out: int = 0, params: FtrlParams = FtrlParams()) -> FtrlModel:
    """The bounded sample of labelled rows is fitted in one task."""

    def fit_one(t: pa.Table) -> pa.Table:
        t = t.sort_by([("doc_id", "ascending"), ("x", "ascending")])
        m = train([np.frombuffer(x.as_py(), np.int32) for x in t.column("x")], t.column("y").to_numpy(), params)
        return pa.table({"i": [m.index.tobytes()], "w": [m.weight.tobytes()], "bias": pa.array([m.bias], pa.float64())})

    rows = training_rows(docs, labels, label, modulus, held_out, params).select("doc_id", "y", "x")
    got = rows.groupBy(F.lit(0).alias("_all")).applyInArrow(fit_one, "i binary, w binary, bias double").first()
    if got is None:
        return train([], np.zeros(0), params)
    return FtrlModel(np.frombuffer(got["i"], np.int32), np.frombuffer(got["w"]), got["bias"], params.bits)


def scores(texts: pa.Array, model: FtrlModel, hashes: Hashes, dense: np.ndarray) -> np.ndarray:
    return np.array([model.score(features(t.as_py(), hashes, model.bits), dense) for t in texts], np.float64)


def score_rows(docs: DataFrame, model: FtrlModel) -> DataFrame:
    """(doc_id, text) -> (doc_id, score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, dense = Hashes(), model.dense()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores(b.column(1), model, hashes, dense))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def keep_clean(docs: DataFrame, model: FtrlModel, threshold: float = 0.5) -> DataFrame:
    """docs without the rows that score at least threshold; all columns pass through."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, dense = Hashes(), model.dense()
        for b in batches:
            yield b.filter(pa.array(scores(b.column(at), model, hashes, dense) < threshold))

    return docs.mapInArrow(run, docs.schema)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = fit(docs, read(spark, sf_dir, "labels"))
    return score_rows(docs, model).select("doc_id", is_held_out(5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
