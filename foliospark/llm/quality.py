"""Quality classifier: histogram gradient-boosted trees over document statistics.

Each text gives some twenty numbers. The trees are fitted on at most `max_rows` labelled rows (documented
bound; the first by a hash of the id, one row each), their inputs binned at quantiles, and flattened into arrays (feature,
threshold, leaf) of complete binary trees, which score a whole batch by numpy indexing, level by level.

Defined results: NULL or empty text has statistics 0 and is scored as such; with no labelled rows every
score is 0; a NULL id is scored but never learned from.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm.common import bounded_labels, is_held_out, labelled_texts, read

STATISTICS = (
    "log_words", "log_bytes", "mean_word", "distinct_words", "repeated_next", "most_common", "lower", "upper", "digit", "space", "newline",
    "punctuation", "symbol", "pipe", "exclamation", "non_ascii", "words_ending_plain", "capitalised", "upper_words", "distinct_lines", "mean_line", "stop_end",
)


def _classes() -> np.ndarray:
    """A row for each character class, over the 256 byte values."""
    b = np.arange(256)
    char = [chr(x) for x in b]
    among = lambda s: np.array([c in s for c in char])
    ascii_ = b < 128
    lower, upper, digit = (ascii_ & np.array([f(c) for c in char]) for f in (str.islower, str.isupper, str.isdigit))
    rest = ascii_ & (b > 32) & (b < 127) & ~lower & ~upper & ~digit & ~among(".,;:'\"-()?!|")
    return np.array([lower, upper, digit, among(" \t"), b == 10, among(".,;:'\"-()?"), rest, b == ord("|"), b == ord("!"), ~ascii_], np.float64)


CLASSES = _classes()


def statistics(text: str | None) -> np.ndarray:
    raw = (text or "").encode()
    words = raw.split()
    if not words:
        return np.zeros(len(STATISTICS))
    n = len(words)
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    again = sum(map(bytes.__eq__, words, words[1:]))
    shares = CLASSES @ np.bincount(np.frombuffer(raw, np.uint8), minlength=256) / len(raw)
    plain = sum(map(bytes.isalpha, (w[-1:] for w in words)))
    lines = raw.split(b"\n")
    return np.array(
        [
            np.log1p(n), np.log1p(len(raw)), len(raw) / n, len(counts) / n, again / n, max(counts.values()) / n, *shares, plain / n,
            sum(map(bytes.istitle, words)) / n, sum(map(bytes.isupper, words)) / n, len(set(lines)) / len(lines), np.log1p(len(raw) / len(lines)), float(raw.rstrip()[-1:] in b".!?"),
        ]
    )


@dataclass(frozen=True)
class TreeParams:
    trees: int = 80
    depth: int = 4
    rate: float = 0.15
    bins: int = 64
    l2: float = 1.0
    min_rows: float = 5.0
    max_rows: int = 12_000


@dataclass(frozen=True)
class Trees:
    """Node k of a tree has children 2k+1 (value <= threshold) and 2k+2. An unsplit node sends all left."""

    feature: np.ndarray  # trees x (2^depth - 1)
    threshold: np.ndarray
    leaf: np.ndarray  # trees x 2^depth
    start: float | None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.start is None:
            return np.zeros(len(x))
        total, rows = np.full(len(x), self.start), np.arange(len(x))
        depth = int(np.log2(self.leaf.shape[1]))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += leaf[node - (leaf.size - 1)]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def train(x: np.ndarray, y: np.ndarray, p: TreeParams) -> Trees:
    inner, leaves = (1 << p.depth) - 1, 1 << p.depth
    if not len(y):
        return Trees(np.zeros((0, inner), np.int32), np.zeros((0, inner)), np.zeros((0, leaves)), None)
    f = x.shape[1]
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, p.bins + 1)[1:-1])) for j in range(f)]
    binned = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(f)], 1)  # value <= edges[b] iff bin <= b
    rate = np.clip(y.mean(), 0.01, 0.99)
    start = float(np.log(rate / (1 - rate)))
    total = np.full(len(y), start)
    offsets = np.arange(f) * p.bins
    out_f, out_t, out_l = [], [], []
    for _ in range(p.trees):
        prob = 1 / (1 + np.exp(-total))
        grad, hess = prob - y, np.maximum(prob * (1 - prob), 1e-9)
        feature, threshold, node = np.zeros(inner, np.int32), np.full(inner, np.inf), np.zeros(len(y), np.int64)
        for level in range(p.depth):
            first = (1 << level) - 1
            width = f * p.bins
            slot = ((node - first)[:, None] * width + offsets + binned).ravel()
            g, h, c = (np.bincount(slot, np.repeat(v, f), minlength=(1 << level) * width).reshape(-1, f, p.bins).cumsum(2) for v in (grad, hess, np.ones(len(y))))
            every = [v[:, :, -1:] for v in (g, h, c)]
            gain = g**2 / (h + p.l2) + (every[0] - g) ** 2 / (every[1] - h + p.l2) - every[0] ** 2 / (every[1] + p.l2)
            gain[(c < p.min_rows) | (every[2] - c < p.min_rows)] = 0
            best = gain.reshape(1 << level, -1).argmax(1)
            for k, at in enumerate(best):
                j, b = divmod(int(at), p.bins)
                if gain[k, j, b] > 1e-6 and b < len(edges[j]):
                    feature[first + k], threshold[first + k] = j, edges[j][b]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > threshold[node])
        at = node - inner
        leaf = -p.rate * np.bincount(at, grad, minlength=leaves) / (np.bincount(at, hess, minlength=leaves) + p.l2)
        total += leaf[at]
        out_f.append(feature)
        out_t.append(threshold)
        out_l.append(leaf)
    return Trees(np.array(out_f), np.array(out_t), np.array(out_l), start)


def training_rows(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, params: TreeParams) -> DataFrame:
    """doc_id, y, x (statistics): the bounded rows that are fitted, measured where they are."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            xs = [statistics(t.as_py()).tobytes() for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(xs, pa.binary())], ["doc_id", "y", "x"])

    sample = bounded_labels(labels, label, modulus, held_out, params.max_rows)
    return labelled_texts(docs, sample).mapInArrow(measure, "doc_id long, y int, x binary")


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", modulus: int = 3, held_out: int = 1, params: TreeParams = TreeParams()) -> Trees:
    """The bounded sample of labelled rows is fitted in one task."""

    def fit_one(t: pa.Table) -> pa.Table:
        t = t.sort_by([("doc_id", "ascending"), ("x", "ascending")])
        m = train(np.array([np.frombuffer(x.as_py()) for x in t.column("x")]), t.column("y").to_numpy(), params)
        return pa.table({"f": [m.feature.tobytes()], "t": [m.threshold.tobytes()], "l": [m.leaf.tobytes()], "start": [m.start]})

    rows = training_rows(docs, labels, label, modulus, held_out, params)
    got = rows.groupBy(F.lit(0).alias("_all")).applyInArrow(fit_one, "f binary, t binary, l binary, start double").first()
    if got is None:
        return train(np.zeros((0, 1)), np.zeros(0), params)
    inner = (1 << params.depth) - 1
    shaped = lambda raw, kind, n: np.frombuffer(raw, kind).reshape(-1, n)
    return Trees(shaped(got["f"], np.int32, inner), shaped(got["t"], np.float64, inner), shaped(got["l"], np.float64, inner + 1), got["start"])


def score_rows(docs: DataFrame, trees: Trees) -> DataFrame:
    """(doc_id, text) -> (doc_id, score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([statistics(t.as_py()) for t in b.column(1)]).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(trees.score(x))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    trees = fit(docs, read(spark, sf_dir, "labels"))
    return score_rows(docs, trees).select("doc_id", is_held_out(3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
