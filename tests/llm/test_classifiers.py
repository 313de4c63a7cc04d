"""The bounds of the fits, features against plain code, splits against brute force."""

import numpy as np
import pytest
import xxhash

from foliospark.llm import common, quality, toxicity

ROWS = [(7, f"text number {i} of many") for i in range(5_000)] + [(8, "another text"), (9, "not labelled"), (None, "x")]
LABELS = [(7, 1, 1), (8, 0, 0), (8, 0, 0), (10, 1, 1)]


def tables(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string").repartition(6), spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("module,label,params", [(toxicity, "toxic", toxicity.FtrlParams()), (quality, "quality", quality.TreeParams())])
def test_one_row_of_a_labelled_id_is_fitted(spark, module, label, params):
    """5,000 rows of one labelled id: the fit gets one of them, the same in every run and order of rows."""
    docs, labels = tables(spark)
    first = sorted((r.doc_id, r.y, bytes(r.x)) for r in module.training_rows(docs, labels, label, 997, 5, params).collect())
    again = sorted((r.doc_id, r.y, bytes(r.x)) for r in module.training_rows(docs.repartition(2), labels, label, 997, 5, params).collect())
    assert [r[:2] for r in first] == [(7, 1), (8, 0)] and first == again


def test_features_of_a_fit_are_bounded(spark):
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(40))) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id long, toxic int")
    every = toxicity.training_rows(docs, labels, "toxic", 997, -1, toxicity.FtrlParams()).collect()
    assert len(every) == 50
    most = sum(r.n for r in every) // 3
    some = toxicity.training_rows(docs, labels, "toxic", 997, -1, toxicity.FtrlParams(max_features=most)).collect()
    assert 10 < len(some) < 20 and sum(r.n for r in some) <= most
    few = toxicity.training_rows(docs, labels, "toxic", 997, -1, toxicity.FtrlParams(max_rows=4)).collect()
    assert len(few) == 4 and {r.doc_id for r in few} <= {r.doc_id for r in some}
    assert toxicity.fit(docs, labels, params=toxicity.FtrlParams(max_features=1)).bias is None  # nothing fits: every score is 0


def test_within_keeps_the_first_by_hash(spark):
    rows = spark.createDataFrame([(i, 10) for i in range(9)], "doc_id long, size long")
    kept = {r.doc_id for r in common.within(rows, "size", 45).collect()}
    order = [r.doc_id for r in rows.orderBy(common.F.xxhash64("doc_id")).collect()]
    assert kept == set(order[:4])


def plain_features(text, bits):
    """Words, stems, pairs and skips one at a time, in whole numbers modulo 2^64."""
    mask = (1 << 64) - 1
    words = toxicity.TOKEN.findall((text or "").lower())
    h = lambda w: xxhash.xxh3_64_intdigest(w.encode())
    odd = [int(x) for x in toxicity.ODD]
    raw = {h(w) * odd[3] & mask for w in words} | {h(w[:n] + "*") for w in words for n in toxicity.STEMS if len(w) > n}
    raw |= {(h(a) * odd[0] + h(b) * odd[1]) & mask for a, b in zip(words, words[1:])}
    raw |= {(h(a) * odd[2] + h(b) * odd[3]) & mask for a, b in zip(words, words[2:])}
    return sorted({((x ^ x >> 29) * odd[0] & mask) >> (64 - bits) for x in raw})


@pytest.mark.parametrize("text", [None, "", "one", "one two", "One two, TWO three-four four", "Übermäßig schöne Grüße " * 5, "a_b c1 2d", "x " * 300 + "end"])
@pytest.mark.parametrize("bits", [8, 20])
def test_features_equal_plain_code(text, bits):
    assert toxicity.features(text, toxicity.Hashes(), bits).tolist() == plain_features(text, bits)


@pytest.mark.parametrize("seed", range(4))
def test_splits_equal_brute_force(seed):
    """Every node of every tree against all thresholds of all features, and every leaf against its rows."""
    r = np.random.default_rng(seed)
    x = np.round(r.normal(size=(240, 5)), 1)
    y = ((x[:, 0] > 0.2) ^ (x[:, 3] < -0.4) ^ (r.random(240) < 0.1)).astype(int)
    p = quality.TreeParams(trees=3, depth=3, bins=16)
    trees = quality.train(x, y, p)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, p.bins + 1)[1:-1])) for j in range(5)]
    inner = trees.feature.shape[1]
    total, split = np.full(len(y), trees.start), 0
    for k in range(p.trees):
        prob = 1 / (1 + np.exp(-total))
        grad, hess = prob - y, np.maximum(prob * (1 - prob), 1e-9)
        score = lambda rows: grad[rows].sum() ** 2 / (hess[rows].sum() + p.l2)

        def gain(rows, j, t):
            left, right = rows & (x[:, j] <= t), rows & (x[:, j] > t)
            return score(left) + score(right) - score(rows) if min(left.sum(), right.sum()) >= p.min_rows else 0.0

        here = {0: np.ones(len(y), bool)}
        for node in range(inner):
            rows, j, t = here[node], int(trees.feature[k][node]), trees.threshold[k][node]
            best = max(gain(rows, i, e) for i in range(5) for e in edges[i])
            if np.isinf(t):
                assert best <= 1e-6 + 1e-9
            else:
                assert t in edges[j] and gain(rows, j, t) == pytest.approx(best, abs=1e-9)
                split += 1
            here[2 * node + 1], here[2 * node + 2] = rows & (x[:, j] <= t), rows & (x[:, j] > t)
        for leaf in range(inner + 1):
            rows = here[inner + leaf]
            value = -p.rate * grad[rows].sum() / (hess[rows].sum() + p.l2)
            assert trees.leaf[k][leaf] == pytest.approx(value)
            total[rows] += value
    assert split > 8 and np.allclose(trees.score(x), 1 / (1 + np.exp(-total)))
