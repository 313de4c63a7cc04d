"""Pages of one template, alike but below the similarity: links stay exact and the work follows their number."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliospark.llm import neardup
from tests.llm.test_llm import brute_components

TEMPLATE = " ".join(f"t{i}" for i in range(240))


def pages(n, seed, own=56):
    draw = random.Random(seed)
    return [f"{TEMPLATE} {' '.join(f'o{draw.randrange(10**9)}' for _ in range(own))}" for _ in range(n)]


def with_links(texts, seed):
    """Copies with a few words changed, at either side of the similarity, and shorter ones."""
    draw = random.Random(seed)
    out = list(texts)
    for t in texts[:: max(1, len(texts) // 25)]:
        for changed in (1, 4, 9, 14):
            w = t.split()
            for _ in range(changed):
                w[draw.randrange(len(w))] = f"c{draw.randrange(10**9)}"
            out.append(" ".join(w[: draw.choice([len(w), len(w) - 20, len(w) - 45])]))
    return out


@pytest.fixture
def counted(monkeypatch):
    """Rows that were dealt to tasks of blocks."""
    rows, plain = [], neardup.dealt

    def deal(members):
        out = plain(members)
        rows.append(out.count())
        return out

    monkeypatch.setattr(neardup, "dealt", deal)
    return rows


@pytest.mark.parametrize("block,small", [(16, 8), (40, 2), (16, 2)])
def test_template_pages_equal_brute_force(spark, monkeypatch, block, small):
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "SMALL", small)
    monkeypatch.setattr(neardup, "CROWD", block)
    docs = list(enumerate(with_links(pages(150, 1), 2)))
    got = neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    want = {k: v[1] for k, v in brute_components(docs).items()}
    assert {r.doc_id: r.component_id for r in got} == want
    assert 20 < len(set(want.values())) < len(docs)


def test_template_pages_deal_rows_in_proportion(spark, counted):
    """5,000 pages at similarity 0.68: bucket by bucket they would deal some 183,000 rows, 1,250 some 26,000."""
    for n in (1250, 5000):
        counted.clear()
        docs = spark.createDataFrame(list(enumerate(pages(n, 3))), "doc_id long, text string").repartition(8)
        assert neardup.near_duplicates(docs).where("NOT kept").count() == 0
        assert sum(counted) <= 2 * n


def test_copies_of_template_pages_are_found_among_many(spark, counted):
    texts = pages(2500, 4)
    words = texts[7].split()
    near = [" ".join([*words[:-k], *[f"n{i}{k}" for i in range(k)]]) for k in range(1, 9)]  # one group of copies
    docs = spark.createDataFrame(list(enumerate(texts + near * 3)), "doc_id long, text string").repartition(8)
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs).collect()}
    assert {i for i, c in got.items() if c == 7} == {7, *range(2500, 2524)}
    assert all(got[i] == i for i in range(2500) if i != 7)
    assert sum(counted) <= 2 * len(got)


@pytest.mark.parametrize("percent", [80, 90])
def test_prefixes_of_linked_sets_meet(percent):
    """For random pairs at or over the similarity, whatever the order, the smaller's prefix meets the larger's."""
    draw, seen = np.random.default_rng(percent), 0
    for _ in range(9000):
        n, extra, gone = draw.integers(1, 60), draw.integers(0, 12), draw.integers(0, 12)
        x = np.unique(draw.integers(0, 1 << 40, n))
        y = np.unique(np.concatenate((x[gone:], draw.integers(1 << 41, 1 << 42, extra))))
        if not len(y):
            continue
        both = len(np.intersect1d(x, y))
        if 100 * both < percent * (len(x) + len(y) - both):
            continue
        seen += 1
        a, b = sorted((x, y), key=len)
        order = draw.permutation(np.union1d(x, y))
        rank = {v: k for k, v in enumerate(order.tolist())}
        small, large = neardup.prefix_lengths(len(a), percent)[0], neardup.prefix_lengths(len(b), percent)[1]
        first = lambda s, k: set(sorted(s.tolist(), key=rank.__getitem__)[:k])
        assert first(a, small) & first(b, large)
    assert seen > 300


def test_marked_rows_take_the_strays_part(spark):
    """All pairs of different components with a marked row meet, and few rows are dealt."""
    rows = spark.range(1200).select(F.lit(3).cast("long").alias("band"), "id", (F.col("id") % 1000).alias("component"), (F.col("id") % 400 == 0).alias("first"))
    got = neardup.dealt(rows).collect()
    assert len(got) <= 1200 + 3 * (1200 // neardup.BLOCK + 2)
    met = set()
    tasks = {}
    for r in got:
        tasks.setdefault((r.kind, r.i, r.j), []).append(r)
    for t in tasks.values():
        marked = [r for r in t if r["first"]]
        met |= {frozenset((a.id, b.id)) for a in marked for b in t if a.component != b.component}
    assert met == {frozenset((a, b)) for a in (0, 400, 800) for b in range(1200) if a % 1000 != b % 1000}
