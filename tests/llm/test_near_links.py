"""Links of rows that share one whole fingerprint and differ only in their other bits."""

import random

import numpy as np
import pytest

from provloom.llm import simhash


def test_no_grid_over_all_rows_of_one_fingerprint(monkeypatch):
    monkeypatch.setattr(simhash, "GRID_PAIRS", 100)
    grid, largest = simhash._grid, []
    monkeypatch.setattr(simhash, "_grid", lambda na, nb: largest.append(int((na * nb).sum())) or grid(na, nb))
    rng = np.random.default_rng(1)
    n = 300
    of = np.sort(rng.integers(0, 6, n))
    zero = np.zeros(n, np.int64)
    for group in (of, np.arange(n), np.zeros(n, np.int64)):
        largest.clear()
        got = [p for x, y in simhash.trie_pairs(zero, zero, zero.view(np.uint64), 3, 32, group) for p in zip(x.tolist(), y.tolist(), strict=True)]
        want = [(i, j) for i in range(n) for j in range(i + 1, n) if group[i] != group[j]]
        assert sorted(got) == want and max(largest, default=0) <= 400
    assert not largest  # one group only: nothing to look at


def test_hot_fingerprint_is_dealt_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "NODE_ROWS", 60)
    made = []
    arrow_map = simhash.arrow_map
    monkeypatch.setattr(simhash, "arrow_map", lambda df, *a: made.append(df) or arrow_map(df, *a))
    rng = random.Random(1)
    centre = [rng.getrandbits(63) for _ in range(8)]
    rows = []
    for i in range(300):
        c = rng.choice(centre) ^ (1 << rng.randrange(63)) ^ (1 << rng.randrange(63))
        rows.append((i, (7 << 32) ^ ((i % 5 == 0) << 33), c, i % 7 if i < 200 else 7))
    points = spark.createDataFrame(rows, "id long, fp long, c long, g long")
    got = [tuple(sorted((r.a, r.b))) for r in simhash.near_links(points, 32, 3, (simhash.F.col("fp"),), ("c",), 3, thinned=False, group="g").collect()]
    want = {(i, j) for i, p in enumerate(rows) for j, q in enumerate(rows) if i < j and (p[2] ^ q[2]).bit_count() <= 3 and p[3] != q[3]}
    assert set(got) == want and want
    assert made[-1].groupBy("k").count().agg({"count": "max"}).first()[0] <= 150


@pytest.mark.parametrize("most", [60, 1])  # dealt into blocks; opened, then dealt
def test_large_node_is_copied_as_little_as_can_be(spark, monkeypatch, most):
    monkeypatch.setattr(simhash, "NODE_ROWS", most)
    made = []
    arrow_map = simhash.arrow_map
    monkeypatch.setattr(simhash, "arrow_map", lambda df, *a: made.append(df) or arrow_map(df, *a))
    rng = random.Random(2)
    centre = [rng.getrandbits(24) for _ in range(40)]
    rows = [(i, (5 << 56) | ((rng.choice(centre) ^ (1 << rng.randrange(24)) ^ (1 << rng.randrange(24))) << 32)) for i in range(300)]
    points = spark.createDataFrame(rows, "id long, fp long")
    got = {tuple(sorted((r.a, r.b))) for r in simhash.near_links(points, 32, 3, thinned=False).collect()}
    assert got == {(i, j) for i, p in enumerate(rows) for j, q in enumerate(rows) if i < j and (p[1] ^ q[1]).bit_count() <= 3}
    assert most == 1 or made[-1].count() <= 300 * (10 + 3)


def test_rows_of_a_text_in_a_corpus_of_6_gb(spark, monkeypatch):
    """Two and a half million texts: each is no more rows in the tasks, and no wider ones, than in a small corpus."""
    bits, errors, tables, words = simhash.plan_similar(2_500_000)
    assert tables * (errors + 1) <= 40 and words <= 5
    wide = []
    near_links = simhash.near_links
    monkeypatch.setattr(simhash, "near_links", lambda points, bits, budget, fps, checks, *a, **k: wide.append(len(checks)) or near_links(points, bits, budget, fps, checks, *a, **k))
    monkeypatch.setattr(simhash, "PLANS", ((2**63, 48, 4, 21),))
    text = " ".join(f"w{i}" for i in range(200))
    docs = spark.createDataFrame([(1, text), (2, text + " more"), (3, "other")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in simhash.similar_groups(docs).collect()} == {1: 1, 2: 1, 3: 3} and wide == [5]
