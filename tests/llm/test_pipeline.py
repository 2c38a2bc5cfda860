"""Stages of the pipeline: rows, not ids, go; each stage against a plain version."""

import collections
import itertools
import random
from fractions import Fraction

import corpus_pipeline
import numpy as np
import pytest

from provloom.llm import common, simhash, toxicity

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, n_removed string, row_at int, doc_ID_2 string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "keep", 3, "x") for i, t in rows], SCHEMA).repartition(3)


def stage(spark, name, docs):
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, SF)
    assert out.columns == docs.columns
    return sorted((r.doc_id if r.doc_id is not None else -1, r.text) for r in out.collect())


def test_exact_copies_go_row_by_row(spark):
    rows = [(7, "dup"), (7, "dup"), (9, "q"), (5, "q"), (5, "only here"), (None, "n"), (None, "n"), (3, "Q"), (4, ""), (6, "")]
    assert stage(spark, "exact_dedup", frame(spark, rows)) == [(-1, "n"), (5, "only here"), (6, ""), (7, "dup"), (9, "q")]
    nulls = [(1, None), (2, None)]
    assert [i for i, _ in stage(spark, "exact_dedup", frame(spark, nulls))] == [2]
    for name in ("exact_dedup", "near_dedup", "substring_dedup"):
        assert stage(spark, name, frame(spark, [(1, "a")]).where("false")) == []


def plain_groups(texts):
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(texts)), 2):
        union = len(sets[i] | sets[j])
        if not union or Fraction(len(sets[i] & sets[j]), union) >= Fraction(8, 10):
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def test_near_copies_go_row_by_row(spark):
    """Repeated ids, null ids, a family of copies in which each text has many near ones, and texts close to it that are not."""
    rng = random.Random(5)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    base = words(300)

    def copy(changes):
        out = list(base)
        for at in rng.sample(range(300), changes):
            out[at] = "x" + out[at]
        return " ".join(out)

    texts = [" ".join(base), *(copy(rng.choice([1, 2, 3, 5, 8, 14, 25])) for _ in range(90)), *(" ".join(words(40)) for _ in range(10)), "", None, "one two"]
    ids = [i % 60 for i in range(len(texts))]
    ids[4] = None
    root = plain_groups(texts)
    first = {}
    for k, (i, r) in enumerate(zip(ids, root, strict=True)):
        key = (2**63 if i is None else i, k)
        first[r] = min(first.get(r, key), key)
    got = stage(spark, "near_dedup", frame(spark, list(zip(ids, texts, strict=True))))
    assert len(got) == len(set(root)) and collections.Counter(i for i, _ in got) == collections.Counter(-1 if k[0] == 2**63 else k[0] for k in first.values())


@pytest.mark.parametrize("size", [2000, 16_000_000])
def test_families_against_brute_force(spark, monkeypatch, size):
    """Sets of one family in several blocks and squares: all that are similar are joined, groups are not compared with themselves."""
    monkeypatch.setattr(simhash, "COMPARE_BYTES", size)
    monkeypatch.setattr(simhash, "COMPARE_ROWS", 7)
    monkeypatch.setattr(simhash, "COMPARE_COLUMNS", 16)
    rng = np.random.default_rng(3)
    base = [rng.integers(0, 2**62, 30) for _ in range(4)]
    sets = []
    for _ in range(80):
        s = base[rng.integers(0, 4)].copy()
        s[rng.permutation(30)[: rng.integers(0, 7)]] = rng.integers(0, 2**62)
        sets.append(np.unique(s))
    rows = [(i % 2, 1000 + i // 3 if i < 20 else i, i, s.tolist()) for i, s in enumerate(sets)]
    links = [(r.a, r.b) for r in simhash.compared(spark.createDataFrame(rows, "family long, group long, id long, s array<long>")).collect()]
    near = {(i, j) for i, j in itertools.combinations(range(80), 2) if i % 2 == j % 2 and rows[i][1] != rows[j][1] and 10 * len(set(sets[i]) & set(sets[j])) >= 8 * len(set(sets[i]) | set(sets[j]))}

    def parts(edges):
        root = {i: i for i in range(80)}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in edges:
            root[max(find(a), find(b))] = min(find(a), find(b))
        return [find(i) for i in range(80)]

    own = [(min(j for j in range(20) if rows[j][1] == rows[i][1]), i) for i in range(20)]
    assert parts([*links, *own]) == parts([*near, *own])


def test_plans_grow_with_the_table():
    assert simhash.plan_similar(1000) == (32, 3, 10, 5)
    assert simhash.plan_similar(10**8) == (48, 4, 21, 21) and simhash.plan_similar(10**11) == (64, 5, 45, 45)


def test_longer_fingerprints_find_the_same(spark, monkeypatch):
    rng = random.Random(9)
    texts = []
    for i in range(40):
        w = [f"w{rng.randrange(10**6)}" for _ in range(300)]
        copy = list(w)
        for at in range(1 + i % 5):
            copy[10 + at * 50] = "x"
        texts += [" ".join(w), " ".join(copy)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = plain_groups(texts)
    for plan in (simhash.PLANS[1], simhash.PLANS[2]):
        monkeypatch.setattr(simhash, "PLANS", ((2**63, *plan[1:]),))
        got = {r.doc_id: r.component_id for r in simhash.similar_groups(docs).collect()}
        assert np.mean([got[i] == want[i] for i in range(len(texts))]) >= 0.97


def test_stages_on_a_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    columns, n = docs.columns, docs.count()
    for name, fn in corpus_pipeline.STAGES[:-1]:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        scores = {r.doc_id: r.predicted for r in toxicity.score_documents(docs, labels).collect()} if name == "toxicity" else {}
        docs = corpus_pipeline.stored(fn(spark, docs, SF))
        after = {r.doc_id: r.text for r in docs.collect()}
        assert docs.columns == columns and n * 0.7 <= len(after) <= n, name
        n = len(after)
        if name == "toxicity":
            assert set(after) == {i for i, _ in before if not scores[i]}
        elif name == "exact_dedup":
            last = {}
            for i, t in before:
                last[(t or "").lower()] = max(last.get((t or "").lower(), i), i)
            assert set(after) == set(last.values())
        elif name == "near_dedup":
            before.sort()
            root = plain_groups([t for _, t in before])
            want = {before[r][0] for r in root}
            assert want <= set(after) and len(set(after) - want) <= 0.03 * len(before)  # a pair close to 0.8 may be missed, no clean text goes
        else:
            first = {}
            k = corpus_pipeline.PASSAGE
            split = {i: (t or "").encode().split() for i, t in before}
            for i in sorted(split):
                for j in range(len(split[i]) - k + 1):
                    first.setdefault(tuple(split[i][j : j + k]), i)
            for i, w in split.items():
                go = [False] * len(w)
                for j in range(len(w) - k + 1):
                    if first[tuple(w[j : j + k])] < i:
                        go[j : j + k] = [True] * k
                assert (after[i] or "").encode().split() == [x for x, g in zip(w, go, strict=True) if not g]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).select("doc_id").distinct().count() == n


def test_run_frees_its_tables(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0 and not common._open
