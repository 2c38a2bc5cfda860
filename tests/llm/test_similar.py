"""similar_groups against exact Jaccard similarities of the sets of five-word shingles."""

import itertools
import random
from fractions import Fraction

from provloom.llm import simhash


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def exact(texts):
    """Pairs of positions with their similarity, from 0.5 on."""
    sets = [shingles(t) for t in texts]
    out = {}
    for i, j in itertools.combinations(range(len(texts)), 2):
        both = len(sets[i] & sets[j])
        union = len(sets[i] | sets[j])
        if not union or 2 * both >= union:
            out[i, j] = Fraction(both, union) if union else Fraction(1)
    return out


def linked(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    root = {r.doc_id: r.component_id for r in simhash.similar_groups(docs).collect()}
    assert sorted(root) == list(range(len(texts)))
    return root


def words(rng, n):
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


def test_repeated_lines(spark):
    rng = random.Random(6)
    line = words(rng, 24)
    own = [words(rng, 404) for _ in range(3)]
    hot = [" ".join(o + line * 20) for o in own[:2]]  # nearly all shingles in common if repeats count
    pad = words(rng, 4)
    once, often = (" ".join(own[2] + (pad + line) * n) for n in (2, 20))
    texts = [*hot, once, often, "", " \n", None, "one", "One", "two"]
    near = exact(texts)
    assert (0, 1) not in near and near[2, 3] == 1
    root = linked(spark, texts)
    assert [root[i] for i in range(len(texts))] == [0, 1, 2, 2, 4, 4, 4, 7, 7, 9]


def test_pairs_close_to_the_bound(spark):
    """Single copies at similarities of 0.75 to 0.9: none under 0.8 is linked, and nearly all from 0.8 on are."""
    rng = random.Random(8)
    texts = []
    for i in range(240):
        w = words(rng, 600)
        copy = list(w)
        cut = 9 + i % 9  # words replaced far apart: five shingles each
        for at in range(cut):
            copy[10 + at * 33] = "x" + copy[10 + at * 33]
        texts += [" ".join(w), " ".join(copy)]
    near = exact(texts)
    assert len(near) == 240 and min(near.values()) < Fraction(78, 100) and sum(v >= Fraction(8, 10) for v in near.values()) > 100
    root = linked(spark, texts)
    true = [p for p, v in near.items() if v >= Fraction(8, 10)]
    close = [p for p in true if near[p] < Fraction(85, 100)]
    false = [(i, r) for i, r in root.items() if r != i and (r, i) not in true]
    recall = lambda pairs: sum(root[j] == root[i] for i, j in pairs) / len(pairs)
    print(f"recall {recall(true):.3f} of {len(true)}, at 0.80-0.85 {recall(close):.3f} of {len(close)}, false links {len(false)}")
    assert not false and recall(true) >= 0.97 and recall(close) >= 0.93
