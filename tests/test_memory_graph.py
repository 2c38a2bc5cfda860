import itertools
import random

import numpy as np
import pytest

from provloom.operators import communities, features, fmg, incremental, predictor
from provloom.operators.graph import VOCABULARY

PGS = "pg_id string, start_ns long, end_ns long, candidate_start_ns long, candidate_end_ns long, left_split_boundary boolean, right_split_boundary boolean"


def packet(spark, i):
    """An interval with two nodes and one edge, one of three that a candidate was cut into."""
    pg = spark.createDataFrame([(f"p{i}", i * 10, i * 10 + 10, 0, 30, i > 0, i < 2)], PGS)
    members = spark.createDataFrame([(f"p{i}", n, f"d06:p{i}:c{k:05d}") for k, n in enumerate("ab")], "pg_id string, node_uuid string, community_id string")
    edges = spark.createDataFrame([(f"p{i}", "a", "b", "EVENT_WRITE", 1, 1, i * 10 + 1, i * 10 + 1, f"e{i}", 0, i + 1, i * 100)], "pg_id string, src_uuid string, dst_uuid string, event_type string, predicate_index int, event_count long, first_timestamp_ns long, last_timestamp_ns long, first_event_uuid string, first_raw_shard int, first_raw_line long, first_raw_offset long")
    return pg, members, fmg.witnesses(edges)


def test_insertion_in_any_order(spark):
    seen = set()
    for order in ((0, 1, 2), (2, 1, 0), (0, 2, 1)):
        state = None
        for i in order:
            state = incremental.insert(state, *packet(spark, i))
        kinds = sorted(r.edge_type for r in fmg.relations(state.witnesses()).collect())
        assert kinds == ["provenance_reachability"] * 3 + ["split_continuation"] * 4
        seen.add(incremental.signature(state))
    assert len(seen) == 1
    with pytest.raises(ValueError, match="already"):
        incremental.insert(state, *packet(spark, 1))
    pg, members, witness = packet(spark, 1)
    with pytest.raises(ValueError, match="overlap"):
        incremental.insert(incremental.insert(None, *packet(spark, 1)), pg.selectExpr("'other' pg_id", "start_ns + 5 start_ns", "end_ns + 5 end_ns", "candidate_start_ns", "candidate_end_ns", "left_split_boundary", "right_split_boundary"), members, witness)


def test_communities(spark):
    rng = random.Random(1)
    groups = [[f"{g}{i}" for i in range(8)] for g in "abc"]
    w = {tuple(sorted(p)): 1.0 for g in groups for p in itertools.combinations(g, 2) if rng.random() < 0.8}
    w[("a0", "b0")] = w[("b1", "c1")] = 0.2
    nodes = sum(groups, ["z"])
    got = communities.modularity(w, nodes)
    assert [len({got[n] for n in g}) for g in groups] == [1, 1, 1] and len(set(got.values())) == 4
    shuffled = list(w.items())
    rng.shuffle(shuffled)
    assert communities.modularity(dict(shuffled), rng.sample(nodes, len(nodes))) == got
    assert sorted(communities.modularity({}, ["x", "y"]).values()) == [0, 1]
    frame = spark.createDataFrame([("p", n) for n in nodes] + [("q", "lone")], "pg_id string, node_uuid string")
    edges = spark.createDataFrame([("p", *k, 3) for k in w], "pg_id string, src_uuid string, dst_uuid string, event_count long")
    rows = communities.modularity_communities(frame, edges).collect()
    assert len(rows) == len(nodes) + 1
    chain = spark.createDataFrame([("p", f"n{i:03d}", f"n{i + 1:03d}", 1) for i in range(60) if i != 30], "pg_id string, src_uuid string, dst_uuid string, event_count long")
    many = spark.createDataFrame([("p", f"n{i:03d}") for i in range(62)], "pg_id string, node_uuid string")
    labels = {r.node_uuid: r.label for r in communities.connected(many, chain).collect()}
    assert {labels[f"n{i:03d}"] for i in range(31)} == {0} and {labels[f"n{i:03d}"] for i in range(31, 61)} == {1} and labels["n061"] == 2


def test_signature_widths_and_masks():
    a = len(VOCABULARY)
    context, target = features.context_names(), features.target_names()
    assert len(context) == 32 + 2 * a and len(target) == a + 10 and len(features.feature_names()) == 13 + a
    groups, masks = predictor.signature_groups(context, target)
    assert [len(g) for g in groups] == [a, 3, 3, 4] and masks.shape == (4, len(context))
    assert (masks == 0).sum(axis=1).tolist() == [2 * a, 2 * a, 0, 2]
    with pytest.raises(ValueError):
        predictor.signature_groups(context, [*target, "odd"])


def test_predictor_learns_and_masks():
    rng = np.random.default_rng(0)
    context, target = features.context_names(), features.target_names()
    x = rng.random((2000, len(context)))
    y = np.stack([x[:, i % 10] * 0.5 + 0.1 for i in range(len(target))], axis=1)
    model = predictor.Predictor.new(context, target, 32)
    before = model.loss(model.predict(x), y)
    model.train(x, y, epochs=40, size=256, rate=1e-2)
    assert model.loss(model.predict(x), y) < before / 20
    other = x.copy()
    other[:, [i for i, n in enumerate(context) if n.startswith("incoming_relation")]] += 5
    p, q = model.predict(x), model.predict(other)
    assert np.allclose(p[:, model.groups[0] + model.groups[1]], q[:, model.groups[0] + model.groups[1]]) and not np.allclose(p[:, model.groups[2]], q[:, model.groups[2]])
    # gradients against differences
    small = predictor.Predictor.new(context, target, 4, seed=3)
    grads = small._gradients(x[:50], y[:50])
    for weights, grad in zip([*small.hidden, *(p for h in small.heads for p in h)], grads, strict=True):
        at = tuple(rng.integers(0, n) for n in weights.shape)
        old, step = weights[at], 1e-6
        weights[at] = old + step
        up = small.loss(small.predict(x[:50]), y[:50])
        weights[at] = old - step
        down = small.loss(small.predict(x[:50]), y[:50])
        weights[at] = old
        assert (up - down) / (2 * step) == pytest.approx(grad[at], rel=1e-3, abs=1e-8)


def test_connected_on_a_long_chain_in_any_order(spark):
    """The smallest of a chain's nodes is far from most: rounds of nearest labels do not reach them all in thirty."""
    order = np.random.default_rng(5).permutation(4000)
    names = [f"n{i:04d}" for i in order]
    nodes = spark.createDataFrame([(p, n) for p in "pq" for n in [*names, "alone"]], "pg_id string, node_uuid string")
    chain = [("p", a, b) for a, b in zip(names, names[1:], strict=False)] + [("q", b, a) for a, b in zip(names[:2000], names[1:2000], strict=False)] + [("q", "gone", "alone")]
    rows = communities.connected(nodes, spark.createDataFrame([(*c, 1) for c in chain], "pg_id string, src_uuid string, dst_uuid string, event_count long")).collect()
    label = {(r.pg_id, r.node_uuid): r.label for r in rows}
    assert len(rows) == len(label) == 8002 and {label["p", n] for n in names} == {1} and label["p", "alone"] == label["q", "alone"] == 0
    lone = sorted(names[2000:])
    first = min(names[:2000])
    want = {n: 1 + i for i, n in enumerate(sorted([*lone, first]))}
    assert all(label["q", n] == want[n] for n in lone) and {label["q", n] for n in names[:2000]} == {want[first]}
