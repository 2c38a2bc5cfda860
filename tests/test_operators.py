import pytest

from provloom.operators import graph, scoring


def test_self_loops_stay_in_edges_and_go_in_compression(spark):
    ev = spark.createDataFrame([("e1", 10, "EVENT_READ", "object_to_subject", "a", "b", None, 1, 100), ("e2", 20, "EVENT_WRITE", "subject_to_object", "a", "a", "b", 2, 200)], "event_uuid string, timestamp_ns long, event_type string, flow_direction string, subject_uuid string, predicate_uuid string, predicate2_uuid string, raw_line long, raw_offset long")
    got = graph.edges(ev)
    assert sorted((r.src_uuid, r.dst_uuid, r.predicate_index) for r in got.collect()) == [("a", "a", 1), ("a", "b", 2), ("b", "a", 1)]
    assert {(r.src_role, r.dst_role) for r in got.collect()} == {("predicate1", "subject"), ("subject", "predicate1"), ("subject", "predicate2")}
    assert graph.compress(got).count() == 2


def test_first_evidence_is_the_earliest(spark):
    ev = spark.createDataFrame([("x", 20, 2, 2), ("y", 10, 3, 3)], "event_uuid string, timestamp_ns long, raw_line long, raw_offset long").selectExpr("*", "'EVENT_READ' event_type", "'b' src_uuid", "'a' dst_uuid", "0 predicate_index")
    (r,) = graph.compress(ev).collect()
    assert (r.event_count, r.first_timestamp_ns, r.first_event_uuid, r.first_raw_offset) == (2, 10, "y", 3)


def test_definitions_collapse(spark):
    d = spark.createDataFrame([("a", "Subject", None, 3), ("a", "Subject", "SUBJECT_PROCESS", 5), ("n", "NetFlowObject", None, 1), ("z", "Odd", None, 1)], "node_uuid string, record_type string, subtype string, raw_line long")
    assert {(r.node_uuid, r.definition_count, r.entity_type, r.entity_type_id) for r in graph.node_types(d).collect()} == {("a", 2, "SUBJECT_PROCESS", 0), ("n", 1, "NET_FLOW", 4), ("z", 1, "UNKNOWN", 9)}


def test_nodes_of_two_record_types_raise(spark):
    d = spark.createDataFrame([("a", "Subject", None, 1, 5), ("a", "Subject", "SUBJECT_PROCESS", 0, 9), (None, "FileObject", None, 0, 1)], "node_uuid string, record_type string, subtype string, raw_shard int, raw_line long")
    assert [(r.node_uuid, r.definition_count) for r in graph.node_types(d).collect()] == [("a", 2)]
    with pytest.raises(Exception, match="conflicting record types"):
        graph.node_types(d.unionByName(d.selectExpr("'a' as node_uuid", "'FileObject' as record_type", "subtype", "raw_shard", "raw_line"))).collect()


def test_gaps_over_slices(spark):
    import random

    rng = random.Random(3)
    rows = [(f"n{i % 5}", rng.randrange(40 * 3_600_000_000_000), "EVENT_READ", "subject") for i in range(400)] + [("one", 7, "EVENT_READ", "subject")]
    got = {r.node_uuid: r.max_gap_ns for r in graph.longest_gaps(spark.createDataFrame(rows, "node_uuid string, timestamp_ns long, event_type string, role string")).collect()}
    for n in got:
        t = sorted(x[1] for x in rows if x[0] == n)
        assert got[n] == max((b - a for a, b in zip(t, t[1:], strict=False)), default=0)


def test_percentiles_in_buckets(spark, monkeypatch):
    import random

    monkeypatch.setattr(scoring, "BUCKETS", 7)
    rng = random.Random(4)
    ref = [(rng.choice("ab"), float(rng.randrange(30))) for _ in range(300)]
    ask = [(rng.choice("abc"), float(rng.randrange(-2, 33)), i) for i in range(200)] + [("a", None, 999)]
    got = scoring.empirical_percentile(spark.createDataFrame(ref, "k string, score double"), spark.createDataFrame(ask, "k string, score double, i int"), "k").collect()
    assert len(got) == len(ask)
    for r in got:
        mine = [s for k, s in ref if k == r.k]
        assert r.q == (sum(s <= r.score for s in mine) / len(mine) if mine and r.score is not None else None)


def test_evidence_is_validated(spark):
    rows = lambda *x: spark.createDataFrame(x, "pg_id string, entity_id string, percentile double, stable_tie_id string")
    got = scoring.select_evidence(rows(("p", "a", 0.99, "2"), ("p", "b", 0.99, "1"), ("p", "c", 0.96, "0"), ("p", "d", 0.2, "0"), ("q", "a", 0.1, "0")), 0.95, 0.98, 5, 0.5).collect()
    assert [(r.entity_id, r.role, r.rank_within_pg, r.pg_budget) for r in sorted(got, key=lambda r: r.rank_within_pg)] == [("b", "anchor", 1, 2), ("a", "anchor", 2, 2)]
    for bad in (rows(("p", "a", 0.5, ""), ("p", "a", 0.6, "")), rows(("p", "a", 1.5, "")), rows(("p", "a", None, ""))):
        with pytest.raises(Exception, match="entity twice|out of range"):
            scoring.select_evidence(bad, 0.95, 0.99, 5, 0.5).collect()
    for settings in ((0.95, 0.9, 5, 0.5), (1.2, 1.3, 5, 0.5), (0.5, 0.9, 0, 0.5), (0.5, 0.9, 5, 0.0)):
        with pytest.raises(ValueError):
            scoring.select_evidence(rows(("p", "a", 0.5, "")), *settings)
