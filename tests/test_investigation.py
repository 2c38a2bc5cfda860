import hashlib
import itertools
import random

import numpy as np
import pytest

from provloom.operators import control, evaluation, ledger, residual, traversal


def edges(spark, rows):
    return spark.createDataFrame([("g", s, d, t, 0, ts, f"e{ts}") for s, d, t, ts in rows], "pg_id string, src_uuid string, dst_uuid string, event_type string, predicate_index int, first_timestamp_ns long, first_event_uuid string")


GRAPH = [("a", "b", "R", 1), ("a", "b", "W", 2), ("a", "c", "R", 3), ("d", "a", "R", 4), ("b", "e", "R", 5), ("f", "d", "W", 6)]


def seeds(spark, types=()):
    return spark.createDataFrame([("g", "a", list(types))], "pg_id string, node_uuid string, event_types array<string>")


def test_breadth_first(spark):
    got = traversal.bounded_search(edges(spark, GRAPH), seeds(spark), hops=2, budget=40).orderBy("position").collect()
    assert [(r.first_timestamp_ns, r.traversal_direction, r.hop) for r in got] == [(1, "forward", 1), (2, "forward", 1), (3, "forward", 1), (4, "backward", 1), (5, "forward", 2), (6, "backward", 2)]
    assert traversal.bounded_search(edges(spark, GRAPH), seeds(spark), 2, 4).count() == 4
    with pytest.raises(ValueError):
        traversal.bounded_search(edges(spark, GRAPH), seeds(spark), 0, 4)


def test_neighbours_first(spark):
    got = traversal.neighbor_cover(edges(spark, GRAPH), seeds(spark, ["W"]), hops=2).orderBy("position").collect()
    assert [r.first_timestamp_ns for r in got] == [2, 3, 4, 1, 5, 6]
    few = traversal.neighbor_cover(edges(spark, GRAPH), seeds(spark, ["W"]), hops=2, budget=5).orderBy("position").collect()
    assert [r.first_timestamp_ns for r in few] == [2, 3, 4, 1, 5]  # the search that fills is cut at five edges as well


def test_context(spark):
    q = spark.createDataFrame([("g", "c", 0.9), ("g", "b", 0.1)], "pg_id string, node_uuid string, q double")
    got = traversal.bounded_context(edges(spark, GRAPH), seeds(spark, ["W"]), q, 5).orderBy("position").collect()
    assert [r.first_timestamp_ns for r in got] == [4, 2, 3, 1, 5]


def test_assignment_against_all_permutations():
    r = random.Random(4)
    for n, m in ((1, 1), (2, 4), (3, 3), (4, 6)):
        w = [[r.randrange(9) for _ in range(m)] for _ in range(n)]
        best = max(sum(w[i][c] for i, c in enumerate(p)) for p in itertools.permutations(range(m), n))
        got = evaluation.assign(w)
        assert len(set(got)) == n and sum(w[i][c] for i, c in enumerate(got)) == best


def test_jaccard_counts_unmatched_as_zero(spark):
    g = lambda *x: spark.createDataFrame(x, "run string, graph_id string, start_ns long, end_ns long")
    s = lambda *x: spark.createDataFrame(x, "run string, graph_id string, item string")
    n = [("r", "t1", "a"), ("r", "t1", "b"), ("r", "t2", "z")], [("r", "p1", "a"), ("r", "p1", "c")]
    (out,) = evaluation.graph_jaccard(g(("r", "t1", 0, 10), ("r", "t2", 0, 10)), g(("r", "p1", 5, 20)), s(*n[0]), s(*n[1]), s(("r", "t1", "ab")), s(("r", "p1", "ab"))).collect()
    assert (out.n_matched, out.node_jaccard, out.edge_jaccard) == (1, pytest.approx(1 / 6), pytest.approx(0.5))


def test_ledger_chain(spark):
    book = ledger.Ledger(["c2", "c1"])
    book.append("gap_opened", "lead", 1, {"gap_id": "g"})
    book.append("bridge_query_issued", "lead", 1, {"gap_id": "g"})
    book.append("bridge_candidate_retrieved", "tool", 1, {"candidate_id": "k"})
    book.append("bridge_candidate_accepted", "lead", 1, {"candidate_id": "k", "gap_id": "g", "community_path": ["c3"], "edge_path": ["e"]})
    assert (book.state["backbone_community_ids"], book.state["open_gaps"], book.state["next_action"]) == (["c1", "c2", "c3"], {}, "inspect_frontier")
    assert ledger.Ledger(["c1", "c2"], book.entries).state == book.state
    with pytest.raises(ValueError):
        ledger.Ledger(["c1"], book.entries)
    for kind, p in (("bridge_query_issued", {"gap_id": "no"}), ("bridge_candidate_accepted", {"candidate_id": "no"}), ("odd", {})):
        with pytest.raises(ValueError):
            book.append(kind, "lead", 2, p)


def test_shrinkage_against_its_definition(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((60, 3)) * [1, 2, 3] + 5
    rows = spark.createDataFrame([(i % 2, v.tolist()) for i, v in enumerate(x)], "entity_type_id int, residual array<double>").repartition(3)
    models = residual.shrinkage_models(rows, n_min=30, pooled=True)
    assert set(models) == {-1, 0, 1}
    c = x - x.mean(axis=0)
    cov = c.T @ c / 60
    level = np.trace(cov) / 3
    spread = np.linalg.norm(cov - level * np.eye(3)) ** 2
    weight = min(1, sum(np.linalg.norm(np.outer(v, v) - cov) ** 2 for v in c) / 60**2 / spread)
    assert np.allclose(np.linalg.inv(models[-1]["precision"]), (1 - weight) * cov + weight * level * np.eye(3))
    got = residual.calibrated(rows, rows, models, n_min=30).collect()
    assert len(got) == 60 and max(r.q for r in got) == 1 and all(r.score == pytest.approx(sum(r.contributions)) for r in got)
    with pytest.raises(Exception, match="no model"):
        residual.quadratic_scores(rows, {0: models[0]}, fallback=False).collect()


def test_scope_assessment(spark):
    ent = spark.createDataFrame([("x", "NET_FLOW", True, 80), ("p", "SUBJECT_PROCESS", False, None), ("f", "FILE_OBJECT_FILE", False, None), ("q", "SUBJECT_PROCESS", False, None)], "entity_id string, entity_type string, external boolean, local_port int")
    full = [("x", "p", "EVENT_ACCEPT", 1), ("p", "x", "EVENT_SENDTO", 2), ("p", "f", "EVENT_WRITE", 3), ("f", "q", "EVENT_EXECUTE", 4)]
    cases = {"full": full, "entry": full[:1], "part": full[:2], "none": full[1:], "odd": [*full, ("x", "ghost", "EVENT_ACCEPT", 9)], "late": [full[0], ("p", "f", "EVENT_WRITE", 5), full[3]], "effect": [full[0], *full[2:]]}
    a = spark.createDataFrame([(k, s, d, t, ts, f"{k}{ts}", "c") for k, v in cases.items() for s, d, t, ts in v], "scope_id string, src string, dst string, event_type string, timestamp_ns long, evidence_id string, community_id string")
    got = {r.scope_id: r for r in control.assessment(a, ent).collect()}
    assert {k: r.status for k, r in got.items()} == {"full": "supported", "entry": "attempted", "part": "probable", "none": "absent", "odd": "conflicted", "late": "attempted", "effect": "probable"}
    assert got["full"].first_local_subject_id == "q" and got["full"].evidence_ids == ["full1", "full2", "full3", "full4"] and got["odd"].evidence_ids == ["odd9"] and got["none"].evidence_ids == []


    near = {r.scope_id: r for r in control.assessment(a, ent, callback_ns=1, effect_ns=3).collect()}
    assert near["full"].status == "supported" and near["full"].reason_codes == ["boundary_ingress_callback_and_local_effect"]
    far = {r.scope_id: r.status for r in control.assessment(a, ent, callback_ns=0, effect_ns=2).collect()}
    assert far["full"] == "attempted" and far["effect"] == "attempted"
    payload = '{"entry_subject_id":"p","evidence_ids":["full1","full2","full3","full4"],"status":"supported"}'
    assert got["full"].assessment_id == "ic-" + hashlib.sha256(payload.encode()).hexdigest()[:20]


def test_horizons_skip_a_write_that_is_run_too_late(spark):
    ent = spark.createDataFrame([("x", "NET_FLOW", True, 80), ("p", "SUBJECT_PROCESS", False, None), ("f", "FILE_OBJECT_FILE", False, None), ("g", "FILE_OBJECT_DIR", False, None), ("q", "SUBJECT_PROCESS", False, None)], "entity_id string, entity_type string, external boolean, local_port int")
    rows = [("x", "p", "EVENT_ACCEPT", 1), ("p", "f", "EVENT_WRITE", 2), ("p", "g", "EVENT_WRITE", 3), ("g", "q", "EVENT_EXECUTE", 5), ("f", "q", "EVENT_EXECUTE", 99), ("x", "p", "EVENT_RECVMSG", 1)]
    a = spark.createDataFrame([("s", s, d, t, ts, f"{t[6]}{ts}", "c") for s, d, t, ts in rows], "scope_id string, src string, dst string, event_type string, timestamp_ns long, evidence_id string, community_id string")
    (near,) = control.assessment(a, ent, callback_ns=10, effect_ns=10).collect()
    (any_time,) = control.assessment(a, ent).collect()
    assert near.evidence_ids == ["E5", "R1", "W3"] and any_time.evidence_ids == ["A1", "E99", "W2"]


def test_stitch_chain(spark):
    s = spark.createDataFrame([("p", 1, "a", "identity_continuity", ["x", "y"]), ("p", 2, "b", "causal", ["q"]), ("p", 3, "c", "identity_continuity", ["z"]), ("p", 4, "d", "identity_continuity", ["y"]), ("p", 5, "e", "identity_continuity", None)], "path_id string, position int, edge_id string, semantics string, entities array<string>")
    start = spark.createDataFrame([("p", ["x"]), ("empty", ["x"])], "path_id string, entities array<string>")
    assert {r.path_id: (r.valid, r.invalid_edge_ids) for r in control.stitch_chain(s, start).collect()} == {"p": (False, ["c", "e"]), "empty": (True, [])}


def test_next_action(spark):
    st = lambda *x: spark.createDataFrame(x, "state_id string, ic_status string, remaining int, can_left boolean, can_right boolean, can_host boolean")
    items = spark.createDataFrame([("conn", "i2", "connectivity", "open", True, "none", "gap"), ("conn", "i1", "connectivity", "open", False, "none", "no"), ("stage", "s", "stage_constraint", "open", True, "right", "later"), ("left", "l", "left_time", "open", True, "left", "before"), ("other", "o", "odd", "open", True, "none", "why")], "state_id string, item_id string, gap_type string, status string, critical boolean, direction string, reason string")
    states = st(("done", "supported", 0, True, True, True), ("spent", "absent", 0, True, True, True), ("conn", "supported", 1, True, True, True), ("abs", "absent", 1, False, True, True), ("part", "probable", 1, True, False, True), ("stage", "supported", 1, True, True, True), ("left", "supported", 1, False, True, True), ("other", "supported", 1, True, True, True), ("bad", "conflicted", 1, True, True, True))
    got = {r.state_id: (r.action, r.item_id, r.terminal) for r in control.next_action(states, items).collect()}
    assert got == {"done": ("stop_complete", None, True), "spent": ("stop_limited", None, True), "conn": ("retrieve_bridge", "i2", False), "abs": ("extend_host", None, False), "part": ("stop_limited", None, True), "stage": ("extend_right", "s", False), "left": ("stop_limited", "l", True), "other": ("verify_claim", "o", False), "bad": ("verify_claim", None, False)}
