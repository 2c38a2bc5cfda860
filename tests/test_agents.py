import hashlib
import json

import pytest

from provloom.operators import agents, control, protocol
from provloom.sources import artifacts
from provloom.streaming import forward


def documents(status="supported"):
    base = {name: {} for name in artifacts.ROUND_FILES}
    witnesses = [{"evidence_id": f"w{i}", "event_type": t, "src_entity_id": s, "dst_entity_id": d, "timestamp_ns": i} for i, (t, s, d) in enumerate((("EVENT_RECVFROM", "x", "p"), ("EVENT_SENDTO", "p", "x"), ("EVENT_WRITE", "p", "f"), ("EVENT_EXECUTE", "f", "q")))]
    return base | {
        "retrieved_communities": [{"community_id": c, "start_ns": 0, "end_ns": 1, "node_count": 1, "anchor_count": 1, "context_carrier_count": 0} for c in ("k1", "k2")], "resolved_witnesses": witnesses,
        "witness_certificates": [{"src_community_id": "k1", "dst_community_id": "gone", "edge_type": "entity_lineage", "evidence_semantics": "causal_event", "semantic_role": "attack_transition", "witness_ids": ["w0", "other"]}],
        "campaign_snapshot": {"retained_community_ids": ["k1"]}, "ic_assessment": {"status": status, "community_ids": ["k1"], "evidence_ids": [w["evidence_id"] for w in witnesses], "attack_query": "q"},
        "control_action": {"action": "terminate"}, "frontiers": [], "backbone_after": {"community_ids": ["k1"]}, "ledger_delta": [],
    }


class Scripted:
    """Answers in turn; a function makes its answer from the messages."""

    def __init__(self, *answers):
        self.answers, self.said = list(answers), []

    def __call__(self, messages):
        self.said.append(messages)
        a = self.answers.pop(0)
        return {"content": json.dumps(a(messages) if callable(a) else a), "usage": {"prompt_tokens": 10, "completion_tokens": 5}}


def lead(messages, **more):
    task = json.loads(messages[1]["content"])["available_verification_task"]
    return agents.lead_noop(1) | {"retain_community_ids": ["C01"], "verification_task": task, "recommended_action": "terminate"} | more


def verdict(messages):
    task = json.loads(messages[1]["content"])["task"]
    return agents.assistant_noop(task["task_id"]) | {"verdict": "supported", "supporting_evidence_ids": task["evidence_ids"]}


def test_a_round(spark, tmp_path):
    out = agents.run_round(Scripted(lead, verdict), 1, documents())
    assert out["lead_proposal_validated"]["retain_community_ids"] == ["k1"] and out["assistant_task"]["evidence_ids"] == ["w0", "w1", "w2", "w3"]
    assert out["assistant_verdict_validated"]["supporting_evidence_ids"] == ["w0", "w1", "w2", "w3"] and out["usage_latency"]["recommendation_matched"]
    quiet = agents.run_round(Scripted(lambda m: lead(m)), 1, documents("probable"))
    assert quiet["assistant_verdict_validated"]["verdict"] == "not-requested" and quiet["assistant_task"] == {"task_id": "not-requested"}
    bad = lambda m: lead(m, retain_community_ids=["C99"])
    mended = agents.run_round(Scripted(bad, lambda m: agents.lead_noop(1) | {"recommended_action": "suspend"}), 1, documents())
    assert mended["lead_proposal_validated"]["recommended_action"] == "suspend" and "repair" in mended["lead_proposal_raw"]["response"]
    lost = agents.run_round(Scripted(bad, {"no": 1}), 1, documents())
    assert lost["lead_proposal_validated"]["rationale"] == agents.NOTHING
    source, target = (artifacts.Rounds(spark, str(tmp_path / x)) for x in ("in", "out"))
    for i in (0, 1):
        source.write_round(i, documents())
    assert agents.run_rounds(Scripted(lambda m: lead(m, round=0), verdict, lead, verdict), source, (0, 1), target, {"investigation_id": "i"}) == 2
    case = agents.case_bundle(target, (0, 1), {})
    assert case["trajectory"] == ["terminate"] * 2 and [e["label"] for e in case["attack_summary"]["edges"]] == ["RECVFROM", "SENDTO", "WRITE", "EXECUTE"]
    assert case["attack_summary"]["nodes"][0] == {"id": "external", "entity_ids": ["x"]}
    with pytest.raises(ValueError):
        agents.case_bundle(target, (0,), {"labels_used": True})
    with pytest.raises(ValueError):
        agents.attack_summary({"evidence_ids": ["w0"], "status": "", "attack_query": "", "community_ids": []}, [])


def test_outputs_are_checked():
    good = lead([{}, {"content": json.dumps({"available_verification_task": None})}])
    assert agents.lead_errors(good, 1, {"C01"}, set(), None) == []
    for change in ({"round": 2}, {"schema_version": "x"}, {"retain_community_ids": ["C02"]}, {"recommended_action": "go"}, {"verification_task": {"task_id": "t"}}, {"extra": 1}, {"gaps": None, "withdraw_community_ids": "C01"}):
        assert agents.lead_errors(good | change, 1, {"C01"}, set(), None)
    fine = agents.assistant_noop("t")
    assert agents.assistant_errors(fine, "t", set()) == []
    for change in ({"task_id": "u"}, {"verdict": "maybe"}, {"supporting_evidence_ids": ["E01"]}, {"scope_complete": False}):
        assert agents.assistant_errors(fine | change, "t", set())


def test_artifacts_are_written_once(spark, tmp_path):
    rounds = artifacts.Rounds(spark, str(tmp_path / "run"))
    folder = rounds.write_round(3, documents())
    manifest = json.loads((tmp_path / "run" / folder / "round_manifest.json").read_text())
    assert manifest["sha256"]["frontiers"] == hashlib.sha256((tmp_path / "run" / folder / "frontiers.json").read_bytes()).hexdigest()
    assert rounds.read_round(3)["control_action"] == {"action": "terminate"}
    with pytest.raises(FileExistsError):
        rounds.write_round(3, documents())
    with pytest.raises(ValueError):
        rounds.write_round(4, {"frontiers": []})
    rounds.write_manifest({})
    with pytest.raises(FileExistsError):
        rounds.write_manifest({})
    (h,) = artifacts.file_hashes(spark, str(tmp_path / "run" / "manifest.json")).collect()
    assert h.sha256 == hashlib.sha256((tmp_path / "run" / "manifest.json").read_bytes()).hexdigest()


def test_properties_and_fingerprints(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "x int, y string")
    artifacts.with_properties(df, "events").write.parquet(str(tmp_path / "t"))
    back = spark.read.parquet(str(tmp_path / "t"))
    assert artifacts.properties(back)["table"] == "events" and artifacts.properties(df) == {}
    assert artifacts.schema_fingerprint(back) == artifacts.schema_fingerprint(df) != artifacts.schema_fingerprint(df.select("y", "x"))
    assert artifacts.event_type_fingerprint(["a", "b"]) == hashlib.sha256(b"a\nb").hexdigest()
    rows = spark.createDataFrame([(1, "k2"), (1, "k1"), (2, "k9")], "round int, community_id string")
    assert {(r.round, r.community_id, r.ref) for r in artifacts.alias(rows, "C", "community_id").collect()} == {(1, "k1", "C01"), (1, "k2", "C02"), (2, "k9", "C01")}


def test_budget(spark, tmp_path):
    store = artifacts.Store(spark, str(tmp_path / "usage"))
    prices = {"input": 1.0, "cached_input": 0.1, "output": 2.0}
    chat = agents.Metered(Scripted({"a": 1}), store, prices, 1.0, 100)
    chat([{"role": "user", "content": "hello"}], "first")
    assert chat.records[0]["accounted_cost_usd"] == pytest.approx(2e-5)

    def broken(messages):
        raise RuntimeError("refused with sk-secret.key-1")

    again = agents.Metered(broken, store, prices, 1.0, 100)
    with pytest.raises(RuntimeError):
        again([{"role": "user", "content": "hello"}])
    kept = [json.loads(x) for x in store.read("usage.jsonl").splitlines()]
    assert [r["status"] for r in kept] == ["response_received", "failed"] and "sk-" not in kept[1]["error"] and kept[1]["accounted_cost_usd"] == kept[1]["reservation_usd"]
    with pytest.raises(agents.BudgetExhausted):
        agents.Metered(broken, store, prices, again.spent, 100)([{"role": "user", "content": "x"}])


def test_contracts(spark):
    d = spark.createDataFrame([(1, json.dumps(agents.assistant_noop("t"))), (2, "{}"), (3, "no")], "id int, document string")
    got = {r.id: r.errors for r in agents.contract_errors(d, "assistant").collect()}
    assert got[1] == [] and len(got[2]) == 7 and got[3][0] == "no JSON object"
    c = spark.createDataFrame([("m", "supporting", "E1"), ("m", "conflicting", "E1"), ("m", "supporting", "E2")], "message_id string, field string, ref string")
    assert [(r.message_id, r.ref) for r in agents.support_conflicts(c).collect()] == [("m", "E1")]


def settings():
    days = {"fit_days": [1, 2], "calibration_days": [3], "development_days": [4], "context_days": [5], "locked_test_days": [6]}
    return {"dataset": {"day_graph_range": [1, 6]}, "ca3_split_policy": {"status": "frozen"}, "label_policy": dict.fromkeys(protocol.LABEL_FLAGS, False), "ca3_primary_split": days | {"feature_policy": dict.fromkeys(protocol.FEATURE_FLAGS, False)}}


def test_split_protocol():
    protocol.check_split(settings())
    changes = [lambda s: s["ca3_split_policy"].update(status="draft"), lambda s: s["label_policy"].update(global_uuid_is_positive=True), lambda s: s["ca3_primary_split"]["feature_policy"].update(allow_cross_boundary_windows=True)]
    changes += [lambda s, k=k, v=v: s["ca3_primary_split"].update({k: v}) for k, v in (("fit_days", []), ("fit_days", "12"), ("fit_days", [1, 1, 2]), ("calibration_days", [2, 3]), ("context_days", [6]), ("locked_test_days", [7]))]
    changes.append(lambda s: s["ca3_primary_split"].update(fit_days=[3], calibration_days=[1, 2]))
    for change in changes:
        s = settings()
        change(s)
        with pytest.raises(ValueError):
            protocol.check_split(s)


def test_external_flow(spark):
    cases = {"8.8.8.8": True, "10.1.2.3": False, "172.31.0.1": False, "172.32.0.1": True, "224.0.0.5": False, "192.0.0.9": True, "9.9.9.9": False, "::1": False, "fe80::1": False, "2606:4700::1111": True, None: False, "": False}
    rows = spark.createDataFrame([("NET_FLOW", a, a or "none") for a in cases] + [("FILE_OBJECT_FILE", "8.8.8.8", "file")], "t string, a string, k string")
    got = rows.select("k", "a", control.external_flow(rows["t"], rows["a"], ("9.0.0.0/8",)).alias("x")).collect()
    assert all(r.x == (cases[r.a] if r.k != "file" else False) for r in got)
    with pytest.raises(ValueError):
        control.external_flow(rows["t"], rows["a"], ("9.0.0.1/8",))


def test_streams(spark, tmp_path):
    """Tumbling counts and dedup of a stream of files, against the batch form."""
    rows = spark.createDataFrame([(i % 40, f"2024-01-01 0{i % 6}:{i % 60:02d}:00", "view") for i in range(120)], "event_id int, t string, event_type string").selectExpr("event_id", "cast(t as timestamp) ts", "event_type")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    for name, df in (("n", forward.tumbling_counts(stream())), ("d", forward.deduplicated(stream()))):
        q = df.writeStream.format("memory").queryName(name).outputMode("complete" if name == "n" else "append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
    want = {(r.start, r.event_type): r["count"] for r in forward.tumbling_counts(rows).collect()}
    assert {(r.start, r.event_type): r["count"] for r in spark.table("n").collect()} == want
    assert spark.table("d").count() == 40
