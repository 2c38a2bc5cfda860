import json

import pytest
from pyspark.sql import functions as F

from provloom.sources import audit, knowledge

U = "00000000-0000-0000-0000-00000000000"
DAYS, PHASES, DIRECTIONS = (2, 13, -4), {"fit": [2, 3], "locked_test": [4]}, {"object_to_subject": ["EVENT_READ"], "subject_to_object": ["EVENT_WRITE"]}


def record(kind, **body):
    return json.dumps({"datum": {f"x.y.{kind}": body}}, ensure_ascii=False)


def write(path, rows):
    path.write_bytes("".join(r + "\n" for r in rows).encode())


def test_lines_have_their_place_across_splits(spark, tmp_path):
    rows = [f"{i}-" + "é" * (i % 50) for i in range(3000)]
    write(tmp_path / "a.json", rows)
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "10000")
    try:
        got = {(r.raw_line, r.raw_offset, r.value) for r in audit.lines(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set(key, before)
    want, at = set(), 0
    for i, r in enumerate(rows, 1):
        want.add((i, at, r))
        at += len(r.encode()) + 1
    assert got == want


def test_shards_in_numeric_order(spark, tmp_path):
    for n in ("a.json", "a.json.10", "a.json.2", "b.json", "other.txt"):
        write(tmp_path / n, ["{}"])
    assert [r.source.rsplit("/", 1)[1] for r in audit.shards(spark, str(tmp_path)).orderBy("raw_shard").collect()] == ["a.json", "a.json.2", "a.json.10", "b.json"]


def test_values_are_unwrapped_and_typed():
    got = audit.read_record(record("Event", uuid={"a": {"b": f"{U}A"}}, timestampNanos={"long": 5}, size=True, sequence="7", type="", hostId=None, properties={"map": {"exec": "sh", "fd": 3}}))
    assert got["uuid"][-1] == 10 and got["timestamp_ns"] == 5 and got["size"] is None and got["sequence"] is None and got["type"] is None and got["exec_name"] == "sh" and got["file_descriptor"] is None
    assert "error" in audit.read_record("{") and "error" in audit.read_record('{"datum": {"a": {}, "b": {}}}') and "error" in audit.read_record('{"datum": {"a": 3}}') and "error" in audit.read_record("[1]")


def test_all_properties_are_kept(spark, tmp_path):
    write(tmp_path / "a.json", [record("Event", properties={"map": {"exec": {"string": "sh"}, "n": 3, "deep": [1], "none": None}}), record("Event")])
    got = audit.records(audit.lines(spark, str(tmp_path))).orderBy("raw_line").collect()
    assert [r.properties for r in got] == [{"exec": "sh", "n": "3", "deep": "[1]"}, {}]


def test_host_by_presence_of_the_key():
    base = {"hostId": f"{U}1"}
    assert audit.read_record(record("Subject", baseObject=base))["host_uuid"] is not None
    assert audit.read_record(record("Subject", hostId=None, baseObject=base))["host_uuid"] is None


def test_store_is_built_once_and_resumed(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    day3 = audit.day_bounds(3, 3, -4)[0]
    write(src / "a.json", [record("Event", uuid=f"{U}1", timestampNanos=day3, type="EVENT_READ"), record("Event", uuid=f"{U}2", timestampNanos=day3 - 1, type="EVENT_X"), record("Subject", uuid=f"{U}3", type="SUBJECT_PROCESS"), record("Subject", type="NO_ID"), "broken"])
    (m,) = audit.build_store(spark, str(src), out, DIRECTIONS, PHASES, DAYS).collect()
    assert (m.raw_shard, m.records, m.faulty) == (0, 4, 1)
    ev = spark.read.parquet(f"{out}/events").orderBy("raw_line").collect()
    assert [(e.flow_direction, e.logical_day, e.phase, e.raw_line) for e in ev] == [("object_to_subject", 3, "fit", 1), ("structural", 2, "fit", 2)]
    assert spark.read.parquet(f"{out}/node_definitions").count() == 1
    assert {(r.dimension, r.value, r.n) for r in spark.read.parquet(f"{out}/summary").collect()} >= {("record_type", "Subject", 2), ("logical_day", "3", 1), ("flow_direction", "structural", 1)}
    write(src / "a.json.1", [record("Event", uuid=f"{U}4", type="EVENT_WRITE")])
    assert audit.build_store(spark, str(src), out, DIRECTIONS, PHASES, DAYS).count() == 2
    assert spark.read.parquet(f"{out}/events").count() == 3
    assert audit.build_store(spark, str(src), out, DIRECTIONS, PHASES, DAYS).count() == 2
    placed = audit.lines(spark, str(src / "a.json"))
    write(src / "a0.json", ["{}"])
    write(src / "Z.json", ["{}"])
    with pytest.raises(ValueError):
        audit.build_store(spark, str(src), out, DIRECTIONS, PHASES, DAYS)
    hit = audit.evidence(placed, placed.where("raw_line = 3").select("source", "raw_offset")).collect()
    assert [h.uuid[-1] for h in hit] == [3]
    third = placed.where("raw_line = 3").select("source", "raw_offset")
    for n, good in ((3, True), (9, False)):
        expected = third.withColumn("expected_uuid", F.lit(bytes(15) + bytes([n])))
        if good:
            assert [h.raw_line for h in audit.evidence(placed, expected).collect()] == [3]
        else:
            with pytest.raises(Exception, match="another id than expected"):
                audit.evidence(placed, expected).collect()


def test_days_outside_are_null_and_conflicts_raise(spark):
    start, end = audit.day_bounds(2, 13, -4)
    got = spark.createDataFrame([(start - 1,), (start,), (end - 1,), (end,), (None,)], "t long").select(audit.logical_day(F.col("t"), *DAYS)).collect()
    assert [r[0] for r in got] == [None, 2, 13, None, None]
    with pytest.raises(ValueError):
        audit.one_each({"a": ["x"], "b": ["x"]}, "event type")


def test_techniques(spark, tmp_path):
    t = lambda i, ids, **k: {"type": "attack-pattern", "id": f"s{i}", "name": f"n{i}", "modified": "m", "external_references": [{"external_id": x} for x in ids], **k}
    objects = [{"type": "x-mitre-collection", "id": "c", "x_mitre_version": "17.1"}, t(1, ["CAPEC-1", "T1059.001"], kill_chain_phases=[{"phase_name": "b"}, {"phase_name": "a"}]), t(2, ["T1000"], revoked=True), t(3, ["T1001"], x_mitre_deprecated=True), t(4, ["T10"]), t(5, ["T1003"])]
    knowledge.write_json(spark, {"objects": objects}, str(tmp_path / "b.json"))
    o = knowledge.bundle(spark, str(tmp_path / "b.json"))
    assert knowledge.bundle_version(o) == "17.1"
    assert [(r.technique_id, r.tactics, r.description) for r in knowledge.techniques(o).collect()] == [("T1003", [], ""), ("T1059.001", ["a", "b"], "")]


def test_settings(spark, tmp_path):
    (tmp_path / "s.toml").write_text("[a]\nb = [1, 2]\n")
    assert knowledge.settings(spark, str(tmp_path / "s.toml")) == {"a": {"b": [1, 2]}}
