"""Registered queries of readers and stores: the event stream written as NDJSON records, read back, stored and looked up; a bundle of
techniques; stores of arrays, table properties and compact documents; stitch chains."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import control, graph
from ..operators.shared import _delete, shared_folder
from ..sources import adapter, artifacts, audit, knowledge
from ..sources.adapter import SQL_NODES, table
from .nodes import LEAF_ROWS, LEAVES, leaf_features
from .registry import COMPRESSED, WITH, query

DAYS = (1, 31, 0, 2024, 1)
PHASES = {"fit": range(1, 13), "calibration": range(13, 19), "development": range(19, 22), "context": range(22, 28), "locked_test": range(28, 31)}
#: Lines written whose datum is empty, which the reader has to call faulty.
FAULTY = 3


def _records(spark: SparkSession, sf: str) -> DataFrame:
    """Records of all events and node definitions; ids of some fields are wrapped, missing fields are left out."""
    body = lambda **f: F.struct(*(c.alias(n) for n, c in f.items()))
    wrapped = lambda c: F.struct(F.col(c).alias("com.example.UUID"))
    ev = adapter.events(spark, sf).select(F.lit("com.example.Event").alias("name"), body(
        uuid=wrapped("event_uuid"), type=F.col("event_type"), timestampNanos=F.col("timestamp_ns"), sequence=F.struct((F.col("raw_line") - 1).alias("long")), hostId=F.col("host_uuid"),
        subject=wrapped("subject_uuid"), predicateObject=wrapped("predicate_uuid"), predicateObject2=wrapped("predicate2_uuid"),
        properties=F.struct(F.struct(F.struct(F.col("subject_uuid").alias("string")).alias("exec"), F.col("raw_line").cast("string").alias("fd")).alias("map")),
    ).alias("body"))
    nodes = adapter.node_definitions(spark, sf).select(F.concat(F.lit("com.example."), "record_type").alias("name"), body(uuid=wrapped("node_uuid"), type=F.col("subtype"), cid=F.col("raw_line").cast("long")).alias("body"))
    both = [x.select(F.to_json(F.create_map("name", "body")).alias("datum")) for x in (ev, nodes)]
    lines = both[0].unionByName(both[1]).select(F.concat(F.lit('{"datum":'), "datum", F.lit("}")).alias("value"))
    return lines.unionByName(spark.range(FAULTY).select(F.lit('{"datum":{}}').alias("value")))


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder among the shared ones, deleted when the application ends."""
    to = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, to)
    return to


def _store(spark: SparkSession, sf: str) -> str:
    """A store of the records, in the shared folder until the application ends. Lines are written as files x.json by their task's number."""
    to = _folder(spark, "audit")
    _records(spark, sf).withColumn("shard", F.concat(F.lit("part"), F.spark_partition_id().cast("string"))).write.partitionBy("shard").text(f"{to}/lines")
    _named_json(spark, f"{to}/lines", f"{to}/in")
    directions: dict[str, list[str]] = {}
    for kind, direction in adapter.DIRECTIONS.items():
        directions.setdefault(direction, []).append(kind)
    audit.build_store(spark, f"{to}/in", f"{to}/store", directions, {k: list(v) for k, v in PHASES.items()}, DAYS)
    return to


def _named_json(spark: SparkSession, source: str, to: str) -> None:
    """Text files renamed to a.json.N, as record logs are; only names move."""
    at = spark._jvm.org.apache.hadoop.fs.Path
    fs = at(to).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(at(to))
    paths = [r["path"] for r in spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(source).select("path").collect()]
    for n, path in enumerate(sorted(paths)):
        fs.rename(at(path), at(f"{to}/a.json.{n}"))


def _hex(*names: str) -> list:
    return [F.lower(F.hex(n)).alias(n) for n in names]


@query(f"{WITH} SELECT event_uuid, timestamp_ns, raw_line - 1 AS sequence, event_type, flow_direction, host_uuid, subject_uuid, predicate_uuid, predicate2_uuid, subject_uuid AS exec_name, CAST(raw_line AS VARCHAR) AS file_descriptor, logical_day, phase FROM e")
def audit_events(spark, sf):
    """Event rows that the reader makes of raw records."""
    e = spark.read.parquet(f"{_store(spark, sf)}/store/events")
    return e.select(*_hex("event_uuid", "host_uuid", "subject_uuid", "predicate_uuid", "predicate2_uuid"), "timestamp_ns", "sequence", "event_type", "flow_direction", "exec_name", "file_descriptor", "logical_day", "phase")


@query(f"WITH {SQL_NODES.strip()} SELECT node_uuid, record_type, subtype, CAST(raw_line AS BIGINT) AS cid FROM defs")
def audit_nodes(spark, sf):
    """Node definitions that the reader makes of raw records."""
    return spark.read.parquet(f"{_store(spark, sf)}/store/node_definitions").select(*_hex("node_uuid"), "record_type", "subtype", "cid")


@query(f"""{WITH}, {SQL_NODES.strip()} SELECT 'record_type' AS dimension, record_type AS value, count(*) AS n FROM (SELECT record_type FROM defs UNION ALL SELECT 'Event' FROM e) GROUP BY ALL
UNION ALL SELECT 'event_type', event_type, count(*) FROM e GROUP BY ALL UNION ALL SELECT 'flow_direction', flow_direction, count(*) FROM e GROUP BY ALL UNION ALL SELECT 'logical_day', CAST(logical_day AS VARCHAR), count(*) FROM e GROUP BY ALL""")
def audit_summary(spark, sf):
    """Counts of all shards together."""
    return spark.read.parquet(f"{_store(spark, sf)}/store/summary").groupBy("dimension", "value").agg(F.sum("n").alias("n"))


@query(f"{WITH}, {SQL_NODES.strip()} SELECT (SELECT count(*) FROM e) + (SELECT count(*) FROM defs) AS records, CAST({FAULTY} AS BIGINT) AS faulty, true AS whole")
def audit_manifest(spark, sf):
    """Records and faulty lines of the whole store, and whether a second build finds nothing to do."""
    to = _store(spark, sf)
    again = audit.shards(spark, f"{to}/in").join(audit.manifest(spark, f"{to}/store").select("source", "source_bytes"), ["source", "source_bytes"], "left_anti")
    return audit.manifest(spark, f"{to}/store").agg(F.sum("records").alias("records"), F.sum("faulty").alias("faulty"), F.lit(again.isEmpty()).alias("whole"))


@query(f"{WITH} SELECT event_uuid, event_uuid AS text_uuid, raw_line - 1 AS sequence FROM e WHERE predicate2_uuid IS NOT NULL")
def raw_evidence(spark, sf):
    """The raw line, found by its place and checked against the expected id, of every event that has a second object."""
    to = _store(spark, sf)
    shard = audit.manifest(spark, f"{to}/store").select("source", "raw_shard")
    wanted = spark.read.parquet(f"{to}/store/events").where("predicate2_uuid is not null").join(shard, "raw_shard").select("source", "raw_offset", F.col("event_uuid").alias("expected_uuid"))
    placed = audit.lines(spark, f"{to}/in")
    # one spelling of the path on both sides
    plain = lambda df: df.withColumn("source", F.regexp_replace("source", "^file:/+", "/"))
    hits = audit.evidence(plain(placed), plain(wanted))
    at = "$['datum']['com.example.Event']"
    return hits.select(F.lower(F.hex("uuid")).alias("event_uuid"), F.get_json_object("value", at + "['uuid']['com.example.UUID']").alias("text_uuid"), F.get_json_object("value", at + "['sequence']['long']").cast("long").alias("sequence"))


@query("""SELECT 'T' || lpad(CAST(p_partkey % 10000 AS VARCHAR), 4, '0') || CASE WHEN p_size > 25 THEN '.' || lpad(CAST(p_size AS VARCHAR), 3, '0') ELSE '' END AS technique_id, p_name AS name, array_to_string(list_sort([p_type, p_brand]), ',') AS tactics, '' AS description, 'attack-pattern--' || p_partkey AS stix_id
FROM part WHERE p_brand <> 'Brand#2' AND p_type <> 'SMALL'""")
def techniques(spark, sf):
    """Parts as the attack patterns of a bundle: those of one brand are revoked, small ones deprecated; ids stand behind others that are no technique's."""
    key = F.col("p_partkey").cast("string")
    name = F.concat(F.lit("T"), F.lpad((F.col("p_partkey") % 10000).cast("string"), 4, "0"), F.when(F.col("p_size") > 25, F.concat(F.lit("."), F.lpad(F.col("p_size").cast("string"), 3, "0"))).otherwise(F.lit("")))
    other = lambda x: F.struct(x.alias("external_id"))
    phase = lambda c: F.struct(F.col(c).alias("phase_name"))
    made = F.struct(
        F.lit("attack-pattern").alias("type"), F.concat(F.lit("attack-pattern--"), key).alias("id"), F.col("p_name").alias("name"), (F.col("p_brand") == "Brand#2").alias("revoked"), F.when(F.col("p_type") == "SMALL", True).alias("x_mitre_deprecated"),
        F.array(phase("p_type"), phase("p_brand")).alias("kill_chain_phases"), F.array(other(F.concat(F.lit("CAPEC-"), key)), other(name), other(F.lit("T9999"))).alias("external_references"),
    )
    to = _folder(spark, "bundle")
    documents = table(spark, sf, "part").groupBy(F.expr("p_partkey div 1000").alias("k")).agg(F.collect_list(made).alias("objects"))
    documents.select(F.to_json(F.struct("objects"))).write.option("maxRecordsPerFile", 1).text(to)
    return knowledge.techniques(knowledge.bundle(spark, to)).drop("modified").withColumn("tactics", F.array_join("tactics", ","))


@query(f"""{LEAVES}, {LEAF_ROWS} SELECT n.pg_id, nodes, counts, labels, coalesce(weights, 0) AS weights FROM (SELECT pg_id, string_agg(node_uuid, ',' ORDER BY node_uuid) AS nodes, string_agg(CAST(event_count AS VARCHAR), ',' ORDER BY node_uuid) AS counts, string_agg(CAST(in_degree AS VARCHAR), ',' ORDER BY node_uuid) AS labels FROM nf GROUP BY pg_id) n
LEFT JOIN (SELECT pg_id, count(*) AS weights FROM (SELECT DISTINCT pg_id, least(src_uuid, dst_uuid), greatest(src_uuid, dst_uuid) FROM lc) GROUP BY pg_id) w USING (pg_id)""")
def interval_arrays(spark, sf):
    """What a store of arrays holds of each interval: ids, feature vectors (one count) and numbers (the in-degree) of nodes in order, and how many weighted edges."""
    n, c = leaf_features(spark, sf)
    to = f"{_folder(spark, 'arrays')}/store"
    artifacts.array_store(n.select("pg_id", "node_uuid", F.array("event_count").alias("x")), graph.undirected_weights(c, "pg_id"), n.select("pg_id", "node_uuid", F.col("in_degree").alias("label")), to)
    joined = lambda a: F.array_join(a, ",")
    return spark.read.parquet(to).select("pg_id", joined("node_uuid").alias("nodes"), joined(F.transform("x", lambda v: v[0].cast("string"))).alias("counts"), joined(F.transform("community", lambda v: v.cast("string"))).alias("labels"), F.coalesce(F.size("edges"), F.lit(0)).cast("long").alias("weights"))


@query(f"SELECT * FROM (VALUES ('schema_version', '{artifacts.SCHEMA_VERSION}'), ('table', 'edges'), ('evidence_reference', '{artifacts.EVIDENCE_REFERENCE}')) AS v(key, value)")
def table_properties(spark, sf):
    """Properties that a stored table of edges carries."""
    to = f"{_folder(spark, 'properties')}/edges"
    artifacts.with_properties(graph.edges(adapter.events(spark, sf)), "edges").write.parquet(to)
    return spark.createDataFrame(list(artifacts.properties(spark.read.parquet(to)).items()), "key string, value string")


@query(f"{WITH}, {COMPRESSED} SELECT CAST(to_json({{'src_uuid': src_uuid, 'event_type': event_type, 'event_count': event_count, 'nothing': NULL}}) AS VARCHAR) AS document FROM comp")
def compact_documents(spark, sf):
    c = graph.compress(graph.edges(adapter.events(spark, sf)), "logical_day")
    return artifacts.compact(c.withColumn("nothing", F.lit(None).cast("string")), "src_uuid", "event_type", "event_count", "nothing")


@query("""WITH RECURSIVE s AS (SELECT l_orderkey AS path_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey % 4, l_linestatus) AS o, 'e' || l_linenumber AS edge_id, ['s' || (l_suppkey % 4), 'm' || l_linestatus] AS entities FROM lineitem WHERE l_returnflag <> 'R'
), f AS (SELECT o_orderkey AS path_id, 0 AS o, ['s' || (o_custkey % 4), 'mO'] AS eligible, CAST([] AS VARCHAR[]) AS bad FROM orders UNION ALL
  SELECT f.path_id, s.o, CASE WHEN list_has_any(eligible, entities) THEN entities ELSE eligible END, CASE WHEN list_has_any(eligible, entities) THEN bad ELSE list_append(bad, edge_id) END FROM f JOIN s ON s.path_id = f.path_id AND s.o = f.o + 1)
SELECT path_id, len(bad) = 0 AS valid, array_to_string(bad, ',') AS invalid FROM (SELECT path_id, arg_max(bad, o) AS bad FROM f GROUP BY path_id)""")
def stitch_chains(spark, sf):
    """Orders as paths, their lines as steps (returned ones as causal), suppliers and line states as entities."""
    l, o = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    group = lambda c: F.concat(F.lit("s"), (F.col(c) % 4).cast("string"))
    steps = l.select(F.col("l_orderkey").alias("path_id"), F.col("l_linenumber").alias("position"), F.concat(F.lit("e"), F.col("l_linenumber").cast("string")).alias("edge_id"), F.when(F.col("l_returnflag") == "R", "causal_event").otherwise("identity_continuity").alias("semantics"), F.array(group("l_suppkey"), F.concat(F.lit("m"), "l_linestatus")).alias("entities"))
    starts = o.select(F.col("o_orderkey").alias("path_id"), F.array(group("o_custkey"), F.lit("mO")).alias("entities"))
    return control.stitch_chain(steps, starts).select("path_id", "valid", F.array_join("invalid_edge_ids", ",").alias("invalid"))
