"""The driver's event stream seen as provenance records: typed event and node-definition tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Flow directions of the event types that the adapter makes.
DIRECTIONS = {"EVENT_READ": "object_to_subject", "EVENT_EXECUTE": "object_to_subject", "EVENT_WRITE": "subject_to_object", "EVENT_SENDTO": "subject_to_object", "EVENT_FORK": "process_relation"}
TYPES = {"view": "EVENT_READ", "click": "EVENT_WRITE", "error": "EVENT_EXECUTE", "purchase": "EVENT_SENDTO", "signup": "EVENT_FORK"}
DAY_NS = 86_400_000_000_000
FIRST_DAY_NS = 1_704_067_200_000_000_000  # 2024-01-01 UTC


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lookup(mapping: dict[str, str], key, default=None):
    out = F.lit(default)
    for k, v in mapping.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def phase_of(day):
    return F.when(day <= 12, "fit").when(day <= 18, "calibration").when(day <= 21, "development").when(day <= 27, "context").when(day <= 30, "locked_test")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event rows; ids are lower-case hex, times are nanoseconds since the epoch as BIGINT."""
    raw = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    ns = (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).cast("long")
    day = (F.floor((ns - FIRST_DAY_NS) / F.lit(1) / F.lit(DAY_NS)) + 1).cast("int")
    kind = _lookup(TYPES, F.col("event_type"))
    return raw.select(
        F.md5(F.concat(F.lit("e"), F.col("event_id").cast("string"))).alias("event_uuid"), ns.alias("timestamp_ns"), kind.alias("event_type"), F.coalesce(_lookup(DIRECTIONS, kind), F.lit("structural")).alias("flow_direction"),
        F.md5(F.concat(F.lit("h"), (F.col("user_id") % 5).cast("string"))).alias("host_uuid"), F.md5(F.concat(F.lit("u"), F.col("user_id").cast("string"))).alias("subject_uuid"), F.md5(F.concat(F.lit("o"), k.cast("string"))).alias("predicate_uuid"),
        F.when(F.col("event_id") % 10 == 0, F.md5(F.concat(F.lit("o"), ((k * 7 + 3) % 100).cast("string")))).alias("predicate2_uuid"),
        day.alias("logical_day"), phase_of(day).alias("phase"), (F.col("event_id") + 1).alias("raw_line"), (F.col("event_id") * 100).alias("raw_offset"),
    )


def node_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several rows a node: users are processes (a bare and a typed row), objects by k mod 4."""
    raw = table(spark, sf_dir, "events")
    users = raw.select("user_id").distinct().select(F.md5(F.concat(F.lit("u"), F.col("user_id").cast("string"))).alias("node_uuid"), F.lit("Subject").alias("record_type"), F.explode(F.array(F.struct(F.lit(1).alias("raw_line"), F.lit(None).cast("string").alias("subtype")), F.struct(F.lit(2).alias("raw_line"), F.lit("SUBJECT_PROCESS").alias("subtype")))).alias("x")).select("node_uuid", "record_type", "x.subtype", "x.raw_line")
    k = F.col("id")
    objects = spark.range(100).select(F.md5(F.concat(F.lit("o"), k.cast("string"))).alias("node_uuid"), F.when(k % 4 < 2, "FileObject").when(k % 4 == 2, "NetFlowObject").otherwise("UnnamedPipeObject").alias("record_type"), F.when(k % 4 == 0, "FILE_OBJECT_FILE").when(k % 4 == 1, "FILE_OBJECT_DIR").alias("subtype"), F.lit(1).alias("raw_line"))
    return users.unionByName(objects)


SQL_EVENTS = f"""
ev AS (
  SELECT md5('e' || event_id) AS event_uuid, epoch_us(ts) * 1000 AS timestamp_ns,
    CASE event_type WHEN 'view' THEN 'EVENT_READ' WHEN 'click' THEN 'EVENT_WRITE' WHEN 'error' THEN 'EVENT_EXECUTE' WHEN 'purchase' THEN 'EVENT_SENDTO' WHEN 'signup' THEN 'EVENT_FORK' END AS event_type,
    CASE WHEN event_type IN ('view', 'error') THEN 'object_to_subject' WHEN event_type IN ('click', 'purchase') THEN 'subject_to_object' WHEN event_type = 'signup' THEN 'process_relation' ELSE 'structural' END AS flow_direction,
    md5('h' || (user_id % 5)) AS host_uuid, md5('u' || user_id) AS subject_uuid, md5('o' || k) AS predicate_uuid, CASE WHEN event_id % 10 = 0 THEN md5('o' || ((k * 7 + 3) % 100)) END AS predicate2_uuid,
    CAST((epoch_us(ts) * 1000 - {FIRST_DAY_NS}) // {DAY_NS} + 1 AS INT) AS logical_day, event_id + 1 AS raw_line, event_id * 100 AS raw_offset
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
), e AS (
  SELECT *, CASE WHEN logical_day <= 12 THEN 'fit' WHEN logical_day <= 18 THEN 'calibration' WHEN logical_day <= 21 THEN 'development' WHEN logical_day <= 27 THEN 'context' WHEN logical_day <= 30 THEN 'locked_test' END AS phase FROM ev
), edges AS (
  SELECT * FROM (
    SELECT event_uuid, timestamp_ns, event_type, flow_direction, logical_day, phase, raw_line, raw_offset, i AS predicate_index, subject_uuid, CASE i WHEN 1 THEN predicate_uuid ELSE predicate2_uuid END AS object_uuid,
      CASE WHEN flow_direction = 'object_to_subject' THEN CASE i WHEN 1 THEN predicate_uuid ELSE predicate2_uuid END ELSE subject_uuid END AS src_uuid,
      CASE WHEN flow_direction = 'object_to_subject' THEN subject_uuid ELSE CASE i WHEN 1 THEN predicate_uuid ELSE predicate2_uuid END END AS dst_uuid
    FROM e, (VALUES (1), (2)) AS v(i)) WHERE object_uuid IS NOT NULL AND subject_uuid IS NOT NULL
)"""
SQL_NODES = """
defs AS (
  SELECT DISTINCT md5('u' || user_id) AS node_uuid, 'Subject' AS record_type, subtype, raw_line FROM events, (VALUES (NULL, 1), ('SUBJECT_PROCESS', 2)) AS s(subtype, raw_line)
  UNION ALL SELECT md5('o' || k), CASE WHEN k % 4 < 2 THEN 'FileObject' WHEN k % 4 = 2 THEN 'NetFlowObject' ELSE 'UnnamedPipeObject' END, CASE k % 4 WHEN 0 THEN 'FILE_OBJECT_FILE' WHEN 1 THEN 'FILE_OBJECT_DIR' END, 1 FROM range(100) AS r(k)
), nt AS (
  SELECT node_uuid, count(*) AS definition_count, coalesce(first(subtype ORDER BY raw_line) FILTER (subtype IS NOT NULL), CASE first(record_type ORDER BY raw_line) WHEN 'Subject' THEN 'SUBJECT_PROCESS' WHEN 'NetFlowObject' THEN 'NET_FLOW' WHEN 'UnnamedPipeObject' THEN 'UNNAMED_PIPE' ELSE 'UNKNOWN' END) AS entity_type FROM defs GROUP BY node_uuid
)"""
