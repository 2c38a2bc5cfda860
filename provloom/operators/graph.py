"""Scans, edges, intervals and per-interval features of the provenance graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.adapter import DAY_NS

# Entity vocabulary in id order, and types of records without a subtype.
ENTITY_TYPES = ("SUBJECT_PROCESS", "FILE_OBJECT_FILE", "FILE_OBJECT_DIR", "FILE_OBJECT_UNIX_SOCKET", "NET_FLOW", "SRC_SINK", "UNNAMED_PIPE", "PRINCIPAL", "HOST", "UNKNOWN")
RECORD_TYPES = {"Subject": "SUBJECT_PROCESS", "NetFlowObject": "NET_FLOW", "SrcSinkObject": "SRC_SINK", "UnnamedPipeObject": "UNNAMED_PIPE", "Principal": "PRINCIPAL", "Host": "HOST"}
VOCABULARY = ("EVENT_EXECUTE", "EVENT_READ", "EVENT_SENDTO", "EVENT_WRITE")


def scan(events: DataFrame, start_ns: int, end_ns: int, phase: str | None = None) -> DataFrame:
    """Half-open time range; both predicates reach the Parquet scan where the columns are stored."""
    out = events.where((F.col("timestamp_ns") >= start_ns) & (F.col("timestamp_ns") < end_ns))
    return out.where(F.col("phase") == phase) if phase else out


def edges(events: DataFrame) -> DataFrame:
    """Up to two directed edges an event, numbered from 1, self-loops included; only object_to_subject turns the direction."""
    turned = F.col("flow_direction") == "object_to_subject"
    role = F.concat(F.lit("predicate"), F.col("predicate_index"))
    some = F.filter(F.array(*(F.struct(F.lit(i).alias("predicate_index"), F.col(c).alias("object_uuid")) for i, c in enumerate(("predicate_uuid", "predicate2_uuid"), 1))), lambda x: x["object_uuid"].isNotNull())
    out = events.where("subject_uuid is not null").select("*", F.inline(some))
    return out.withColumns({"src_uuid": F.when(turned, F.col("object_uuid")).otherwise(F.col("subject_uuid")), "dst_uuid": F.when(turned, F.col("subject_uuid")).otherwise(F.col("object_uuid")), "src_role": F.when(turned, role).otherwise("subject"), "dst_role": F.when(turned, "subject").otherwise(role)})


def compress(edge_rows: DataFrame, *scope: str) -> DataFrame:
    """One row per scope, endpoints, type and predicate; evidence of the first event, ties by place in the log. No self-loops. Events without a time are left out."""
    e = edge_rows if "raw_shard" in edge_rows.columns else edge_rows.withColumn("raw_shard", F.lit(0))
    first = F.struct("timestamp_ns", "raw_shard", "raw_line", "raw_offset", "event_uuid")
    out = e.where("src_uuid <> dst_uuid and timestamp_ns is not null").groupBy(*scope, "src_uuid", "dst_uuid", "event_type", "predicate_index").agg(F.count(F.lit(1)).alias("event_count"), F.min(first).alias("f"), F.max("timestamp_ns").alias("last_timestamp_ns"))
    return out.select(*scope, "src_uuid", "dst_uuid", "event_type", "predicate_index", "event_count", F.col("f.timestamp_ns").alias("first_timestamp_ns"), "last_timestamp_ns", F.col("f.event_uuid").alias("first_event_uuid"), *(F.col(f"f.{c}").alias(f"first_{c}") for c in ("raw_shard", "raw_line", "raw_offset")))


def touches(events: DataFrame, *keep: str) -> DataFrame:
    """One row per event and role that a node has in it, with the columns `keep` of the event."""
    roles = [("subject", "subject_uuid"), ("predicate", "predicate_uuid"), ("predicate2", "predicate2_uuid")]
    pairs = F.filter(F.array(*(F.struct(F.lit(r).alias("role"), F.col(c).alias("node_uuid")) for r, c in roles)), lambda x: x["node_uuid"].isNotNull())
    return events.where("timestamp_ns is not null").select("timestamp_ns", "logical_day", "event_type", *keep, F.inline(pairs))


def bisect(events: DataFrame, length: int = DAY_NS, budget: int = 120, floor: int = 3_600_000_000_000, depth: int = 5) -> DataFrame:
    """Leaves of the recursive halving of aligned candidates, without a loop: a cell splits if it holds more nodes
    than the budget, is longer than the floor and has nodes in both halves; a leaf is a cell that does not
    split while all above it do. length must be divisible by 2 ** depth."""
    cells = touches(events).select("node_uuid", "timestamp_ns", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("depth"))
    width = F.lit(length) / F.pow(F.lit(2), F.col("depth"))
    cells = cells.withColumn("width", width.cast("long")).withColumn("cell", F.expr("timestamp_ns div width")).withColumn("half", F.expr("(timestamp_ns - cell * width) div (width div 2)"))
    stat = cells.groupBy("depth", "width", "cell").agg(F.countDistinct("node_uuid").alias("node_count"), F.countDistinct("half").alias("halves"))
    stat = stat.withColumn("splits", (F.col("node_count") > budget) & (F.col("width") > floor) & (F.col("halves") == 2))
    ups = stat.where("depth > 0").select("depth", "cell", F.explode(F.sequence(F.lit(0), F.col("depth") - 1)).alias("up"))
    ups = ups.withColumn("above", F.expr("cell div cast(pow(2, depth - up) as bigint)"))
    above = stat.select(F.col("depth").alias("up"), F.col("cell").alias("above"), F.col("splits").alias("above_splits"))
    open_ = ups.join(above, ["up", "above"]).groupBy("depth", "cell").agg(F.bool_and("above_splits").alias("open"))
    leaves = stat.where(~F.col("splits")).join(open_, ["depth", "cell"], "left").where(F.coalesce("open", F.lit(True)) & ((F.col("depth") == 0) | F.col("open").isNotNull()))
    start = F.col("cell") * F.col("width")
    return leaves.select(F.concat(F.lit("pg-"), start, F.lit("-"), start + F.col("width")).alias("pg_id"), start.alias("start_ns"), (start + F.col("width")).alias("end_ns"), "depth", "width", "cell", "node_count")


def assign(rows: DataFrame, leaves: DataFrame, length: int = DAY_NS, depth: int = 5) -> DataFrame:
    """Rows with the pg_id of their interval: an equi-join on the cell of each depth, not a range join."""
    keys = rows.withColumn("depth", F.explode(F.sequence(F.lit(0), F.lit(depth)))).withColumn("cell", F.expr(f"timestamp_ns div cast({length} / pow(2, depth) as bigint)"))
    return keys.join(leaves.select("depth", "cell", "pg_id", "start_ns", "end_ns"), ["depth", "cell"]).drop("depth", "cell")


def node_types(definitions: DataFrame) -> DataFrame:
    """One row a node: its first record type and first subtype that is there, in log order (raw_shard, raw_line, raw_offset, as far
    as definitions have them). Rows without a node are none; a node of two record types is an error."""
    place = F.struct(*(c for c in ("raw_shard", "raw_line", "raw_offset") if c in definitions.columns))
    c = definitions.where("node_uuid is not null").groupBy("node_uuid").agg(
        F.count(F.lit(1)).alias("definition_count"), F.min_by("record_type", place).alias("r"), F.min_by("subtype", F.when(F.col("subtype").isNotNull(), place)).alias("s"),
        F.min("record_type").alias("one"), F.max("record_type").alias("two"),
    )
    named = F.lit("UNKNOWN")
    for k, v in RECORD_TYPES.items():
        named = F.when(F.col("r") == k, v).otherwise(named)
    conflict = F.raise_error(F.concat_ws(" ", F.lit("conflicting record types of one node:"), "one", "two")).cast("string")
    kind = F.when(F.col("one") != F.col("two"), conflict).when(F.col("s").isin(*ENTITY_TYPES), F.col("s")).otherwise(named)
    return c.select("node_uuid", "definition_count", kind.alias("entity_type")).withColumn("entity_type_id", type_id(F.col("entity_type")))


def type_id(kind: Column) -> Column:
    return (F.array_position(F.array(*map(F.lit, ENTITY_TYPES)), kind) - 1).cast("int")


#: Slices of a day that the touches of a node are dealt into before gaps are taken (a busy node is no one task).
TIME_SLICES = 64


def longest_gaps(touch: DataFrame, *scope: str) -> DataFrame:
    """max_gap_ns of each node: the longest time between two touches that follow each other.

    Touches are dealt into slices of time: gaps inside a slice come from a sort of that slice alone, gaps between
    slices from the first and last touch of each, of which a node has TIME_SLICES a day at most.
    """
    slices = touch.select(*scope, "node_uuid", "timestamp_ns").withColumn("_slice", F.expr(f"timestamp_ns div {DAY_NS // TIME_SLICES}"))
    inside = Window.partitionBy(*scope, "node_uuid", "_slice").orderBy("timestamp_ns")
    rows = slices.withColumn("gap", F.col("timestamp_ns") - F.lag("timestamp_ns").over(inside))
    ends = rows.groupBy(*scope, "node_uuid", "_slice").agg(F.max("gap").alias("gap"), F.min("timestamp_ns").alias("lo"), F.max("timestamp_ns").alias("hi"))
    between = Window.partitionBy(*scope, "node_uuid").orderBy("_slice")
    ends = ends.withColumn("gap", F.greatest("gap", F.col("lo") - F.lag("hi").over(between)))
    return ends.groupBy(*scope, "node_uuid").agg(F.coalesce(F.max("gap"), F.lit(0)).alias("max_gap_ns"))


def roles(touch: DataFrame, *scope: str) -> DataFrame:
    """Role counts, action counts and activity times."""
    n = F.count(F.lit(1))
    span = F.max("timestamp_ns") - F.min("timestamp_ns")
    out = touch.groupBy(*scope, "node_uuid").agg(
        *(F.count_if(F.col("role") == r).alias(f"{r}_count") for r in ("subject", "predicate", "predicate2")), *(F.count_if(F.col("event_type") == a).alias(a.lower()) for a in VOCABULARY),
        F.count_if(F.col("event_type").isin(*VOCABULARY)).alias("event_count"), span.alias("activity_span_ns"),
        F.round(F.when(n > 1, span / (n - 1)).otherwise(F.lit(0.0)) / 1e9, 9).alias("mean_gap_s"),
    )
    return out.join(longest_gaps(touch, *scope), [*scope, "node_uuid"])


def degrees(edge_rows: DataFrame, *scope: str) -> DataFrame:
    e = edge_rows.where("src_uuid <> dst_uuid").select(*scope, "src_uuid", "dst_uuid").distinct()
    both = e.select(*scope, F.col("src_uuid").alias("node_uuid"), F.col("dst_uuid").alias("o"), F.lit(None).cast("string").alias("i"), F.col("dst_uuid").alias("n")).unionByName(e.select(*scope, F.col("dst_uuid").alias("node_uuid"), F.lit(None).cast("string").alias("o"), F.col("src_uuid").alias("i"), F.col("src_uuid").alias("n")))
    return both.groupBy(*scope, "node_uuid").agg(F.count("i").alias("in_degree"), F.count("o").alias("out_degree"), F.countDistinct("n").alias("unique_neighbor_count"))


def undirected_weights(compressed: DataFrame, *scope: str) -> DataFrame:
    """Sum of counts of both directions, then the logarithm."""
    return compressed.groupBy(*scope, F.least("src_uuid", "dst_uuid").alias("a"), F.greatest("src_uuid", "dst_uuid").alias("b")).agg(F.round(F.log1p(F.sum("event_count")), 6).alias("weight"))
