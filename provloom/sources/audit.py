"""NDJSON audit records: lines with their place in the file, typed event and node rows, and a store of them."""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timedelta, timezone
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Fields of a record's body, by kind, and the columns they become.
IDS = {"uuid": "uuid", "hostId": "host_uuid", "subject": "subject_uuid", "predicateObject": "predicate_uuid", "predicateObject2": "predicate2_uuid", "parentSubject": "parent_uuid", "localPrincipal": "principal_uuid"}
INTEGERS = {"timestampNanos": "timestamp_ns", "sequence": "sequence", "threadId": "thread_id", "size": "size", "startTimestampNanos": "start_timestamp_ns", "cid": "cid", "localPort": "local_port", "remotePort": "remote_port"}
TEXTS = {"type": "type", "predicateObjectPath": "predicate_path", "predicateObject2Path": "predicate2_path", "name": "name", "cmdLine": "cmd_line", "localAddress": "local_address", "remoteAddress": "remote_address", "username": "username"}
PROPERTIES = {"exec": "exec_name", "ppid": "parent_pid", "fd": "file_descriptor", "return_value": "return_value"}
EVENT_COLUMNS = ("event_uuid", "timestamp_ns", "sequence", "event_type", "flow_direction", "host_uuid", "subject_uuid", "predicate_uuid", "predicate2_uuid", "predicate_path", "predicate2_path", "thread_id", "size", "name", "exec_name", "parent_pid", "file_descriptor", "return_value", "logical_day", "phase", "raw_shard", "raw_line", "raw_offset")
NODE_COLUMNS = ("node_uuid", "record_type", "subtype", "host_uuid", "parent_uuid", "principal_uuid", "start_timestamp_ns", "cid", "cmd_line", "local_address", "local_port", "remote_address", "remote_port", "username", "raw_shard", "raw_line", "raw_offset")
#: Files up to which their table is broadcast.
BROADCAST_FILES = 100_000
PLACE = "source string, raw_line long, raw_offset long"


def shards(spark: SparkSession, path: str) -> DataFrame:
    """source, source_bytes, raw_shard: files x.json and x.json.N numbered from 0 by (x.json, N); others count as N = 0. Contents are not read."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("source"), F.col("length").alias("source_bytes"))
    name = F.element_at(F.split("source", "/"), -1)
    part = F.regexp_extract(name, r"^.+\.json\.(\d+)$", 1)
    files = files.where(name.contains(".json")).withColumns({"base": F.when(part != "", F.regexp_replace(name, r"\.\d+$", "")).otherwise(name), "part": F.coalesce(F.expr("try_cast(nullif(regexp_extract(element_at(split(source, '/'), -1), '^.+[.]json[.]([0-9]+)$', 1), '') as long)"), F.lit(0))})
    return files.withColumn("raw_shard", F.row_number().over(Window.orderBy("base", "part", "source")) - 1).select("source", "source_bytes", "raw_shard")


def lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """source, raw_line (from 1), raw_offset (bytes before the line), value.

    Files are read in splits. Counts of each split (lines, bytes) are summed over the splits before it, a small table;
    inside a split running sums are made batch by batch, so no text is shuffled and no file is held by a task.
    Lines end with one newline; other line ends stay in the value.
    """
    meta = F.col("_metadata")
    raw = spark.read.option("lineSep", "\n").text(paths).select(meta["file_path"].alias("source"), meta["file_block_start"].alias("split"), "value")
    size = F.octet_length("value").cast("long") + 1
    total = raw.groupBy("source", "split").agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("m"))
    before = Window.partitionBy("source").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    total = total.select("source", "split", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("lines_before"), F.coalesce(F.sum("m").over(before), F.lit(0)).alias("bytes_before"))

    def place(batches):
        key, line, offset = None, 0, 0
        for b in batches:
            source, split = b.column("source").to_pylist(), b.column("split").to_pylist()
            sizes = pc.add(pc.binary_length(b.column("value")), 1).to_numpy(zero_copy_only=False).astype(np.int64)
            at = 0
            while at < len(source):  # runs of one split
                here, end = (source[at], split[at]), at + 1
                while end < len(source) and split[end] == here[1] and source[end] == here[0]:
                    end += 1
                if here != key:
                    key, line, offset = here, 0, 0
                run = np.cumsum(sizes[at:end])
                part = b.slice(at, end - at)
                yield pa.RecordBatch.from_arrays([part.column("source"), part.column("split"), part.column("value"), pa.array(np.arange(line + 1, line + 1 + end - at)), pa.array(offset + run - sizes[at:end])], ["source", "split", "value", "raw_line", "raw_offset"])
                line, offset, at = line + end - at, offset + int(run[-1]), end

    placed = raw.mapInArrow(place, "source string, split long, value string, raw_line long, raw_offset long")
    out = placed.join(total, ["source", "split"])
    return out.select("source", (F.col("raw_line") + F.col("lines_before")).alias("raw_line"), (F.col("raw_offset") + F.col("bytes_before")).alias("raw_offset"), "value")


def bare(value):
    """A value out of mappings with one entry, however deep."""
    while isinstance(value, dict) and len(value) == 1:
        (value,) = value.values()
    return value


def _text(value) -> str | None:
    value = bare(value)
    return value if isinstance(value, str) and value else None


def _integer(value) -> int | None:
    value = bare(value)
    return value if isinstance(value, int) and not isinstance(value, bool) and -(2**63) <= value < 2**63 else None


def _id(value) -> bytes | None:
    text = _text(value)
    return uuid.UUID(text).bytes if text else None


def _mapping(value) -> dict:
    return value if isinstance(value, dict) else {}


def read_record(line: str) -> dict:
    """Fields of one record; `error` tells why a line is none."""
    try:
        datum = json.loads(line).get("datum")
        if not isinstance(datum, dict) or len(datum) != 1:
            raise ValueError("a record has exactly one datum")
        ((name, body),) = datum.items()
        if not isinstance(body, dict):
            raise TypeError("the body of a datum is an object")
        host = body["hostId"] if "hostId" in body else _mapping(body.get("baseObject")).get("hostId")
        out = {c: _id(host if f == "hostId" else body.get(f)) for f, c in IDS.items()}
        out |= {c: _integer(body.get(f)) for f, c in INTEGERS.items()} | {c: _text(body.get(f)) for f, c in TEXTS.items()}
        extra = _mapping(_mapping(body.get("properties")).get("map"))
        out |= {c: _text(extra.get(f)) for f, c in PROPERTIES.items()}
        out["properties"] = [(k, v if isinstance(v, str) else json.dumps(v)) for k, v in ((k, bare(v)) for k, v in extra.items()) if v is not None]
        when = body.get("timestampNanos")
        return out | {"record_type": name.rsplit(".", 1)[-1], "event_host_uuid": _id(body.get("hostId")), "raw_type": str(body.get("type")), "day_ns": _integer(when) if not isinstance(when, dict) else None}
    except (ValueError, TypeError, AttributeError) as e:
        return {"error": f"{type(e).__name__}: {e}"}


_FIELDS = [(c, pa.binary()) for c in (*IDS.values(), "event_host_uuid")] + [(c, pa.int64()) for c in (*INTEGERS.values(), "day_ns")] + [(c, pa.string()) for c in (*TEXTS.values(), *PROPERTIES.values(), "record_type", "raw_type", "error")] + [("properties", pa.map_(pa.string(), pa.string()))]
_SQL_TYPE = {pa.binary(): "binary", pa.int64(): "long", pa.string(): "string", pa.map_(pa.string(), pa.string()): "map<string,string>"}


def records(placed: DataFrame, text: bool = False) -> DataFrame:
    """lines() read as records: place, record_type, fields of all kinds, all properties as a map of texts (values that are
    no texts as JSON), and error (null for good lines). text: with the line itself (value).
    Values may be wrapped to any depth and types are strict, which no built-in reader expresses: hence Arrow batches."""

    kept = ["source", "raw_line", "raw_offset"] + (["value"] if text else [])

    def run(batches):
        for b in batches:
            rows = [read_record(v or "") for v in b.column("value").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in kept] + [pa.array([r.get(c) for r in rows], t) for c, t in _FIELDS], kept + [c for c, _ in _FIELDS])

    return placed.select("source", "raw_line", "raw_offset", "value").mapInArrow(run, ", ".join([PLACE] + ["value string"] * text + [f"`{c}` {_SQL_TYPE[t]}" for c, t in _FIELDS]))


def day_bounds(first: int, last: int, utc_offset_hours: int, year: int = 2018, month: int = 4) -> tuple[int, int]:
    """Start of the first day and end of the last, in nanoseconds since the epoch."""
    start = datetime(year, month, first, tzinfo=timezone(timedelta(hours=utc_offset_hours)))
    return tuple(int(x.timestamp()) * 1_000_000_000 for x in (start, start + timedelta(days=last - first + 1)))


def logical_day(ns: Column, first: int, last: int, utc_offset_hours: int, year: int = 2018, month: int = 4) -> Column:
    """Day of the month at a fixed offset; null outside first to last."""
    start, end = day_bounds(first, last, utc_offset_hours, year, month)
    return F.when((ns >= start) & (ns < end), F.floor((ns - F.lit(start)) / F.lit(86_400_000_000_000)).cast("int") + first)


def one_each(groups: dict[str, list], what: str) -> dict:
    """Member -> group; a member of two groups is an error."""
    out: dict = {}
    for group, members in groups.items():
        for m in members:
            if out.setdefault(m, group) != group:
                raise ValueError(f"{what} {m} is in {out[m]} and {group}")
    return out


def _case(key: Column, mapping: dict, default=None) -> Column:
    return reduce(lambda out, kv: F.when(key == kv[0], F.lit(kv[1])).otherwise(out), mapping.items(), F.lit(default).cast("string"))


def event_rows(read: DataFrame, directions: dict[str, list[str]], phases: dict[str, list[int]], days: tuple[int, ...], default: str = "structural") -> DataFrame:
    """The event table from records() with a raw_shard. days: first, last, UTC offset in hours, and year and month."""
    day = logical_day(F.col("day_ns"), *days)
    out = read.where("record_type = 'Event'").withColumns({"event_uuid": F.col("uuid"), "event_type": F.col("type"), "host_uuid": F.col("event_host_uuid"), "logical_day": day, "flow_direction": _case(F.col("raw_type"), one_each(directions, "event type"), default)})
    return out.withColumn("phase", _case(F.col("logical_day"), one_each(phases, "day"))).select(*EVENT_COLUMNS)


def node_rows(read: DataFrame) -> DataFrame:
    """The node-definition table from records() with a raw_shard; records without an id are none."""
    return read.where("record_type <> 'Event' and uuid is not null").withColumnsRenamed({"uuid": "node_uuid", "type": "subtype"}).select(*NODE_COLUMNS)


def summary(read: DataFrame, events: DataFrame) -> DataFrame:
    """Counts of a shard: raw_shard, dimension (record_type, event_type, flow_direction, logical_day), value, n."""
    kinds = read.where("error is null").groupBy("raw_shard", F.col("record_type").alias("value")).agg(F.count(F.lit(1)).alias("n")).withColumn("dimension", F.lit("record_type"))
    pairs = F.array(*(F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c in ("event_type", "flow_direction", "logical_day")))
    rest = events.select("raw_shard", F.inline(pairs)).where("dimension <> 'logical_day' or value is not null").groupBy("raw_shard", "dimension", "value").agg(F.count(F.lit(1)).alias("n"))
    return kinds.unionByName(rest).select("raw_shard", "dimension", "value", "n")


def manifest(spark: SparkSession, store: str) -> DataFrame | None:
    """The shards that the store holds whole; None before the first."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{store}/manifest")
    return spark.read.parquet(f"{store}/manifest") if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at) else None


def build_store(spark: SparkSession, path: str, store: str, directions: dict, phases: dict, days: tuple[int, ...]) -> DataFrame:
    """Write events, node definitions, summaries and faulty lines of all shards that the manifest lacks; returns the manifest.

    Tables are partitioned by shard, and a shard's partitions are overwritten as a whole, so a build that was cut off is
    simply run again. The manifest, written last, has name, bytes and counts of each shard.
    """
    todo, done = shards(spark, path), manifest(spark, store)
    if done is not None:
        if not todo.join(done.select("source", F.col("raw_shard").alias("before")), "source").where("raw_shard <> before").isEmpty():
            raise ValueError("new files change the numbers of stored shards: build a new store")
        todo = todo.join(done.select("source", "source_bytes"), ["source", "source_bytes"], "left_anti")
    files = [r["source"] for r in todo.select("source").collect()]  # names of files only
    if not files:
        return done if done is not None else spark.createDataFrame([], "source string, source_bytes long, raw_shard int, records long, faulty long")
    near = F.broadcast if len(files) <= BROADCAST_FILES else lambda df: df
    # read_record is the costly step, so its result is stored once and reread
    read = records(lines(spark, files)).join(near(todo.select(F.regexp_replace("source", "^file:/+", "/").alias("at"), "raw_shard")), F.regexp_replace("source", "^file:/+", "/") == F.col("at")).drop("at")
    _overwrite(read, f"{store}/records")
    read = spark.read.parquet(f"{store}/records").join(near(todo.select("raw_shard")), "raw_shard", "left_semi")
    events = event_rows(read, directions, phases, days)
    _overwrite(events, f"{store}/events")
    _overwrite(node_rows(read), f"{store}/node_definitions")
    _overwrite(summary(read, events), f"{store}/summary")
    counts = read.groupBy("raw_shard").agg(F.count_if(F.col("error").isNull()).alias("records"), F.count("error").alias("faulty"))
    todo.join(counts, "raw_shard", "left").select("source", "source_bytes", "raw_shard", F.coalesce("records", F.lit(0)).alias("records"), F.coalesce("faulty", F.lit(0)).alias("faulty")).write.mode("append").parquet(f"{store}/manifest")
    return manifest(spark, store)


def _overwrite(df: DataFrame, to: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("raw_shard").parquet(to)


def evidence(placed: DataFrame, wanted: DataFrame) -> DataFrame:
    """Raw lines at wanted places (source, raw_offset), with their record's id. Where wanted has expected_uuid, another id is an error."""
    checked = "expected_uuid" in wanted.columns
    places = wanted.select("source", "raw_offset", *(["expected_uuid"] if checked else [])).distinct()
    hits = records(placed.join(places, ["source", "raw_offset"], "left_semi"), text=True).select("source", "raw_line", "raw_offset", "value", "uuid")
    if not checked:
        return hits
    wrong = F.col("expected_uuid").isNotNull() & ~F.col("uuid").eqNullSafe(F.col("expected_uuid"))
    other = F.raise_error(F.concat_ws(" ", F.lit("another id than expected at"), "source", "raw_offset")).cast("binary")
    return hits.join(places, ["source", "raw_offset"]).withColumn("uuid", F.when(wrong, other).otherwise(F.col("uuid"))).drop("expected_uuid")
