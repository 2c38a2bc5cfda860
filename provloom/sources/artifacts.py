"""Written-once records of an investigation's rounds, file hashes, table properties and fingerprints."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The documents of a round and their files.
ROUND_FILES = {
    "campaign_snapshot": "campaign_snapshot.json", "scheduled_coi": "scheduled_coi.json", "retrieved_communities": "retrieved_communities.json", "lead_proposal_raw": "lead_proposal.raw.json",
    "lead_proposal_validated": "lead_proposal.validated.json", "assistant_task": "assistant_task.json", "assistant_verdict_raw": "assistant_verdict.raw.json", "assistant_verdict_validated": "assistant_verdict.validated.json",
    "resolved_witnesses": "resolved_witnesses.json", "witness_certificates": "witness_certificates.json", "ic_assessment": "ic_assessment.json", "frontiers": "frontiers.json", "control_action": "control_action.json",
    "ledger_delta": "ledger_delta.json", "backbone_before": "backbone_before.json", "backbone_after": "backbone_after.json", "scope_request": "scope_request.json", "usage_latency": "usage_latency.json",
}
# Properties of stored tables.
SCHEMA_VERSION = "1"
EVIDENCE_REFERENCE = "raw_shard+raw_line+raw_offset"


class Store:
    """Files in any store that Spark reaches, written by the driver."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.jvm = spark._jvm
        self.root = root.rstrip("/")
        self.fs = self.path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def write(self, name: str, content: bytes, again: bool = False) -> str:
        """Write beside the place and move there, so a reader sees all or nothing; returns the SHA-256. A file that is there is an error unless `again`."""
        if not again and self.exists(name):
            raise FileExistsError(f"{self.root}/{name} is there and may not change")
        part, target = self.path(f"{name}.part"), self.path(name)
        self.fs.mkdirs(target.getParent())
        out = self.fs.create(part, True)
        try:
            out.write(bytearray(content))
        finally:
            out.close()
        if again and self.fs.exists(target):
            self.fs.delete(target, False)
        if not self.fs.rename(part, target):
            raise OSError(f"cannot move {name} to its place")
        return hashlib.sha256(content).hexdigest()

    def read(self, name: str) -> bytes:
        source = self.fs.open(self.path(name))
        try:
            return bytes(source.readAllBytes())
        finally:
            source.close()


def encoded(value: Any) -> bytes:
    return json.dumps(value, indent=2, sort_keys=True, ensure_ascii=False).encode() + b"\n"


class Rounds:
    """Rounds of one investigation: exactly the ROUND_FILES each, none ever written twice."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.store = Store(spark, root)

    def write_manifest(self, manifest: Mapping[str, Any]) -> str:
        return self.store.write("manifest.json", encoded(dict(manifest)))

    def write_round(self, index: int, documents: Mapping[str, Any]) -> str:
        """Folder of the round, with a manifest of SHA-256 hashes."""
        if odd := sorted(set(ROUND_FILES) ^ set(documents)):
            raise ValueError(f"documents missing or unknown: {odd}")
        folder = f"rounds/round_{index:03d}"
        if self.store.exists(folder):
            raise FileExistsError(f"round {index} is there already")
        hashes = {name: self.store.write(f"{folder}/{file}", encoded(documents[name])) for name, file in ROUND_FILES.items()}
        self.store.write(f"{folder}/round_manifest.json", encoded({"round_index": index, "files": ROUND_FILES, "sha256": hashes}))
        return folder

    def read_round(self, index: int) -> dict[str, Any]:
        return {name: json.loads(self.store.read(f"rounds/round_{index:03d}/{file}")) for name, file in ROUND_FILES.items()}


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """source, bytes, sha256 of whole files (each read by one task)."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("source"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def with_properties(df: DataFrame, table: str) -> DataFrame:
    """df whose columns carry the table's properties, which Parquet files keep."""
    about = {"schema_version": SCHEMA_VERSION, "table": table, "evidence_reference": EVIDENCE_REFERENCE}
    return df.select(*(F.col(c).alias(c, metadata=about) for c in df.columns))


def properties(df: DataFrame) -> dict[str, str]:
    """What with_properties() has put on all columns of a table."""
    each = [f.metadata for f in df.schema.fields]
    return dict(each[0]) if each and all(m == each[0] for m in each) else {}


def event_type_fingerprint(event_types: Iterable[str]) -> str:
    return hashlib.sha256("\n".join(event_types).encode()).hexdigest()


def schema_fingerprint(df: DataFrame) -> str:
    """A hash of names, types and nullability, whatever properties the columns carry."""
    return hashlib.sha256(json.dumps([(f.name, f.dataType.jsonValue(), f.nullable) for f in df.schema.fields], separators=(",", ":")).encode()).hexdigest()


def alias(rows: DataFrame, prefix: str, id_col: str, *order: str) -> DataFrame:
    """rows with `ref`: prefix and a number of two digits or more, in order inside each round (a round's rows are few)."""
    from pyspark.sql.window import Window

    return rows.withColumn("ref", F.format_string(f"{prefix}%02d", F.row_number().over(Window.partitionBy("round").orderBy(*order, id_col))))


def compact(rows: DataFrame, *columns: str) -> DataFrame:
    """These columns of each row as one JSON document."""
    return rows.select(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("document"))


def array_store(features: DataFrame, edges: DataFrame, communities: DataFrame, to: str) -> None:
    """One row an interval: node ids, feature vectors, community numbers and weighted edges as arrays, in order of the node id. The bisection bounds an interval."""
    nodes = features.join(communities, ["pg_id", "node_uuid"]).groupBy("pg_id").agg(F.array_sort(F.collect_list(F.struct("node_uuid", "x", "label"))).alias("n"))
    links = edges.groupBy("pg_id").agg(F.array_sort(F.collect_list(F.struct("a", "b", "weight"))).alias("edges"))
    nodes.join(links, "pg_id", "left").select("pg_id", F.col("n.node_uuid").alias("node_uuid"), F.col("n.x").alias("x"), F.col("n.label").alias("community"), "edges").write.mode("errorifexists").option("compression", "zstd").parquet(to)
