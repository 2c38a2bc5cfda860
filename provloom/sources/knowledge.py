"""Small inputs and outputs: a STIX bundle of techniques, TOML settings, JSON documents."""

from __future__ import annotations

import json
import tomllib
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The fields of a bundle's objects that are read, and the form of a technique's id.
OBJECT = "type string, id string, name string, description string, modified string, revoked boolean, x_mitre_deprecated boolean, x_mitre_version string, kill_chain_phases array<struct<phase_name string>>, external_references array<struct<external_id string>>"
TECHNIQUE_ID = r"^T\d{4}(\.\d{3})?$"


def bundle(spark: SparkSession, path: str) -> DataFrame:
    schema = f"objects array<struct<{OBJECT.replace(' string', ': string').replace(' boolean', ': boolean').replace(' array', ': array')}>>"
    return spark.read.schema(schema).option("multiLine", True).json(path).select(F.inline("objects"))


def bundle_version(objects: DataFrame) -> str:
    found = objects.where("type = 'x-mitre-collection'").select("x_mitre_version").first()
    if found is None:
        raise ValueError("the bundle has no collection")
    return str(found[0])


def techniques(objects: DataFrame) -> DataFrame:
    """technique_id, name, tactics (sorted), description, stix_id, modified: those neither revoked nor deprecated whose first well-formed external id exists."""
    ids = F.filter(F.transform("external_references", lambda r: r["external_id"]), lambda x: x.rlike(TECHNIQUE_ID))
    rows = objects.where("type = 'attack-pattern' and not coalesce(revoked, false) and not coalesce(x_mitre_deprecated, false)").withColumn("technique_id", F.try_element_at(ids, F.lit(1)))
    tactics = F.array_sort(F.coalesce(F.transform("kill_chain_phases", lambda p: p["phase_name"]), F.array().cast("array<string>")))
    return rows.where("technique_id is not null").select("technique_id", "name", tactics.alias("tactics"), F.coalesce("description", F.lit("")).alias("description"), F.col("id").alias("stix_id"), "modified").orderBy("technique_id")


def settings(spark: SparkSession, path: str) -> dict[str, Any]:
    """A TOML file from any store that Spark reads."""
    return tomllib.loads("".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))


def write_json(spark: SparkSession, value: Any, to: str) -> None:
    """Keys sorted; written beside its place and moved there, so a reader sees all of it or nothing."""
    jvm = spark._jvm
    target, part = jvm.org.apache.hadoop.fs.Path(to), jvm.org.apache.hadoop.fs.Path(f"{to}.{uuid.uuid4().hex}.tmp")
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(part, True)
    try:
        out.write(bytearray(json.dumps(value, sort_keys=True, indent=2).encode()))
    finally:
        out.close()
    if fs.exists(target):
        fs.delete(target, False)
    if not fs.rename(part, target):
        raise OSError(f"cannot move {part} to {to}")
