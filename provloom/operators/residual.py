"""Residuals of entity types: shrinkage covariance, quadratic scores, calibration."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scoring import empirical_percentile
from .shared import settled

#: Key of the model over all types.
POOLED = -1


def _partials(rows: DataFrame, fn, schema: str) -> DataFrame:
    """fn(type, matrix) -> output columns, for each type of each batch."""

    def run(batches):
        for b in batches:
            t = b.column("t").to_numpy(zero_copy_only=False)
            x = np.array(b.column("x").to_pylist(), np.float64)
            for k in np.unique(t):
                yield pa.RecordBatch.from_pydict(fn(int(k), x[t == k]))

    return rows.mapInArrow(run, schema)


def shrinkage_models(rows: DataFrame, type_col: str = "entity_type_id", vec_col: str = "residual", n_min: int = 1, pooled: bool = False) -> dict[int, dict]:
    """Per type with n_min rows or more, and for all types together as POOLED if asked: center, precision, n.

    The Ledoit-Wolf estimate needs count, mean, second moments and the sum of squared squared norms. Two passes
    make them as partial sums that Spark adds up; what reaches the driver is types x width x width numbers.
    """
    data = rows.select(F.col(type_col).cast("int").alias("t"), F.col(vec_col).cast("array<double>").alias("x"))
    if pooled:
        data = data.unionByName(data.withColumn("t", F.lit(POOLED)))
    bad = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    check = data.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(bad, F.lit(True))).alias("bad"))
    n_all, n_bad = check.first()
    if n_bad or n_all < (4 if pooled else 1):
        raise ValueError("too few or non-finite residuals")
    first = _partials(data, lambda k, x: {"t": pa.array([k] * x.shape[1], pa.int32()), "i": pa.array(range(x.shape[1]), pa.int32()), "s": x.sum(axis=0), "n": pa.array([len(x)] * x.shape[1], pa.int64())}, "t int, i int, s double, n long")
    sums = first.groupBy("t", "i").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).orderBy("t", "i").collect()
    count = {r["t"]: r["n"] for r in sums if r["n"] >= n_min or r["t"] == POOLED}
    mean = {k: np.array([r["s"] / r["n"] for r in sums if r["t"] == k]) for k in count}

    def second(k: int, x: np.ndarray) -> dict:
        if k not in mean:
            return {"t": pa.array([], pa.int32()), "i": pa.array([], pa.int32()), "j": pa.array([], pa.int32()), "s": pa.array([], pa.float64())}
        c, p = x - mean[k], x.shape[1]
        i, j = np.divmod(np.arange(p * p), p)
        fourth = float(((c * c).sum(axis=1) ** 2).sum())
        return {"t": pa.array([k] * (p * p + 1), pa.int32()), "i": pa.array([*i, -1], pa.int32()), "j": pa.array([*j, -1], pa.int32()), "s": np.append((c.T @ c).ravel(), fourth)}

    moments = _partials(data, second, "t int, i int, j int, s double").groupBy("t", "i", "j").agg(F.sum("s").alias("s")).collect()
    models = {}
    for k, n in count.items():
        p, fourth = len(mean[k]), 0.0
        cov = np.zeros((p, p))
        for r in moments:
            if r["t"] == k and r["i"] >= 0:
                cov[r["i"], r["j"]] = r["s"] / n
            elif r["t"] == k:
                fourth = r["s"]
        models[k] = {"center": mean[k], "precision": np.linalg.pinv(shrunk(cov, fourth, n), hermitian=True), "n": n}
    return models


def shrunk(cov: np.ndarray, fourth: float, n: int) -> np.ndarray:
    """The covariance (divided by n) pulled to its mean variance. fourth: sum of the 4th powers of the centered rows' norms."""
    p = len(cov)
    level = np.trace(cov) / p
    spread = ((cov - level * np.eye(p)) ** 2).sum() / p
    noise = min((fourth / n - (cov**2).sum()) / (n * p), spread)
    weight = noise / spread if p > 1 and noise > 0 else 0.0
    return (1 - weight) * cov + weight * level * np.eye(p)


def quadratic_scores(rows: DataFrame, models: dict[int, dict], type_col: str = "entity_type_id", vec_col: str = "residual", fallback: bool = True) -> DataFrame:
    """rows with score (quadratic form; at least 0 with fallback) and contributions (its summands, which may be negative).
    Types without a model use POOLED, or are an error without fallback."""
    small = {k: (m["center"], m["precision"]) for k, m in models.items()}

    @F.pandas_udf("struct<score: double, contributions: array<double>>")
    def score(t, x):
        import pandas as pd

        total, parts = np.zeros(len(t)), [None] * len(t)
        kinds = t.to_numpy()
        for k in np.unique(kinds):
            if int(k) not in small and not fallback:
                raise ValueError(f"no model for entity type {k}")
            center, precision = small[int(k)] if int(k) in small else small[POOLED]
            at = np.flatnonzero(kinds == k)
            c = np.stack(x.iloc[at].tolist()) - center
            part = c * (c @ precision)
            total[at] = part.sum(axis=1)
            for i, row in zip(at, part, strict=True):
                parts[i] = row
        return pd.DataFrame({"score": np.maximum(total, 0) if fallback else total, "contributions": parts})

    return rows.withColumn("_s", score(F.col(type_col).cast("int"), F.col(vec_col).cast("array<double>"))).withColumns({"score": F.col("_s.score"), "contributions": F.col("_s.contributions")}).drop("_s")


def calibrated(reference: DataFrame, rows: DataFrame, models: dict[int, dict], type_col: str = "entity_type_id", vec_col: str = "residual", n_min: int = 128) -> DataFrame:
    """rows with score, contributions and q, the share of reference scores that are at most the score.

    A type with a model and n_min reference rows or more is held against its own reference, all others are scored
    by the pooled model and held against the pooled scores of all reference rows.
    """
    many = {r[0] for r in reference.groupBy(F.col(type_col).cast("int")).count().where(F.col("count") >= n_min).collect()}
    own = sorted(many & set(models) - {POOLED})
    key = F.when(F.col(type_col).isin(own), F.col(type_col).cast("int")).otherwise(POOLED) if own else F.lit(POOLED)
    ref = reference.withColumn("_key", F.lit(POOLED))
    if own:
        ref = ref.unionByName(reference.where(F.col(type_col).isin(own)).withColumn("_key", F.col(type_col).cast("int")))
    scored = settled(quadratic_scores(ref, models, "_key", vec_col).select("_key", "score"))
    asked = settled(quadratic_scores(rows.withColumn("_key", key), models, "_key", vec_col))  # scored once, read several times
    return empirical_percentile(scored, asked, "_key").drop("_key")
