"""Features of nodes inside an interval, their causal signatures, and robust scores of residuals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import graph
from .graph import ENTITY_TYPES, VOCABULARY

UNKNOWN = ENTITY_TYPES.index("UNKNOWN")
SCOPE = ("pg_id", "start_ns", "end_ns")


def typed(rows: DataFrame, types: DataFrame) -> DataFrame:
    """rows with entity_type and entity_type_id; nodes without a definition are UNKNOWN, never dropped."""
    out = rows.join(types.select("node_uuid", "entity_type", "entity_type_id"), "node_uuid", "left")
    return out.withColumns({"entity_type": F.coalesce("entity_type", F.lit("UNKNOWN")), "entity_type_id": F.coalesce("entity_type_id", F.lit(UNKNOWN))})


def node_features(touch: DataFrame, edge_rows: DataFrame, types: DataFrame, vocabulary: tuple[str, ...] = VOCABULARY) -> DataFrame:
    """One row a node and interval: counts by role, action counts and distribution, times as shares of the interval, degrees, type.

    touch and edge_rows have pg_id, start_ns and end_ns. Types outside the vocabulary count for roles and times only.
    """
    gaps = touch.groupBy(*SCOPE, "node_uuid").agg(
        *(F.count_if(F.col("role") == r).alias(f"{r}_count") for r in ("subject", "predicate", "predicate2")), F.array(*(F.count_if(F.col("event_type") == a) for a in vocabulary)).alias("action_counts"),
        F.count(F.lit(1)).alias("touches"), F.min("timestamp_ns").alias("first_ns"), F.max("timestamp_ns").alias("last_ns"),
    )
    longest = graph.longest_gaps(touch, "pg_id")
    out = typed(gaps.join(longest, ["pg_id", "node_uuid"], "left").join(graph.degrees(edge_rows, "pg_id"), ["pg_id", "node_uuid"], "left"), types)
    total = F.aggregate("action_counts", F.lit(0).cast("long"), lambda a, x: a + x)
    length = F.greatest(F.lit(1), F.col("end_ns") - F.col("start_ns"))
    span = F.col("last_ns") - F.col("first_ns")
    mean = F.when(F.col("touches") > 1, span / (F.col("touches") - 1)).otherwise(F.lit(0.0))
    counts = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("in_degree", "out_degree", "unique_neighbor_count")}
    out = out.withColumns({**counts, "event_count": total, "activity_span_ns": span, "mean_gap_ns": mean, "max_gap_ns": F.coalesce("max_gap_ns", F.lit(0)).cast("long")})
    out = out.withColumns({"action_distribution": F.transform("action_counts", lambda x: x / F.greatest(F.lit(1), F.col("event_count"))), "span_ratio": span / length, "mean_gap_ratio": F.col("mean_gap_ns") / length, "max_gap_ratio": F.col("max_gap_ns") / length})
    return out.drop("touches", "first_ns", "last_ns")


def one_hot(type_id: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(len(ENTITY_TYPES) - 1)), lambda i: (i == type_id).cast("double"))


def share(vector: Column) -> Column:
    """A vector of non-negative numbers divided by its sum; zeros where the sum is zero."""
    total = F.aggregate(vector, F.lit(0.0), lambda a, x: a + x)
    return F.transform(vector, lambda x: F.when(total > 0, x / total).otherwise(F.lit(0.0)))


def finite(vector: Column, what: str) -> Column:
    """The vector, or an error if a number of it is null, NaN or infinite."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(odd, F.raise_error(F.lit(f"{what} holds non-finite values")).cast("array<double>")).otherwise(vector)


def feature_matrix(nodes: DataFrame) -> DataFrame:
    """nodes with x: one-hot type, action distribution, three time ratios."""
    times = F.array("span_ratio", "mean_gap_ratio", "max_gap_ratio")
    return nodes.withColumn("x", finite(F.concat(one_hot(F.col("entity_type_id")), "action_distribution", times), "the feature matrix"))


def feature_names(vocabulary: tuple[str, ...] = VOCABULARY) -> list[str]:
    return [f"type:{t}" for t in ENTITY_TYPES] + [f"action:{a}" for a in vocabulary] + [f"temporal:{t}_ratio" for t in ("span", "mean_gap", "max_gap")]


def context_names(vocabulary: tuple[str, ...] = VOCABULARY) -> list[str]:
    ways = ("incoming", "outgoing")
    return [f"self_type:{t}" for t in ENTITY_TYPES] + [f"{w}_relation:{a}" for w in ways for a in vocabulary] + [f"{w}_neighbor_type:{t}" for w in ways for t in ENTITY_TYPES] + ["context:log_in_degree", "context:log_out_degree"]


def target_names(vocabulary: tuple[str, ...] = VOCABULARY) -> list[str]:
    return [f"behavior:{a}" for a in vocabulary] + ["role:subject", "role:predicate", "role:predicate2", "temporal:span", "temporal:mean_gap", "temporal:max_gap", "structure:event_count", "structure:in_degree", "structure:out_degree", "structure:unique_neighbors"]


def neighborhood(compressed: DataFrame, nodes: DataFrame, vocabulary: tuple[str, ...] = VOCABULARY) -> DataFrame:
    """pg_id, node_uuid and four arrays: sums of log(1 + count) over its incoming and outgoing edges by relation and by the type at the other end.

    Edges with an end that is no node of the interval, or of a type outside the vocabulary, do not count. One aggregation over both ends.
    """
    kind = nodes.select("pg_id", F.col("node_uuid").alias("other"), F.col("entity_type_id").alias("other_type"))
    e = compressed.where(F.col("event_type").isin(*vocabulary)).withColumn("weight", F.log1p("event_count"))
    ends = F.inline(F.array(F.struct(F.col("dst_uuid").alias("node_uuid"), F.col("src_uuid").alias("other"), F.lit("incoming").alias("way")), F.struct(F.col("src_uuid").alias("node_uuid"), F.col("dst_uuid").alias("other"), F.lit("outgoing").alias("way"))))
    both = e.select("pg_id", "event_type", "weight", ends).join(kind, ["pg_id", "other"]).join(nodes.select("pg_id", "node_uuid"), ["pg_id", "node_uuid"], "left_semi")
    total = lambda test: F.coalesce(F.sum(F.when(test, F.col("weight"))), F.lit(0.0))
    made = []
    for way in ("incoming", "outgoing"):
        mine = F.col("way") == way
        made += [F.array(*(total(mine & (F.col("event_type") == a)) for a in vocabulary)).alias(f"{way}_relations"), F.array(*(total(mine & (F.col("other_type") == i)) for i in range(len(ENTITY_TYPES)))).alias(f"{way}_types")]
    return both.groupBy("pg_id", "node_uuid").agg(*made)


def signatures(nodes: DataFrame, compressed: DataFrame, vocabulary: tuple[str, ...] = VOCABULARY) -> DataFrame:
    """nodes with context (self type, relations and neighbour types both ways, degrees) and target (behaviour, roles, times, structure). Ids are used to join only."""
    around = neighborhood(compressed, nodes, vocabulary)
    none = lambda n: F.array(*[F.lit(0.0)] * n)
    out = nodes.join(around, ["pg_id", "node_uuid"], "left")
    parts = [share(F.coalesce(f"{w}_{k}", none(n))) for k, n in (("relations", len(vocabulary)), ("types", len(ENTITY_TYPES))) for w in ("incoming", "outgoing")]
    log = lambda *c: F.array(*(F.log1p(x) for x in c))
    roles = share(F.array(*(F.col(f"{r}_count").cast("double") for r in ("subject", "predicate", "predicate2"))))
    times = F.array("span_ratio", "mean_gap_ratio", "max_gap_ratio")
    context = F.concat(one_hot(F.col("entity_type_id")), *parts, log("in_degree", "out_degree"))
    target = F.concat("action_distribution", roles, times, log("event_count", "in_degree", "out_degree", "unique_neighbor_count"))
    return out.withColumns({"context": finite(context, "the context"), "target": finite(target, "the target")}).drop(*(f"{w}_{k}" for w in ("incoming", "outgoing") for k in ("relations", "types")))


def residual_calibration(rows: DataFrame, vector: str = "residual") -> DataFrame:
    """One row: center (median) and scale (1.4826 times the median absolute deviation) of each coordinate; a scale of 1e-6 or less gives way to the
    median of the larger ones, else to 1. Exact percentiles are aggregations of distinct values."""
    long = rows.select(F.posexplode(vector).alias("i", "x"))
    center = long.groupBy("i").agg(F.median("x").alias("center"))
    scale = long.join(F.broadcast(center), "i").groupBy("i").agg(F.first("center").alias("center"), (F.lit(1.4826) * F.median(F.abs(F.col("x") - F.col("center")))).alias("scale"))
    one = scale.agg(F.array_sort(F.collect_list(F.struct("i", "center", "scale"))).alias("s"), F.median(F.when(F.col("scale") > 1e-6, F.col("scale"))).alias("usual"))  # one row a coordinate
    return one.select(F.transform("s", lambda x: x["center"]).alias("center"), F.transform("s", lambda x: F.when(x["scale"] > 1e-6, x["scale"]).otherwise(F.coalesce("usual", F.lit(1.0)))).alias("scale"))


def robust_scores(rows: DataFrame, calibration: DataFrame, vector: str = "residual") -> DataFrame:
    """rows with standardized (|x - center| / scale for each coordinate) and score, their mean. calibration: one row of residual_calibration()."""
    z = F.transform(F.arrays_zip(F.col(vector).alias("x"), F.col("center").alias("c"), F.col("scale").alias("s")), lambda v: F.abs(v["x"] - v["c"]) / v["s"])
    out = rows.crossJoin(F.broadcast(calibration)).withColumn("standardized", z).drop("center", "scale")
    return out.withColumn("score", F.aggregate("standardized", F.lit(0.0), lambda a, x: a + x) / F.size("standardized"))
