"""Calibration, selection and evaluation of node scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: Buckets that the values of a key are dealt into, in order, by empirical_percentile().
BUCKETS = 256


def empirical_percentile(reference: DataFrame, query: DataFrame, key: str, value: str = "score") -> DataFrame:
    """q = share of reference values of the same key that are at most the value; null without a reference.

    Counts of distinct (key, value) are dealt, in order, into BUCKETS buckets of each key, at values that quantiles of the
    reference give. Running sums inside a bucket and over the few buckets before it add up to q, so no task sorts all
    values of a key, and rows move only to meet the q of their value.
    """
    points = reference.groupBy(key).agg(F.percentile_approx(value, [i / BUCKETS for i in range(1, BUCKETS)], 10_000).alias("points"))
    points = F.broadcast(points.withColumn("points", F.array_distinct("points")))  # one row a key
    both = reference.groupBy(key, value).agg(F.count(F.lit(1)).alias("m")).unionByName(query.groupBy(key, value).agg(F.lit(0).cast("long").alias("m")))
    both = both.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.sum("m").alias("m")).join(points, key).withColumn("bucket", F.size(F.filter("points", lambda p: p < F.col(value)))).drop("points")
    inside = both.withColumn("upto", F.sum("m").over(Window.partitionBy(key, "bucket").orderBy(value)))
    totals = both.groupBy(key, "bucket").agg(F.sum("m").alias("m"))
    earlier = Window.partitionBy(key).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(key, "bucket", F.coalesce(F.sum("m").over(earlier), F.lit(0)).alias("before"), F.sum("m").over(Window.partitionBy(key)).alias("all"))
    share = inside.join(totals, [key, "bucket"]).select(key, value, ((F.col("upto") + F.col("before")) / F.nullif("all", F.lit(0))).alias("q"))
    return query.join(share, [key, value], "left")


def median_mad(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Exact median and 1.4826 times the median absolute deviation; tiny scales give way to the median of the others, else 1."""
    center = rows.groupBy(key).agg(F.median(value).alias("center"))
    scale = rows.join(center, key).groupBy(key).agg(F.first("center").alias("center"), (F.lit(1.4826) * F.median(F.abs(F.col(value) - F.col("center")))).alias("scale"))
    usual = scale.where("scale > 1e-6").agg(F.median("scale").alias("usual"))
    return scale.crossJoin(F.broadcast(usual)).select(key, F.round("center", 6).alias("center"), F.round(F.when(F.col("scale") > 1e-6, F.col("scale")).otherwise(F.coalesce("usual", F.lit(1.0))), 6).alias("scale"))


def minmax(rows: DataFrame, scope: str, value: str = "score") -> DataFrame:
    """Values scaled to 0..1 inside their scope (0 where all are equal): an aggregation and a join, no sort of a scope."""
    ends = rows.groupBy(scope).agg(F.min(value).alias("low"), F.max(value).alias("high"))
    return rows.join(ends, scope).withColumn("scaled", F.when(F.col("high") > F.col("low"), (F.col(value) - F.col("low")) / (F.col("high") - F.col("low"))).otherwise(F.lit(0.0))).drop("low", "high")


def select_per_scope(rows: DataFrame, scope: str, threshold: float = 0.95, fraction: float = 0.075, cap: int = 256, anchor: float = 0.99, ties: tuple[str, ...] = ("node_uuid",)) -> DataFrame:
    """Rows over the threshold, at most min(cap, ceil(fraction of all rows of the scope)), by percentile and ties. Only rows over the threshold
    are ranked, and no more than cap of them leave their task (a window with a limit on its rank)."""
    budget = rows.groupBy(scope).agg(F.least(F.lit(cap), F.ceil(F.lit(fraction) * F.count(F.lit(1)))).cast("long").alias("budget"))
    rank = F.row_number().over(Window.partitionBy(scope).orderBy(F.desc("q"), *ties))
    some = rows.where(F.col("q") >= threshold).withColumn("rank", rank.cast("long")).where(F.col("rank") <= cap).join(budget, scope)
    return some.where("rank <= budget").withColumn("role", F.when(F.col("q") >= anchor, "anchor").otherwise("context_carrier"))


def select_evidence(candidates: DataFrame, context_threshold: float, anchor_threshold: float, cap: int, fraction: float) -> DataFrame:
    """candidates (pg_id, entity_id, percentile, stable_tie_id) by threshold, then budget: pg_id, entity_id, percentile, role, rank_within_pg, pg_budget.

    Settings out of range are an error at once; a percentile outside 0..1 and an entity that a scope has twice are errors when the query runs.
    """
    if not 0 <= context_threshold <= 1 or not context_threshold < anchor_threshold <= 1:
        raise ValueError("thresholds: 0 <= context < anchor <= 1")
    if cap < 1 or not 0 < fraction <= 1:
        raise ValueError("cap must be positive, fraction in (0, 1]")
    bad = ~F.col("percentile").between(0, 1) | F.col("percentile").isNull()
    once = candidates.groupBy("pg_id", "entity_id").agg(F.count(F.lit(1)).alias("n"), F.first("percentile").alias("percentile"), F.first("stable_tie_id").alias("stable_tie_id"))
    error = F.when(F.col("n") > 1, F.concat(F.lit("entity twice in a scope: "), "pg_id", F.lit("/"), "entity_id")).when(bad, F.concat(F.lit("percentile out of range: "), "entity_id"))
    checked = once.withColumn("percentile", F.when(error.isNotNull(), F.raise_error(error).cast("double")).otherwise(F.col("percentile")))
    out = select_per_scope(checked.withColumn("q", F.col("percentile")), "pg_id", context_threshold, fraction, cap, anchor_threshold, ("stable_tie_id", "entity_id"))
    return out.select("pg_id", "entity_id", "percentile", "role", F.col("rank").alias("rank_within_pg"), F.col("budget").alias("pg_budget"))


def top_fraction(rows: DataFrame, scope: str, fraction: float = 0.05) -> DataFrame:
    """At least one row a scope, no threshold."""
    keep = rows.groupBy(scope).agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) * F.lit(fraction))).alias("keep"))
    rank = F.row_number().over(Window.partitionBy(scope).orderBy(F.desc("score"), "node_uuid"))
    return rows.withColumn("rank", rank.cast("long")).join(keep, scope).where(F.col("rank") <= F.col("keep")).drop("keep")


def evaluate(scores: DataFrame, labels: DataFrame, budgets: tuple[int, ...] = (10, 50, 100), window: tuple[int, int] | None = None) -> DataFrame:
    """One row a variant: precision, recall and F1 of candidates over distinct nodes, and recall within the first nodes by score.

    scores: node_uuid, score, is_candidate, and if there variant, start_ns and end_ns (window keeps the intervals that overlap it). Ranks go
    no further than the largest budget: the first nodes of each variant are a limited window, not a sort of all nodes.
    """
    s = scores if "variant" in scores.columns else scores.withColumn("variant", F.lit("all"))
    if window:
        s = s.where((F.col("end_ns") > window[0]) & (F.col("start_ns") < window[1]))
    label = labels.select("node_uuid", F.lit(True).alias("label")).distinct()
    total = F.broadcast(label.agg(F.count(F.lit(1)).alias("labels")))  # one row
    nodes = s.where("node_uuid is not null").groupBy("variant", "node_uuid").agg(F.max("score").alias("score"), F.bool_or("is_candidate").alias("candidate"), F.count(F.lit(1)).alias("records")).join(label, "node_uuid", "left").withColumn("label", F.coalesce("label", F.lit(False)))
    first = nodes.withColumn("rank", F.row_number().over(Window.partitionBy("variant").orderBy(F.desc("score"), "node_uuid"))).where(F.col("rank") <= max(budgets))
    hits = first.groupBy("variant").agg(*(F.count_if(F.col("label") & (F.col("rank") <= b)).alias(f"hit_{b}") for b in budgets))
    out = nodes.groupBy("variant").agg(F.count(F.lit(1)).alias("nodes"), F.sum("records").alias("records"), F.count_if("candidate").alias("candidates"), F.count_if(F.col("candidate") & F.col("label")).alias("covered"), F.count_if(F.col("candidate") & ~F.col("label")).alias("unmatched")).join(hits, "variant").crossJoin(total)
    share = lambda x, of: F.coalesce(F.try_divide(F.col(x).cast("double"), F.col(of)), F.lit(0.0))
    precision, recall = share("covered", "candidates"), share("covered", "labels")
    f1 = F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))
    return out.select("variant", "nodes", "records", "candidates", "labels", "covered", "unmatched", F.round(precision, 6).alias("precision"), F.round(recall, 6).alias("recall"), F.round(f1, 6).alias("f1"), *(F.round(share(f"hit_{b}", "labels"), 6).alias(f"recall_at_{b}") for b in budgets))


def label_ranks(scores: DataFrame, labels: DataFrame) -> DataFrame:
    """variant, node_uuid, rank, percentile of each labelled node that has a score: rank = 1 + nodes before it (higher score, or equal and a
    smaller id), percentile = 1 - (rank - 1) / nodes. Counts of distinct scores take the place of a sort of all nodes."""
    s = scores if "variant" in scores.columns else scores.withColumn("variant", F.lit("all"))
    nodes = s.where("node_uuid is not null").groupBy("variant", "node_uuid").agg(F.max("score").alias("score"))
    label = nodes.join(labels.select("node_uuid").distinct(), "node_uuid", "left_semi")
    upto = empirical_percentile(nodes, label, "variant").select("variant", "node_uuid", "score", "q")
    size = nodes.groupBy("variant").agg(F.count(F.lit(1)).alias("n"))
    peers = nodes.join(label.select("variant", "score").distinct(), ["variant", "score"], "left_semi")
    tied = label.select("variant", "score", "node_uuid").join(peers.withColumnRenamed("node_uuid", "other"), ["variant", "score"]).groupBy("variant", "node_uuid").agg(F.count_if(F.col("other") < F.col("node_uuid")).alias("tied"))
    out = upto.join(F.broadcast(size), "variant").join(tied, ["variant", "node_uuid"])
    rank = (F.round((1 - F.col("q")) * F.col("n")) + F.col("tied") + 1).cast("long")
    return out.select("variant", "node_uuid", rank.alias("rank"), (1 - (rank - 1) / F.col("n")).alias("percentile"))


def top_deviations(rows: DataFrame, names: list[str], limit: int = 5, vector: str = "standardized") -> DataFrame:
    """rows with `top`: the `limit` coordinates of largest absolute value, as structs (feature, standardized_deviation); ties by place."""
    each = F.transform(F.col(vector), lambda x, i: F.struct((-F.abs(x)).alias("k"), i.alias("i"), F.element_at(F.array(*map(F.lit, names)), i + 1).alias("feature"), x.alias("standardized_deviation")))
    return rows.withColumn("top", F.transform(F.slice(F.array_sort(each), 1, limit), lambda x: F.struct(x["feature"].alias("feature"), x["standardized_deviation"].alias("standardized_deviation"))))
