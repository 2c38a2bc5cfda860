"""Comparison of predicted with true graphs, and the choice of a fixed depth."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def assign(weight: list[list[int]]) -> list[int]:
    """Column of each row (rows <= columns) in the assignment of largest total weight: shortest augmenting paths."""
    n, m = len(weight), len(weight[0]) if weight else 0
    top = max((w for row in weight for w in row), default=0)
    row_price, col_price, owner = [0] * (n + 1), [0] * (m + 1), [0] * (m + 1)
    for row in range(1, n + 1):
        owner[0], col = row, 0
        slack: list[int | None] = [None] * (m + 1)
        came, done = [0] * (m + 1), [False] * (m + 1)
        while owner[col]:
            done[col], here, step, nxt = True, owner[col], None, 0
            for c in range(1, m + 1):
                if not done[c]:
                    cost = top - weight[here - 1][c - 1] - row_price[here] - col_price[c]
                    if slack[c] is None or cost < slack[c]:
                        slack[c], came[c] = cost, col
                    if step is None or slack[c] < step:
                        step, nxt = slack[c], c
            for c in range(m + 1):
                if done[c]:
                    row_price[owner[c]] += step
                    col_price[c] -= step
                elif slack[c] is not None:
                    slack[c] -= step
            col = nxt
        while col:
            owner[col] = owner[came[col]]
            col = came[col]
    out = [-1] * n
    for c in range(1, m + 1):
        if owner[c]:
            out[owner[c] - 1] = c - 1
    return out


def match_graphs(pairs: DataFrame) -> DataFrame:
    """One-to-one pairs of a run (run, truth_id, pred_id) with the largest total of `shared`, then of `overlap_ns`; ids decide ties.
    Pairs that share no node are not matched. A run has some dozens of graphs."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = sorted(set(pdf["truth_id"])), sorted(set(pdf["pred_id"]))
        turned = len(a) > len(b)
        rows, cols = (b, a) if turned else (a, b)
        big = int(pdf["overlap_ns"].sum()) + 1
        weight = [[0] * len(cols) for _ in rows]
        for t, p, s, o in pdf[["truth_id", "pred_id", "shared", "overlap_ns"]].itertuples(index=False):
            weight[rows.index(p if turned else t)][cols.index(t if turned else p)] = int(s) * big + int(o)
        got = [(r, cols[c]) for r, c, w in zip(rows, assign(weight), weight, strict=True) if w[c] >= big]
        return pd.DataFrame([(pdf["run"].iloc[0], *(x[::-1] if turned else x)) for x in got], columns=["run", "truth_id", "pred_id"])

    return pairs.where("shared > 0 and overlap_ns > 0").groupBy("run").applyInPandas(run, "run string, truth_id string, pred_id string")


def _sets(graphs: DataFrame, items: DataFrame, gid: str, name: str) -> DataFrame:
    return graphs.select("run", gid).join(items.select("run", F.col("graph_id").alias(gid), "item").distinct(), ["run", gid], "left").groupBy("run", gid).agg(F.count("item").alias(name))


def graph_jaccard(truth: DataFrame, pred: DataFrame, truth_nodes: DataFrame, pred_nodes: DataFrame, truth_edges: DataFrame, pred_edges: DataFrame) -> DataFrame:
    """Per run: graphs, matched pairs, and node and edge Jaccard averaged over matched pairs and unmatched graphs (0 each).

    truth, pred: run, graph_id, start_ns, end_ns; nodes and edges: run, graph_id, item. Graphs can be matched if
    their half-open times overlap. Shared items are counted by a join on the item, not by pairing graphs.
    """
    t = truth.select("run", F.col("graph_id").alias("truth_id"), F.col("start_ns").alias("ts"), F.col("end_ns").alias("te"))
    p = pred.select("run", F.col("graph_id").alias("pred_id"), F.col("start_ns").alias("ps"), F.col("end_ns").alias("pe"))

    def shared(a: DataFrame, b: DataFrame) -> DataFrame:
        left, right = a.select("run", F.col("graph_id").alias("truth_id"), "item").distinct(), b.select("run", F.col("graph_id").alias("pred_id"), "item").distinct()
        return left.join(right, ["run", "item"]).groupBy("run", "truth_id", "pred_id").agg(F.count(F.lit(1)).alias("shared"))

    nodes = shared(truth_nodes, pred_nodes)
    pairs = nodes.join(t, ["run", "truth_id"]).join(p, ["run", "pred_id"]).withColumn("overlap_ns", F.least("te", "pe") - F.greatest("ts", "ps"))
    matched = match_graphs(pairs.select("run", "truth_id", "pred_id", "shared", "overlap_ns"))

    def jaccard(both: DataFrame, a: DataFrame, b: DataFrame, name: str) -> DataFrame:
        out = matched.join(both, ["run", "truth_id", "pred_id"], "left").join(_sets(t, a, "truth_id", "x"), ["run", "truth_id"]).join(_sets(p, b, "pred_id", "y"), ["run", "pred_id"])
        s = F.coalesce("shared", F.lit(0))
        return out.groupBy("run").agg(F.sum(F.coalesce(F.try_divide(s, F.col("x") + F.col("y") - s), F.lit(0.0))).alias(name), F.count(F.lit(1)).alias(f"{name}_pairs"))

    sizes = t.groupBy("run").agg(F.count(F.lit(1)).alias("n_truth")).join(p.groupBy("run").agg(F.count(F.lit(1)).alias("n_pred")), "run", "full").na.fill(0)
    out = sizes.join(jaccard(nodes, truth_nodes, pred_nodes, "nj"), "run", "left").join(jaccard(shared(truth_edges, pred_edges), truth_edges, pred_edges, "ej"), "run", "left").na.fill(0)
    every = F.col("n_truth") + F.col("n_pred") - F.col("nj_pairs")
    return out.select("run", "n_truth", "n_pred", F.col("nj_pairs").alias("n_matched"), (F.col("nj") / every).alias("node_jaccard"), (F.col("ej") / every).alias("edge_jaccard"))


def fixed_depth(depths: DataFrame, by: str, depth: str = "depth") -> DataFrame:
    """Per group the smallest k whose mean absolute distance to the depths is least (the lower median), and that distance."""
    k = depths.groupBy(by).agg(F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {depth})").cast("long").alias("k"))
    return depths.join(F.broadcast(k), by).groupBy(by).agg(F.first("k").alias("k"), F.avg(F.abs(F.col(depth) - F.col("k"))).alias("mean_distance"))
