"""Communities inside intervals: connected components and modularity communities of each interval."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import undirected_weights


def labelled(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """nodes with community_id, from labels (pg_id, node_uuid, label: number of the community in its interval)."""
    return nodes.join(labels, ["pg_id", "node_uuid"]).withColumn("community_id", F.format_string("d%02d:%s:c%05d", F.col("logical_day"), F.col("pg_id"), F.col("label"))).drop("label")


def roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of n nodes the smallest that it is connected with by links a-b."""
    root = np.arange(n)
    while True:  # hook the larger root to the smaller, then point everything at its root
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        open_ = low < high
        if not open_.any():
            return root
        np.minimum.at(root, high[open_], low[open_])
        while (root[root] != root).any():
            root = root[root]


def connected(nodes: DataFrame, compressed: DataFrame) -> DataFrame:
    """pg_id, node_uuid, label of connected components, numbered from 0 in each interval in order of their smallest node. Nodes without edges are alone.
    An interval is labelled in one task, so no number of rounds over the table bounds the length of a chain; the task holds the interval's nodes and each linked pair once."""
    pairs = compressed.select(F.col("pg_id").alias("pg"), F.least("src_uuid", "dst_uuid").alias("a"), F.greatest("src_uuid", "dst_uuid").alias("b")).distinct()
    mine = nodes.select(F.col("pg_id").alias("pg"), "node_uuid").distinct()

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        known = pd.Index(sorted(left["node_uuid"]))
        a, b = known.get_indexer(right["a"]), known.get_indexer(right["b"])
        both = (a >= 0) & (b >= 0)
        _, label = np.unique(roots(a[both], b[both], len(known)), return_inverse=True)
        return pd.DataFrame({"pg_id": key[0], "node_uuid": known, "label": label.astype(np.int32)})

    return mine.groupBy("pg").cogroup(pairs.groupBy("pg")).applyInPandas(run, "pg_id string, node_uuid string, label int")


def modularity(weights: dict[tuple[str, str], float], nodes: list[str], resolution: float = 1.0) -> dict[str, int]:
    """Communities of a small weighted graph: nodes move, in order, to the neighbouring community that raises modularity most (ties: the
    smallest), until none moves; then communities become nodes and it begins again. Parts of a community that are not connected are cut
    apart at the end. No randomness: the same graph always gives the same numbers."""
    around: dict[str, dict[str, float]] = {n: defaultdict(float) for n in nodes}
    for (a, b), w in weights.items():
        around[a][b] += w
        around[b][a] += w
    home = {n: n for n in sorted(nodes)}
    level, loops = {n: dict(m) for n, m in around.items()}, dict.fromkeys(nodes, 0.0)
    total = 2 * sum(weights.values())
    while total:
        order = sorted(level)
        strength = {n: sum(level[n].values()) + loops[n] for n in order}
        of, held = {n: n for n in order}, dict(strength)
        moved = True
        any_move = False
        while moved:
            moved = False
            for n in order:
                into: dict[str, float] = defaultdict(float)
                for m, w in level[n].items():
                    into[of[m]] += w
                mine = of[n]
                held[mine] -= strength[n]
                gain = {c: into.get(c, 0.0) - resolution * strength[n] * held[c] / total for c in {*into, mine}}
                best = min(gain, key=lambda c: (-round(gain[c], 12), c != mine, c))
                held[best] += strength[n]
                if best != mine and gain[best] > gain[mine] + 1e-12:
                    of[n], moved, any_move = best, True, True
                else:
                    held[best] -= strength[n]
                    held[mine] += strength[n]
        if not any_move:
            break
        first: dict[str, str] = {}
        for n in order:
            first.setdefault(of[n], n)
        up = {n: first[of[n]] for n in order}
        home = {n: up[h] for n, h in home.items()}
        joined: dict[str, dict[str, float]] = {c: defaultdict(float) for c in set(up.values())}
        inner: dict[str, float] = defaultdict(float)
        for n in order:
            inner[up[n]] += loops[n]
            for m, w in level[n].items():
                if up[n] == up[m]:
                    inner[up[n]] += w
                else:
                    joined[up[n]][up[m]] += w
        level, loops = {c: dict(m) for c, m in joined.items()}, {c: inner[c] for c in joined}
    # connected parts, numbered by their smallest node
    out: dict[str, int] = {}
    count = 0
    for n in sorted(nodes):
        if n in out:
            continue
        todo = [n]
        out[n] = count
        while todo:
            x = todo.pop()
            for m in around[x]:
                if m not in out and home[m] == home[x]:
                    out[m] = count
                    todo.append(m)
        count += 1
    return out


def modularity_communities(nodes: DataFrame, compressed: DataFrame, resolution: float = 1.0) -> DataFrame:
    """pg_id, node_uuid, label of modularity communities of log(1 + count) weights, interval by interval: the bisection bounds an interval's nodes, so a
    task's share is bounded. Without edges every node is alone."""
    w = undirected_weights(compressed, "pg_id").select(F.col("pg_id").alias("pg"), "a", "b", "weight")
    mine = nodes.select(F.col("pg_id").alias("pg"), "node_uuid").distinct()

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        mine = sorted(left["node_uuid"])
        known = set(mine)
        got = modularity({(a, b): x for a, b, x in right[["a", "b", "weight"]].itertuples(index=False) if a in known and b in known}, mine, resolution)
        return pd.DataFrame({"pg_id": key[0], "node_uuid": mine, "label": [got[n] for n in mine]})

    return mine.groupBy("pg").cogroup(w.groupBy("pg")).applyInPandas(run, "pg_id string, node_uuid string, label int")
