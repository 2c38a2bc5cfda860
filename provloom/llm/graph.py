"""Connected components of links between 64-bit ids, by rounds of small and large stars."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, batch, discard, stored


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (child, smallest id of its component) with the components of the links a-b."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(ids))
    while True:  # hook the larger root to the smaller, then point everything at its root
        low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
        open_ = low < high
        if not open_.any():
            break
        np.minimum.at(root, high[open_], low[open_])
        while (root[root] != root).any():
            root = root[root]
    child = np.flatnonzero(root != np.arange(len(ids)))
    return ids[child], ids[root[child]]


def thin(links: DataFrame) -> DataFrame:
    """Links (a, b) to a spanning forest of each partition; components stay the same."""

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n = 0
        for x in batches:
            held.append((x.column("a").to_numpy(), x.column("b").to_numpy()))
            n += x.num_rows
            if n > 500_000:
                held = [forest(*map(np.concatenate, zip(*held, strict=True)))]
                n = len(held[0][0])
        if held:
            a, b = forest(*map(np.concatenate, zip(*held, strict=True)))
            yield batch(a=(a, pa.int64()), b=(b, pa.int64()))

    return arrow_map(links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")), run, "a long, b long")


#: Links of one id from which its minimum is broadcast to them; with more links in all it grows, so that at most
#: 2 * MOST_HUBS ids (16 bytes each) ever are.
HUB_LINKS = 1000
MOST_HUBS = 200_000


def _to_minimum(links: DataFrame, low: DataFrame, hub: int) -> DataFrame:
    """links (a, b) with the minimum m of a from low (a, m, n), n being the number of links behind it: an id with over `hub` links never
    brings them into one task."""
    hubs = F.broadcast(low.where(F.col("n") > hub).select("a", "m"))
    tagged = links.join(hubs, "a", "left")
    rest = tagged.where("m is null").drop("m").join(low.where(F.col("n") <= hub).select("a", "m"), "a")
    return tagged.where("m is not null").unionByName(rest)


def components(links: DataFrame, most_rounds: int = 60, thinned: bool = False) -> DataFrame:
    """id, root (smallest id reachable) for every id in links (a, b); ids without links are not in it.

    thinned: the tasks that made the links have thinned them; another pass would only keep a second Python
    worker beside each of theirs.

    Each round takes every id's links to its smallest neighbour (large star: larger neighbours; small star: the
    id and its smaller ones), thinned within partitions first. Rounds grow with the logarithm of the longest
    chain. Links are kept in the shared folder between rounds, so nothing is gathered on the driver.
    """
    now = stored((links if thinned else thin(links)).where("a <> b").distinct())
    hub = max(HUB_LINKS, now.count() // MOST_HUBS)
    print_ = None
    for _ in range(most_rounds):
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).withColumn("m", F.least("a", "m"))
        large = _to_minimum(both.where("b > a"), low, hub).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = thin(large.where("a <> b")).distinct()
        mins = large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
        small = _to_minimum(large, mins, hub).select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        was, now = now, stored(small.where("a <> b").distinct())
        discard(was)
        mark = tuple(now.agg(F.count(F.lit(1)), F.sum(F.col("a").cast("decimal(38,0)")), F.sum(F.col("b").cast("decimal(38,0)"))).first())
        if mark == print_:
            # a star forest: every id has one link, to its root
            return now.select(F.col("a").alias("id"), F.col("b").alias("root")).union(now.select(F.col("b").alias("id"), F.col("b").alias("root"))).distinct()
        print_ = mark
    raise RuntimeError("links did not settle")
