"""Uniform shuffle into shards of exact sizes through a hypergeometric communication matrix."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import id_and_text, stored

#: Rows that one local permutation sorts (about), and the least number of source buckets and of slot ranges.
BUCKET_ROWS = 1 << 20
LEAST_BUCKETS = 64
LEAST_RANGES = 16
#: Rows of the matrix that may be broadcast (each holds one number for each shard).
BROADCAST_ROWS = 4096


def draw(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """Of n rows taken from good + bad without replacement, the number of good ones."""
    if good + bad < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, n)) if n else 0
    low, high = max(0, n - bad), min(n, good)  # too large for the library: inversion outward from the mode
    mode = min(max(((n + 1) * (good + 1)) // (good + bad + 2), low), high)
    lf = lambda a, b: math.lgamma(a + 1) - math.lgamma(b + 1) - math.lgamma(a - b + 1)
    p = math.exp(lf(good, mode) + lf(bad, n - mode) - lf(good + bad, n))
    u, up, down, i, j = rng.random() - p, p, p, mode, mode
    while u > 0 and (i < high or j > low):
        if i < high:
            up *= (good - i) * (n - i) / ((i + 1) * (bad - n + i + 1))
            i += 1
            u -= up
            if u <= 0:
                return i
        if j > low:
            down *= j * (bad - n + j) / ((good - j + 1) * (n - j + 1))
            j -= 1
            u -= down
            if u <= 0:
                return j
    return mode


def communication_matrix(bucket_rows: list[int], shard_rows: list[int], seed: int) -> np.ndarray:
    """Row b, column s: how many rows of bucket b go to shard s, as in a uniform shuffle of all rows."""
    rng, left = np.random.default_rng(seed), list(shard_rows)
    out = np.zeros((len(bucket_rows), len(shard_rows)), np.int64)
    for b, n in enumerate(bucket_rows):
        rest = sum(left)
        for s, room in enumerate(left):
            rest -= room
            k = draw(rng, room, rest, n)
            out[b, s], n = k, n - k
            left[s] -= k
    return out


def shuffle_to_shards(docs: DataFrame, shards: int = 40, seed: int = 17, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Law `rows`: shard sizes differ by one row at most, and every arrangement is equally likely (as far as the
    hash of a row is random). Rows are dealt to source buckets by their hash; the driver, which sees one count
    a bucket, draws the matrix; each bucket permutes its rows and cuts them by its matrix row; each shard
    permutes what it got, in ranges of a second hash so that no task holds a shard. All order comes from hashes
    of the row, so a task that runs again gives the same rows. Copies of a text are rows like others (a group
    may be larger than a shard). Null text: empty; null doc_id: one more value; rows equal in all columns are
    interchangeable; an empty table gives no rows.
    """
    text = F.coalesce("text", F.lit(""))
    base = id_and_text(docs, id_col, text_col).select("doc_id", (F.octet_length(text) + F.lit(16)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    key = [F.coalesce(F.col("doc_id"), F.lit(-1)), F.col("text_crc32"), F.col("size")]
    base = stored(base)
    total = base.count()
    buckets = max(LEAST_BUCKETS, -(-total // BUCKET_ROWS))
    ranges = max(LEAST_RANGES, -(-total // shards // BUCKET_ROWS))
    ties = ["doc_id", "text_crc32", "size"]
    base = base.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(buckets)).cast("int"))
    counts = {r[0]: r[1] for r in base.groupBy("bucket").count().collect()}
    rows = [counts.get(b, 0) for b in range(buckets)]
    matrix = communication_matrix(rows, [total // shards + (s < total % shards) for s in range(shards)], seed)
    cuts = base.sparkSession.createDataFrame([(b, np.cumsum(matrix[b]).tolist()) for b in range(buckets)], "bucket int, cuts array<long>")
    cuts = F.broadcast(cuts) if buckets <= BROADCAST_ROWS else cuts
    local = Window.partitionBy("bucket").orderBy(F.xxhash64(F.lit(seed + 1), *key), *ties)
    dealt = base.withColumn("at", F.row_number().over(local) - 1).join(cuts, "bucket").withColumn("shard", F.size(F.filter("cuts", lambda c: c <= F.col("at"))))
    dealt = stored(dealt.select(*ties, "shard", F.pmod(F.xxhash64(F.lit(seed + 2), *key), F.lit(ranges)).cast("int").alias("range")))
    before = dealt.groupBy("shard", "range").count().withColumn("before", F.coalesce(F.sum("count").over(Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = Window.partitionBy("shard", "range").orderBy(F.xxhash64(F.lit(seed + 3), *key), *ties)
    placed = dealt.withColumn("n", F.row_number().over(inside) - 1).join(before.select("shard", "range", "before"), ["shard", "range"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("before") + F.col("n")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
