"""Exact dedup: binary fuse filters of a snapshot screen the digests of a new batch."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROW, arrow_map, batch, numbered, placed, rows_of, stored, without

#: Keys of one filter (about), rows of digests in one Arrow batch, and the most ids that may be broadcast (8 bytes each).
FILTER_KEYS = 200_000
DIGEST_ROWS = 2048
BROADCAST_IDS = 20_000


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class FuseFilter:
    """Three-wise binary fuse filter with 16-bit fingerprints over distinct 64-bit keys: no false negatives, about 1 in 65536 false positives."""

    def __init__(self, seed: int, segment: int, segments: int, table: np.ndarray) -> None:
        self.seed, self.segment, self.segments, self.table = seed, segment, segments, table

    @staticmethod
    def _places(keys: np.ndarray, seed: int, segment: int, segments: int) -> tuple[np.ndarray, np.ndarray]:
        h = mix(keys + np.uint64(seed))
        first = ((h >> np.uint64(32)) * np.uint64(segments) >> np.uint64(32)).astype(np.int64) * segment
        mask = np.uint64(segment - 1)
        low = [(h & mask).astype(np.int64), ((h >> np.uint64(18)) & mask).astype(np.int64), (mix(h) & mask).astype(np.int64)]
        return np.stack([first + low[0], first + segment + low[1], first + 2 * segment + low[2]]), (mix(h ^ np.uint64(0x9E3779B97F4A7C15)) & np.uint64(0xFFFF)).astype(np.uint16)

    @classmethod
    def build(cls, keys: np.ndarray) -> FuseFilter:
        keys = np.unique(keys.astype(np.uint64))
        n = len(keys)
        segment = 1 << min(18, max(2, int(math.log(max(n, 2)) / math.log(3.33) + 2.25)))
        room = int(max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(n, 3))) * n)
        segments = max(1, -(-room // segment) - 2)
        for seed in range(1, 200):
            where, mark = cls._places(keys, seed, segment, segments)
            table = cls._assign(where, mark, segment * (segments + 2))
            if table is not None:
                return cls(seed, segment, segments, table)
            if seed % 20 == 0:
                segments += max(1, segments // 10)
        raise ValueError("no filter found")

    @staticmethod
    def _assign(where: np.ndarray, mark: np.ndarray, size: int) -> np.ndarray | None:
        """Peel all keys that are alone in some place, round by round; None if a core is left."""
        count = np.bincount(where.ravel(), minlength=size)
        total = np.zeros(size, np.int64)
        for row in where:
            np.add.at(total, row, np.arange(where.shape[1]))
        alive, rounds = np.ones(where.shape[1], bool), []
        while alive.any():
            spot = np.flatnonzero(count == 1)
            who = total[spot]
            who, pick = np.unique(who, return_index=True)
            if not len(who):
                return None
            rounds.append((who, spot[pick]))
            alive[who] = False
            for row in where[:, who]:
                np.subtract.at(count, row, 1)
                np.subtract.at(total, row, who)
        table = np.zeros(size, np.uint16)
        for who, spot in reversed(rounds):
            table[spot] = 0
            table[spot] = mark[who] ^ table[where[0, who]] ^ table[where[1, who]] ^ table[where[2, who]]
        return table

    def holds(self, keys: np.ndarray) -> np.ndarray:
        where, mark = self._places(keys.astype(np.uint64), self.seed, self.segment, self.segments)
        return (self.table[where[0]] ^ self.table[where[1]] ^ self.table[where[2]]) == mark


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row key, text_sha256, key (its first 64 bits), n_bytes of each text of placed docs, A-Z lower-cased (in UTF-8 no other byte is one of A-Z)."""

    def run(batches):
        for whole in batches:
            for i in range(0, whole.num_rows, DIGEST_ROWS):
                b = whole.slice(i, DIGEST_ROWS)
                texts = [t for _, t in rows_of([b])]
                d = [hashlib.sha256(t.lower()) for t in texts]
                place = {c: (b.column(c), pa.int64()) for c in ("doc_id", *ROW)}
                yield batch(**place, text_sha256=([x.hexdigest() for x in d], pa.string()), key=([int.from_bytes(x.digest()[:8], "big", signed=True) for x in d], pa.int64()), n_bytes=([len(t) for t in texts], pa.int64()))

    return arrow_map(numbered(docs, id_col, text_col), run, "doc_id long, row_file long, row_at long, text_sha256 string, key long, n_bytes long")


def build_filters(snapshot: DataFrame, shards: int) -> DataFrame:
    """One filter for each shard of a snapshot's keys."""

    def build(t: pa.Table) -> pa.Table:
        f = FuseFilter.build(t.column("key").to_numpy().view(np.uint64))
        return pa.table({"part": t.column("part").slice(0, 1), "seed": pa.array([f.seed], pa.int64()), "segment": pa.array([f.segment], pa.int64()), "segments": pa.array([f.segments], pa.int64()), "filter": pa.array([f.table.tobytes()], pa.binary())})

    return snapshot.select(F.pmod(F.col("key"), F.lit(shards)).cast("int").alias("part"), "key").groupBy("part").applyInArrow(build, "part int, seed long, segment long, segments long, filter binary")


def screen(incoming: DataFrame, filters: DataFrame, shards: int) -> DataFrame:
    """Rows of incoming (with a column key) with `hit`: whether the filter of their shard may hold them."""
    keyed = incoming.withColumn("part", F.pmod(F.col("key"), F.lit(shards)).cast("int"))
    fields = keyed.schema

    def probe(left: pa.Table, right: pa.Table) -> pa.Table:
        hit = np.zeros(left.num_rows, bool)
        if left.num_rows and right.num_rows:
            (r,) = right.to_pylist()
            f = FuseFilter(r["seed"], r["segment"], r["segments"], np.frombuffer(r["filter"], np.uint16))
            hit = f.holds(left.column("key").to_numpy().view(np.uint64))
        return left.append_column("hit", pa.array(hit))

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields)
    return keyed.groupBy("part").cogroup(filters.groupBy("part")).applyInArrow(probe, f"{kinds}, hit boolean")


def same_bytes(docs: DataFrame, pairs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of pairs (a, b: structs with a row key) those whose lower-cased texts are equal byte by byte. One pair a group of copies, so few texts move."""
    texts = numbered(docs, id_col, text_col)
    rows = pairs.select(F.explode(F.array(*(F.struct(*(F.col(f"{x}.{c}").alias(c) for c in ROW)) for x in "ab"))).alias("r")).select("r.*").distinct()
    if rows.count() <= BROADCAST_IDS:
        rows = F.broadcast(rows)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    wanted = texts.join(rows, list(ROW), "left_semi").select(*ROW, F.translate(F.coalesce("text", F.lit("")), letters, letters.lower()).alias("t"))

    def side(x: str) -> DataFrame:
        return wanted.select(*(F.col(c).alias(f"{x}_{c}") for c in ROW), F.col("t").alias(f"{x}_t"))

    out = pairs.select("*", *(F.col(f"{x}.{c}").alias(f"{x}_{c}") for x in "ab" for c in ROW))
    for x in "ab":
        out = out.join(side(x), [f"{x}_{c}" for c in ROW])
    return out.where(F.col("a_t") == F.col("b_t")).select(pairs.columns)


def exact_rows(docs: DataFrame, is_new=None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """exact_groups() of placed docs with each row's key, and `chosen`: whether it is the one row of its group that a deduplicated table holds."""
    is_new = F.pmod(F.coalesce(F.col("doc_id"), F.lit(0)), F.lit(2)) == 1 if is_new is None else is_new
    rows = stored(digests(docs, id_col, text_col).withColumn("new", is_new))
    top = F.max(F.struct("doc_id", *ROW)).alias("top")  # null is the smallest
    groups = stored(rows.groupBy("new", "text_sha256", "key", "n_bytes").agg(top, F.count(F.lit(1)).alias("n")))
    old, new = groups.where(~F.col("new")), groups.where("new")
    shards = max(16, -(-max(old.count(), new.count()) // FILTER_KEYS))
    hits = screen(new.select("text_sha256", "key"), build_filters(old, shards), shards).where("hit").select("text_sha256")
    pairs = new.join(hits, "text_sha256").select("text_sha256", "n_bytes", F.col("top").alias("a")).join(old.select("text_sha256", "n_bytes", F.col("top").alias("b")), ["text_sha256", "n_bytes"])
    both = same_bytes(docs, stored(pairs.select("text_sha256", "a", "b")), id_col, text_col).select("text_sha256", F.lit(True).alias("both"))
    # a group on one side only, or two that did not prove equal, stays by itself
    marked = groups.join(both, "text_sha256", "left").withColumn("side", F.when(F.coalesce("both", F.lit(False)), F.lit(2)).otherwise(F.col("new").cast("int")))
    final = marked.groupBy("text_sha256", "side").agg(F.max("top").alias("keep"), F.sum("n").alias("group_size"))
    sides = marked.select("text_sha256", "new", "side").join(final, ["text_sha256", "side"]).drop("side")
    out = rows.join(sides, ["text_sha256", "new"])
    keep_id, chosen = F.col("keep.doc_id"), F.lit(True)
    for c in ROW:
        chosen = chosen & (F.col(c) == F.col(f"keep.{c}"))
    return out.select("doc_id", keep_id.alias("keep_id"), "group_size", F.coalesce(F.col("doc_id") == keep_id, F.col("group_size") == 1).alias("kept"), "text_sha256", *ROW, chosen.alias("chosen"))


def exact_groups(docs: DataFrame, is_new=None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    is_new: a condition on doc_id that tells the incoming batch from the snapshot (default: odd ids).
    The snapshot's digests become static filters, one for each shard of digests; shards are sized by the larger side. The
    batch's digests are grouped by themselves first (copies inside it never reach the filter), then screened; positives join
    the snapshot's exact buckets, where one row of each side, named by its row key, is compared byte by byte. Grouping is a
    partial aggregation, so a text that a third of all rows share is one row a task.
    Of equal texts the largest doc_id stays; a null doc_id is smaller than all others (a group of nulls alone
    keeps null ids, all marked kept = false but for group_size 1). Repeated rows with one doc_id count each and
    are kept alike. Null text: empty. An empty table gives no rows. A table that is not read from files is stored first.
    """
    return exact_rows(placed(docs), is_new, id_col, text_col).drop(*ROW, "chosen")


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, all columns, with one row of each group of equal texts: one with the largest doc_id (nulls are the smallest), whatever ids repeat."""
    docs = placed(docs)
    return without(docs, exact_rows(docs, None, id_col, text_col).where(~F.col("chosen")))
