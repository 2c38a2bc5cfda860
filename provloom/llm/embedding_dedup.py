"""Embedding near-dedup: sign hashes of random hyperplanes in several tables, exact cosines, connected components."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import NO_ID, arrow_map, batch, stored
from .graph import components, forest
from .simhash import _grid

#: Rows of a bucket that are compared by one task, rows of a task (about), pairs that are looked at together, numbers in the
#: vectors of pairs that are multiplied together, and the chance that a pair at the threshold meets in no table.
BLOCK_ROWS = 4000
TASK_ROWS = 60_000
PAIRS = 500_000
NUMBERS = 4_000_000
MISS = 0.001
#: A pair of one bucket is dropped unmultiplied if its signs differ in over so many standard deviations more bits, over all tables, than those of a pair at the threshold.
DEVIATIONS = 5.0


def plan_tables(n: int, threshold: float, miss: float = MISS) -> tuple[int, int, int]:
    """Bits a table, number of tables, and the most bits in which the signs of all tables may differ, for n vectors: about 128 vectors a bucket if they were spread evenly."""
    bits = max(6, min(24, round(math.log2(max(n, 2))) - 7))
    differs = math.acos(threshold) / math.pi
    tables = math.ceil(math.log(miss) / math.log1p(-((1 - differs) ** bits)))
    every = bits * tables
    return bits, tables, math.ceil(every * differs + DEVIATIONS * math.sqrt(every * differs * (1 - differs)))


def _valid(df: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, str]:
    """vec_id, key (digest of the vector's values; null if it links with nothing), vec (its bytes)."""
    kind = "<f4" if isinstance(df.schema[vec_col].dataType.elementType, T.FloatType) else "<f8"

    def run(batches):
        for b in batches:
            keys, vecs = [], []
            for v in b.column("v").to_pylist():
                x = None if not v or any(c is None for c in v) else np.array(v, kind) + np.array(0, kind)
                good = x is not None and bool(np.isfinite(x).all()) and bool(x.any())
                raw = x.tobytes() if good else None
                keys.append(hashlib.sha256(raw).hexdigest()[:32] if good else None)
                vecs.append(raw)
            yield batch(vec_id=(b.column("vec_id"), pa.int64()), key=(keys, pa.string()), vec=(vecs, pa.binary()))

    some = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("v"))
    return arrow_map(some, run, "vec_id long, key string, vec binary"), kind


def _squares(lo: np.ndarray, mid: np.ndarray, hi: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of all pairs of each run lo..hi: of its two sides lo..mid and mid..hi, or where mid is lo all pairs of the run; about PAIRS at a time."""
    two = mid > lo
    a, b, c, d = lo, np.where(two, mid, hi), np.where(two, mid, lo), hi
    height = np.maximum(1, PAIRS // np.maximum(1, d - c))  # rows of a large square that are taken at once
    cuts = -(-(b - a) // height)
    which = np.repeat(np.arange(len(lo)), cuts)
    nth = np.arange(len(which)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
    start = a[which] + nth * height[which]
    rows, columns = np.minimum(height[which], b[which] - start), (d - c)[which]
    group = np.cumsum(rows * columns) // PAIRS
    for at in np.split(np.arange(len(which)), np.flatnonzero(np.diff(group)) + 1):
        if not len(at):
            continue
        w, i, j = _grid(rows[at], columns[at])
        w = at[w]
        p, q = start[w] + i, c[which[w]] + j
        fine = two[which[w]] | (p < q)
        yield p[fine], q[fine]


def _met_before(sig: np.ndarray, p: np.ndarray, q: np.ndarray, table: np.ndarray, bits: int) -> np.ndarray:
    """Whether the signs of pairs (rows of packed bits) agree in all bits of a table before theirs."""
    out = np.zeros(len(p), bool)
    if not len(p):
        return out
    differ = np.unpackbits(sig[p] ^ sig[q], axis=1, bitorder="little")
    for t in range(int(table.max())):
        out |= (t < table) & ~differ[:, t * bits : (t + 1) * bits].any(axis=1)
    return out


def embedding_groups(vectors: DataFrame, threshold: float = 0.95, seed: int = 29, miss: float = MISS, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row per row of vectors: vec_id, n_links, component_id, kept.

    Equal vectors are one class, with its size. Each class is hashed by the signs of random projections in
    several tables (as many as make a pair at the threshold meet with chance 1 - miss). First only ids and signs go to the
    buckets: a row that meets another there for the first time, with signs that differ in no more bits over all tables than a
    pair at the threshold can, is a candidate of that bucket. Only candidates send their vectors to the bucket, where the
    same pairs are compared exactly in double precision. Buckets over BLOCK_ROWS are cut into blocks, and pairs of blocks
    are tasks of their own: nothing is capped. Tasks return candidates, sums of links and spanning forests, never all
    pairs. Vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors of
    different lengths do not link; a null vec_id comes after all others; repeated rows count each; an empty table gives no rows.
    """
    rows, kind = _valid(vectors, id_col, vec_col)
    rows = stored(rows)
    classes = stored(rows.where("key is not null").groupBy("key").agg(F.min(F.coalesce("vec_id", F.lit(NO_ID))).alias("id"), F.count(F.lit(1)).alias("n"), F.any_value("vec").alias("vec")))
    total = classes.count()
    bits, tables, most = plan_tables(total, threshold, miss)

    def hashes(batches):
        planes: dict[int, np.ndarray] = {}
        for b in batches:
            ids, vecs = b.column("id").to_numpy(), b.column("vec").to_pylist()
            for dim in sorted({len(v) for v in vecs}):
                at = np.array([i for i, v in enumerate(vecs) if len(v) == dim])
                x = np.frombuffer(b"".join(vecs[i] for i in at), kind).reshape(len(at), -1).astype(np.float64)
                if dim not in planes:
                    planes = {dim: np.random.default_rng([seed, x.shape[1]]).standard_normal((x.shape[1], bits * tables))}
                signs = (x / np.abs(x).max(axis=1, keepdims=True)) @ planes[dim] > 0
                packed = [r.tobytes() for r in np.packbits(signs, axis=1, bitorder="little")]
                bucket = signs.reshape(len(at), tables, bits) @ (1 << np.arange(bits, dtype=np.int64))
                for t in range(tables):
                    yield batch(key=(np.int64(dim) << 40 | np.int64(t) << 32 | bucket[:, t], pa.int64()), id=(ids[at], pa.int64()), sig=(packed, pa.binary()))

    def dealt(hashed: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
        """Rows in tasks: those of one bucket together (part 0), or of each two blocks of a large bucket, in their order."""
        hot = stored(hashed.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > BLOCK_ROWS).withColumn("cuts", F.ceil(F.col("m") / BLOCK_ROWS).cast("int")).select("key", "cuts"))
        tasks = hashed.withColumns({"part": F.lit(0), "side": F.lit(0)})
        if not hot.isEmpty():
            cut = hashed.join(hot, "key").withColumn("own", F.pmod(F.xxhash64("id"), F.col("cuts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
            part = F.least("own", "other") * F.col("cuts") + F.greatest("own", "other") + 1
            tasks = tasks.join(hot, "key", "left_anti").unionByName(cut.withColumns({"part": part.cast("int"), "side": F.when(F.col("own") == F.col("other"), 2).otherwise((F.col("own") > F.col("other")).cast("int"))}).drop("own", "other", "cuts"))
        return tasks.select("key", "part", "side", "id", "sig", *extra)

    def pairs(t: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positions of pairs that are near by their signs and meet in no table before."""
        key, part, side = (t.column(c).to_numpy() for c in ("key", "part", "side"))
        order = np.lexsort((side, part, key))
        k, n = key[order], part[order]
        lo = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (n[1:] != n[:-1])]))
        hi = np.append(lo[1:], len(k))
        ones = np.concatenate([[0], np.cumsum(side[order] == 1)])
        ones = ones[hi] - ones[lo]
        mid = np.where(ones > 0, hi - ones, lo)
        keep = (hi - lo > 1) & ((ones == 0) | (mid > lo))
        sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint8).reshape(len(k), -1)
        words = np.zeros((len(k), -(-sig.shape[1] // 8) * 8), np.uint8)
        words[:, : sig.shape[1]] = sig
        words, table = words.view(np.uint64), key >> 32 & 255
        for p, q in _squares(lo[keep], mid[keep], hi[keep]):
            p, q = order[p], order[q]
            near = np.bitwise_count(words[p] ^ words[q]).sum(axis=1) <= most
            p, q = p[near], q[near]
            for i in range(0, len(p), PAIRS // 8):
                a, b = p[i : i + PAIRS // 8], q[i : i + PAIRS // 8]
                new = ~_met_before(sig, a, b, table[a], bits)
                yield a[new], b[new]

    def gathered(batches) -> pa.Table | None:
        parts = [b for b in batches if b.num_rows]
        return pa.Table.from_batches(parts) if parts else None

    def propose(batches):
        t = gathered(batches)
        if t is None:
            return
        some = np.zeros(t.num_rows, bool)
        for p, q in pairs(t):
            some[p] = some[q] = True
        yield from t.filter(pa.array(some)).select(["key", "id", "sig"]).combine_chunks().to_batches(max_chunksize=10_000)

    def compare(batches):
        t = gathered(batches)
        if t is None:
            return
        ids, n, vecs = t.column("id").to_numpy(), t.column("n").to_numpy(), t.column("vec").to_pylist()
        degree = np.zeros(len(ids), np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for p, q in pairs(t):
            if not len(p):
                continue
            step = max(1, NUMBERS // len(vecs[p[0]]))
            for i in range(0, len(p), step):
                a, b = p[i : i + step], q[i : i + step]
                for size in {len(vecs[x]) for x in np.unique(a)}:  # a bucket holds vectors of one length
                    mine = np.array([len(vecs[x]) == size for x in a])
                    u, v = a[mine], b[mine]
                    who, at = np.unique(np.concatenate([u, v]), return_inverse=True)
                    x = np.frombuffer(b"".join(vecs[w] for w in who), kind).reshape(len(who), -1).astype(np.float64)
                    x /= np.abs(x).max(axis=1, keepdims=True)
                    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
                    good = np.einsum("ij,ij->i", x[at[: len(u)]], x[at[len(u) :]]) >= threshold
                    u, v = u[good], v[good]
                    np.add.at(degree, u, n[v])
                    np.add.at(degree, v, n[u])
                    found.append((ids[u], ids[v]))
            if len(found) > 200:
                found = [forest(*map(np.concatenate, zip(*found, strict=True)))]
        who, at = np.unique(ids, return_inverse=True)
        sums = np.bincount(at, weights=degree).astype(np.int64)
        some = sums > 0
        if some.any():
            yield batch(a=(who[some], pa.int64()), b=([None] * int(some.sum()), pa.int64()), n=(sums[some], pa.int64()))
            a, b = forest(*map(np.concatenate, zip(*found, strict=True)))
            yield batch(a=(a, pa.int64()), b=(b, pa.int64()), n=([0] * len(a), pa.int64()))

    def tasks_for(n: int) -> int:
        return max(16, -(-n // TASK_ROWS))

    hashed = arrow_map(classes.select("id", "vec"), hashes, "key long, id long, sig binary")
    candidates = stored(arrow_map(dealt(hashed).repartition(tasks_for(total * tables), "key", "part"), propose, "key long, id long, sig binary").distinct())
    with_vectors = candidates.join(classes.select("id", "n", "vec"), "id")
    made = stored(arrow_map(dealt(with_vectors, ("n", "vec")).repartition(tasks_for(candidates.count() * 4), "key", "part"), compare, "a long, b long, n long"))
    degree = made.where("b is null").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("more"))
    roots = components(made.where("b is not null").select("a", "b"))
    known = stored(classes.select("key", "id", "n").join(degree, "id", "left").join(roots, "id", "left").select("key", (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), F.coalesce("root", "id").alias("component_id")))
    out = rows.select("vec_id", "key").where("key is not null").join(known, "key").drop("key")
    alone = rows.where("key is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = out.withColumn("component_id", F.nullif("component_id", F.lit(NO_ID))).unionByName(alone)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
