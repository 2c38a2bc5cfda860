"""SimHash near-dedup: a binary trie of fingerprints joined with itself under a Hamming error budget."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, NO_ID, ROW, arrow_map, batch, by_bytes, id_and_text, numbered, placed, rows_of, stored, utf8, without
from .exact_dedup import mix
from .graph import components, forest

#: Bytes of text in one batch; fingerprints below one trie node before its pairs become tasks of their own; rows of a task (about).
BATCH_BYTES = 2_000_000
NODE_ROWS = 20_000
TASK_ROWS = 60_000
#: Times the rows of an even node from which a node counts as large.
SKEW = 4
#: Pairs of trie nodes that are looked at together, and leaf pairs under which a pair of nodes is compared at once.
FRONTIER = 8_000
LEAF_PAIRS = 64
#: Pairs that are compared at once where fingerprints are equal in all bits.
GRID_PAIRS = 250_000
STRIDE = 4


def shingle_hashes(text: bytes, k: int, seed: int = 42) -> list[int]:
    words = text.lower().split()  # bytes.split() cuts at exactly 0x20 and 0x09-0x0D
    if not words:
        return []
    if len(words) <= k:
        return [xxhash.xxh64_intdigest(b" ".join(words), seed)]
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], seed) for a, b in zip(starts[: len(words) - k + 1].tolist(), (ends[k - 1 :] - 1).tolist(), strict=True)]


def majority(h: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each run of hashes, the bits set in over half of them. Eight bits are counted in one word, 255 rows at a time."""
    out = np.zeros(len(sizes), np.uint64)
    some = np.flatnonzero(sizes)
    if not len(some):
        return out
    n = sizes[some]
    pieces = -(-n // 255)
    first = np.cumsum(n) - n
    nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    cuts = np.repeat(first, pieces) + nth * 255
    whole = np.cumsum(pieces) - pieces
    ones = np.uint64(0x0101010101010101)
    for s in range(8):
        lanes = np.add.reduceat((h >> np.uint64(s)) & ones, cuts)
        count = np.add.reduceat(lanes.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64), whole, axis=0)
        for j in range(8):
            out[some] |= (2 * count[:, j] > n).astype(np.uint64) << np.uint64(8 * j + s)
    return out


def shingle_set(text: bytes, k: int) -> np.ndarray:
    """The distinct shingles of a text, sorted."""
    return np.unique(np.array(shingle_hashes(text, k), np.uint64))


def set_id(shingles: np.ndarray) -> int:
    """One id for all texts with the same shingles."""
    return int(np.uint64(xxhash.xxh64_intdigest(shingles.tobytes())).view(np.int64))


def fingerprints(docs: DataFrame, k: int = 3, words: int = 1, id_col: str = "doc_id", text_col: str = "text", sets: bool = False) -> DataFrame:
    """doc_id and `words` fingerprints of 64 bits (f0, f1, ...) of each text; f0 is over XXH64 itself, others over hashes derived from it.

    sets: each shingle counts once however often the text repeats it; with n (their number), id (set_id) and, docs being placed, the row key.
    """
    place = ("doc_id", *ROW) if sets else ("doc_id",)

    def rows(batches):
        for b in batches:
            yield from zip(utf8(b.column("text")), *(b.column(c).to_pylist() for c in place), strict=True)

    def run(batches):
        for group in by_bytes(rows(batches), lambda r: len(r[0]) + 64, BATCH_BYTES):
            each = [shingle_set(r[0], k) if sets else shingle_hashes(r[0], k) for r in group]
            sizes = np.fromiter(map(len, each), np.int64, len(each))
            h = np.fromiter(chain.from_iterable(each), np.uint64, int(sizes.sum()))
            cols = {f"f{w}": (majority(mix(h + np.uint64(0x9E3779B97F4A7C15 * w & (2**64 - 1))) if w else h, sizes).view(np.int64), pa.int64()) for w in range(words)}
            if sets:
                cols |= {"n": (sizes, pa.int64()), "id": ([set_id(x) for x in each], pa.int64())}
            yield batch(**{c: ([r[i] for r in group], pa.int64()) for i, c in enumerate(place, 1)}, **cols)

    names = [*place, *(f"f{w}" for w in range(words)), *(["n", "id"] if sets else [])]
    source = numbered(docs, id_col, text_col) if sets else id_and_text(docs, id_col, text_col)
    return arrow_map(source, run, ", ".join(f"{x} long" for x in names))


def _grid(na: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each pair of sizes all pairs of positions: which, i, j."""
    n = na * nb
    which = np.repeat(np.arange(len(n)), n)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return which, at // nb[which], at % nb[which]


def trie_pairs(key: np.ndarray, side: np.ndarray, fp: np.ndarray, budget: int, bits: int = 64, group_of: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of all pairs of fingerprints with one key that differ in at most `budget` bits; rows are sorted by key, side, fp, group_of.

    group_of: pairs inside one group are not wanted, and nodes that hold one group only are not opened.

    A key with two sides gives pairs across them only. Pairs of trie nodes are traversed together from the
    roots, four levels a step; a pair that has used up more than the budget is dropped with all below it.
    """
    n = len(fp)
    group = np.cumsum(np.concatenate([[True], (key[1:] != key[:-1]) | (side[1:] != side[:-1])])) if n else np.zeros(0, np.int64)
    edges: dict[int, np.ndarray] = {}

    def starts(depth: int) -> np.ndarray:
        if depth not in edges:
            p = fp >> np.uint64(64 - depth) if depth else np.zeros(n, np.uint64)
            edges[depth] = np.concatenate([np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]) | (p[1:] != p[:-1])])), [n]])
        return edges[depth]

    if not n:
        return
    changes = np.concatenate([[0], np.cumsum(group_of[1:] != group_of[:-1])]) if group_of is not None else None
    root = starts(0)
    keys, sides = key[root[:-1]], side[root[:-1]]
    two = np.flatnonzero((keys[1:] == keys[:-1]) & (sides[1:] != sides[:-1]))
    paired = np.isin(np.arange(len(keys)), np.concatenate([two, two + 1]))
    own = np.flatnonzero(~paired & (sides == 0))
    a, b = np.concatenate([own, two]), np.concatenate([own, two + 1])
    stack = [(0, np.stack([root[a], root[a + 1], root[b], root[b + 1], np.zeros(len(a), np.int64)]))]
    while stack:
        depth, f = stack.pop()
        if f.shape[1] > FRONTIER:
            half = f.shape[1] // 2
            stack += [(depth, f[:, :half]), (depth, f[:, half:])]
            continue
        if changes is not None:
            one = (changes[f[1] - 1] == changes[f[0]]) & (changes[f[3] - 1] == changes[f[2]]) & (group_of[f[0]] == group_of[f[2]])
            f = f[:, ~one]
        if depth >= bits:
            wide = (f[1] - f[0]) * (f[3] - f[2]) > GRID_PAIRS
            if wide.any():  # equal fingerprints: halves against halves, so no grid is larger than GRID_PAIRS
                w, f = f[:, wide], f[:, ~wide]
                am, bm = (w[0] + w[1] + 1) // 2, (w[2] + w[3] + 1) // 2
                for a, b, c, d in ((w[0], am, w[2], bm), (w[0], am, bm, w[3]), (am, w[1], w[2], bm), (am, w[1], bm, w[3])):
                    part = np.stack([a, b, c, d, w[4]])
                    stack.append((depth, part[:, (b > a) & (d > c) & ((w[0] != w[2]) | (a <= c))]))
        few = ((f[1] - f[0]) * (f[3] - f[2]) <= LEAF_PAIRS) | (depth >= bits)
        if few.any():
            g = f[:, few]
            size = np.cumsum((g[1] - g[0]) * (g[3] - g[2]))
            if len(size) > 1 and size[-1] > 4 * GRID_PAIRS:  # many nodes together: half of them at a time
                stack += [(depth, g[:, : len(size) // 2]), (depth, g[:, len(size) // 2 :])]
                g = g[:, :0]
            which, i, j = _grid(g[1] - g[0], g[3] - g[2])
            x, y = g[0][which] + i, g[2][which] + j
            good = (np.bitwise_count(fp[x] ^ fp[y]) <= budget) & ((g[0][which] != g[2][which]) | (x < y))
            if changes is not None:
                good &= group_of[x] != group_of[y]
            if good.any():
                yield x[good], y[good]
        f = f[:, ~few]
        if not f.shape[1]:
            continue
        at = starts(min(depth + STRIDE, 64))
        ca, cb = np.searchsorted(at, f[0]), np.searchsorted(at, f[2])
        which, i, j = _grid(np.searchsorted(at, f[1]) - ca, np.searchsorted(at, f[3]) - cb)
        i, j = ca[which] + i, cb[which] + j
        shift = np.uint64(max(0, 64 - depth - STRIDE))
        used = f[4][which] + np.bitwise_count(((fp[at[i]] >> shift) ^ (fp[at[j]] >> shift)) & np.uint64((1 << STRIDE) - 1))
        good = (used <= budget) & ((f[0][which] != f[2][which]) | (i <= j))
        stack.append((depth + STRIDE, np.stack([at[i], at[i + 1], at[j], at[j + 1], used])[:, good]))


def _nearest(x: np.ndarray, y: np.ndarray, apart: np.ndarray, most: int, ids: np.ndarray, lost: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of links x-y those that are among the `most` with the fewest bits apart of one of their ends. lost holds a spanning forest (of ids) of the others."""
    ends, link = np.concatenate([x, y]), np.tile(np.arange(len(x)), 2)
    order = np.lexsort((link, apart[link], ends))
    first = np.flatnonzero(np.concatenate([[True], ends[order][1:] != ends[order][:-1]])) if len(ends) else np.zeros(0, np.int64)
    rank = np.arange(len(ends)) - np.repeat(first, np.diff(np.append(first, len(ends))))
    kept = np.zeros(len(x), bool)
    kept[link[order[rank < most]]] = True
    if not kept.all():
        a, b = ids[x[~kept]], ids[y[~kept]]
        lost[:] = [forest(*map(np.concatenate, zip(*lost, (a, b), strict=True)))]
    return x[kept], y[kept], apart[kept]


def near_links(points: DataFrame, bits: int = 64, budget: int = 3, fps: tuple[Column, ...] = (), checks: tuple[str, ...] = (), most_bits: int = 0, thinned: bool = True, group: str = "", nearest: int = 0) -> DataFrame:
    """Links (a, b) of ids with a fingerprint (column fp, or any of the columns fps, in its `bits` highest bits)
    in which they differ by at most `budget` bits, thinned to spanning forests inside each task (components are
    those of all links).

    checks: more fingerprint columns; linked rows must differ in at most most_bits bits of them altogether.
    thinned=False: all links (some more than once), for callers that test them and so need each.
    group: a column; links inside a group are left out, and keys that hold one group only are dropped as a whole.
    nearest: (with checks, not thinned) of a row's links in a task only so many, those with the fewest differing bits, and
    those that are among the nearest of their other row. Of all other links a spanning forest is returned, marked `lost`.
    Of two fingerprints within the budget, one of budget + 1 blocks of bits is the same; so the trie is joined
    once for each block, turned to have that block first, and the nodes under equal blocks are the tasks. A
    node with over NODE_ROWS rows is opened by eight more bits, its pairs of children within the budget becoming
    tasks in turn, until none is too large. A node that still is at full depth (rows of one fingerprint that only
    their checks tell apart), or that fewer blocks than ways to open it divide, is dealt into blocks, each pair of them a task:
    no common block, however hot, meets in one task. NODE_ROWS gives way to SKEW times the rows of an even node, so that a
    large table is not copied by opening all of its nodes.
    """
    kept = (*checks, group) if group else checks
    blocks = budget + 1
    width = bits // blocks
    high = F.lit(-1 << (64 - bits))

    def turn(fp: Column, r: int) -> Column:
        """The block number r in front."""
        return fp.bitwiseAND(high) if r == 0 else F.shiftleft(fp, r * width).bitwiseOR(F.shiftrightunsigned(fp, bits - r * width)).bitwiseAND(high)

    turned = [F.struct(F.lit(t * blocks + r).alias("r"), turn(fp, r).alias("fp")) for t, fp in enumerate(fps or (F.col("fp"),)) for r in range(blocks)]
    rows = points.select("id", *kept, F.inline(F.array(*turned)))
    rows = rows.select("id", *kept, "fp", F.lit(0).alias("side"), F.concat_ws(":", "r", F.shiftrightunsigned("fp", 64 - width)).alias("key"), F.lit(budget).alias("rest"))
    ready, depth = [], width
    count = points.count()
    most_rows = max(NODE_ROWS, SKEW * count >> width)

    def hot_keys() -> tuple[DataFrame, DataFrame]:
        """Keys with over most_rows rows and rows of the others and of those with more than one group."""
        low, high_ = (F.min(group), F.max(group)) if group else (F.lit(0), F.lit(1))
        hot = stored(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), low.alias("lo"), high_.alias("hi")).where(F.col("n") > most_rows))
        one = hot.where("lo = hi").select("key")
        return hot.where("lo <> hi").select("key", "n"), rows if one.isEmpty() else rows.join(F.broadcast(one), "key", "left_anti")

    def in_blocks(hot: DataFrame) -> DataFrame:
        """Rows of hot keys, dealt; of m blocks, a row of block i is side 0 of its pairs with those after i, side 1 of those before."""
        big = rows.join(F.broadcast(hot), "key").withColumn("m", F.ceil(F.col("n") * 2 / most_rows).cast("int"))
        crossed = F.col("key").contains("x")
        mine = F.pmod(F.xxhash64(F.lit("block"), "id"), F.col("m")).cast("int")
        dealt = big.withColumn("i", mine).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
        # across two nodes: blocks of side 0 by blocks of side 1, each row keeping its side
        a = F.when(crossed, F.when(F.col("side") == 0, F.col("i")).otherwise(F.col("j"))).otherwise(F.least("i", "j"))
        b = F.when(crossed, F.when(F.col("side") == 0, F.col("j")).otherwise(F.col("i"))).otherwise(F.greatest("i", "j"))
        at = F.when(crossed, F.col("side")).otherwise((F.col("i") > F.col("j")).cast("int"))
        joint = F.when(crossed | (a != b), F.lit("x")).otherwise(F.lit("."))
        return dealt.select("id", *kept, "fp", at.alias("side"), F.concat("key", F.lit("|"), a, joint, b).alias("key"), "rest")

    while depth < bits:
        hot, rows = hot_keys()
        if hot.isEmpty():
            break
        ready.append(rows.join(hot, "key", "left_anti"))
        take = min(8, bits - depth)
        masks = sorted((m for m in range(1 << take) if m.bit_count() <= budget), key=lambda m: (m.bit_count(), m))
        fewer = F.col("n") * 2 <= len(masks) * most_rows  # blocks copy a row less often than opening does
        ready.append(in_blocks(hot.where(fewer)))
        hot = hot.where(~fewer)
        if hot.isEmpty():
            rows = rows.limit(0)
            break
        big = rows.join(hot.select("key"), "key").withColumn("own", F.shiftrightunsigned("fp", 64 - depth - take).bitwiseAND(F.lit((1 << take) - 1)))
        opened = big.withColumn("mask", F.explode(F.filter(F.array(*map(F.lit, masks)), lambda m: F.bit_count(m) <= F.col("rest")))).withColumn("other", F.col("own").bitwiseXOR(F.col("mask")))
        # within one node the smaller child is side 0; across two nodes each row keeps its side
        crossed = F.col("key").contains("x")
        left = F.when(crossed, F.when(F.col("side") == 0, F.col("own")).otherwise(F.col("other"))).otherwise(F.least("own", "other"))
        right = F.when(crossed, F.when(F.col("side") == 0, F.col("other")).otherwise(F.col("own"))).otherwise(F.greatest("own", "other"))
        side = F.when(crossed, F.col("side")).otherwise((F.col("own") > F.col("other")).cast("int"))
        joint = F.when(crossed | (F.col("mask") != 0), F.lit("x")).otherwise(F.lit("."))
        opened = opened.select("id", *kept, "fp", side.alias("side"), F.concat("key", F.lit("/"), left, joint, right).alias("key"), (F.col("rest") - F.bit_count("mask")).cast("int").alias("rest"))
        whole = opened.groupBy("key").agg(F.min("side").alias("lo"), F.max("side").alias("hi")).where((F.col("lo") != F.col("hi")) | ~F.col("key").contains("x"))
        rows = stored(opened.join(whole.select("key"), "key", "left_semi"))
        depth += take
    if depth >= bits:
        hot, rows = hot_keys()
        if not hot.isEmpty():
            ready.append(rows.join(hot, "key", "left_anti"))
            rows = in_blocks(hot)
    for r in ready:
        rows = rows.unionByName(r)

    def run(batches):
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        t = pa.Table.from_batches(parts)
        key, side, fp, ids = (t.column(c).to_numpy() for c in ("k", "side", "fp", "id"))
        fp = fp.view(np.uint64)
        of = t.column(group).to_numpy() if group else np.zeros(len(fp), np.int64)
        order = np.lexsort((of, fp, side, key))
        of = of[order]
        key, side, fp, ids = key[order], side[order], fp[order], ids[order]
        more = [t.column(c).to_numpy().view(np.uint64)[order] for c in checks]
        found: list[tuple[np.ndarray, ...]] = []
        held = 0
        lost: list[tuple[np.ndarray, np.ndarray]] = []
        for x, y in trie_pairs(key, side, fp, budget, bits, of if group else None):
            if more:
                apart = sum(np.bitwise_count(m[x] ^ m[y]).astype(np.int64) for m in more)
                good = apart <= most_bits
                x, y, apart = x[good], y[good], apart[good]
            if nearest:
                found.append((x, y, apart))
                held += len(x)
                if held > 500_000:
                    found = [_nearest(*map(np.concatenate, zip(*found, strict=True)), nearest, ids, lost)]
                    held = len(found[0][0])
                continue
            found.append((ids[x], ids[y]))
            held += len(x)
            if held > 500_000 and not thinned:
                a, b = map(np.concatenate, zip(*found, strict=True))
                yield batch(a=(a, pa.int64()), b=(b, pa.int64()))
                found, held = [], 0
            elif held > 500_000:
                found = [forest(*map(np.concatenate, zip(*found, strict=True)))]
                held = len(found[0][0])
        if nearest:
            if found:
                x, y, _ = _nearest(*map(np.concatenate, zip(*found, strict=True)), nearest, ids, lost)
                yield batch(a=(ids[x], pa.int64()), b=(ids[y], pa.int64()), lost=(np.zeros(len(x), bool), pa.bool_()))
            for a, b in lost:
                yield batch(a=(a, pa.int64()), b=(b, pa.int64()), lost=(np.ones(len(a), bool), pa.bool_()))
        elif found:
            a, b = map(np.concatenate, zip(*found, strict=True))
            a, b = forest(a, b) if thinned else (a, b)
            yield batch(a=(a, pa.int64()), b=(b, pa.int64()))

    rows = rows.select("id", *kept, "fp", F.col("side").cast("int").alias("side"), F.xxhash64("key").alias("k"))
    tasks = max(16, -(-count * len(turned) // TASK_ROWS))
    return arrow_map(rows.repartition(tasks, "k"), run, "a long, b long, lost boolean" if nearest else "a long, b long")


def simhash_groups(docs: DataFrame, k: int = 3, budget: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id.

    Equal fingerprints are one class (grouped by a partial aggregation, so copies never meet as pairs); classes
    within the budget are linked; component_id is the smallest doc_id reachable. No words: fingerprint 0,
    linked like any other; null text: empty; null doc_id: after all others (a component of nulls alone has a
    null component_id); repeated rows give repeated results; an empty table gives none.
    """
    rows = stored(fingerprints(docs, k, 1, id_col, text_col))
    classes = stored(rows.groupBy("f0").agg(F.min(F.coalesce("doc_id", F.lit(NO_ID))).alias("low")))
    roots = components(near_links(classes.select(F.col("f0").alias("id"), F.col("f0").alias("fp")), 64, budget), thinned=True)
    named = classes.join(roots, classes["f0"] == roots["id"], "left").select("f0", "low", F.coalesce("root", "f0").alias("root"))
    named = stored(named)
    lowest = named.groupBy("root").agg(F.min("low").alias("component_id"))
    by_class = named.join(lowest, "root").select("f0", "component_id")
    return rows.join(by_class, "f0").select("doc_id", F.lpad(F.lower(F.hex("f0")), 16, "0").alias("fingerprint"), F.nullif("component_id", F.lit(NO_ID)).alias("component_id"))


#: For similar texts: shingle words, and the chance that one bit differs between sets at a Jaccard similarity of 0.8
#: (cosine 0.889, angle 27.3 degrees of 180). Pairs are dropped unseen only where the bits differ in over DEVIATIONS standard deviations more.
SIMILAR_SHINGLE = 5
BIT_DIFFERS = 0.1515
DEVIATIONS = 3.4
#: Pairs that a text proposes in a task before its other ones are left to the comparison of whole families.
NEAREST = 2
#: Bytes of sets in a block of a family, rows of two blocks that are compared at once, and shingles at once.
COMPARE_BYTES = 16_000_000
COMPARE_ROWS = 512
COMPARE_COLUMNS = 8192
#: Most classes for a plan (bits of a table, errors, tables); each plan has a pair at 0.8 in one of its tables with a chance of 0.95.
#: Chance pairs of a class grow with the classes (the first plan: 6.4 at a million). They are dropped inside the tasks, so they cost time and
#: no disk, while a row for each block of each table is written: 40 for a class in the first plan, 105 in the second, 270 in the third.
PLANS = ((50_000_000, 32, 3, 10), (2_500_000_000, 48, 4, 21), (2**63, 64, 5, 45))
#: Fingerprint words of 64 bits that every such row carries, to drop pairs that are far apart: as many as the first plan has.
CHECK_WORDS = 5


def plan_similar(n: int) -> tuple[int, int, int, int]:
    """Bits of a table, errors, tables, and the words of 64 bits that hold them, for n texts."""
    bits, errors, tables = next(p[1:] for p in PLANS if n <= p[0])
    return bits, errors, tables, -(-tables // (64 // bits))


def shingle_sets(docs: DataFrame, rows: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id (set_id) and s (the set of shingles) of the texts of these rows (row keys). Only these texts are read."""
    rows = stored(rows.select(*ROW).distinct())

    def run(batches):
        for group in by_bytes(rows_of(batches), lambda r: len(r[1]) + 64, BATCH_BYTES):
            each = [shingle_set(t, SIMILAR_SHINGLE) for _, t in group]
            yield batch(id=([set_id(x) for x in each], pa.int64()), s=([x.view(np.int64) for x in each], pa.list_(pa.int64())))

    texts = numbered(docs, id_col, text_col)
    texts = texts.join(F.broadcast(rows) if rows.count() <= BROADCAST_IDS else rows, list(ROW), "left_semi").select("doc_id", "text")
    return stored(arrow_map(texts, run, "id long, s array<long>").groupBy("id").agg(F.first("s").alias("s")))


def similar(docs: DataFrame, classes: DataFrame, pairs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of pairs (a, b) of classes (id, low: a struct with the key of a row of the class) those whose sets of shingles have a Jaccard similarity of 0.8 or more.

    Only texts of paired classes are read again. Equal ids may stand for several texts, so a set is taken by its set_id.
    """
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    sets = shingle_sets(docs, classes.join(ids, "id").select("low.*"), id_col, text_col)
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
    # common / (sum of sizes - common) >= 4/5
    return both.where(9 * F.size(F.array_intersect("sa", "sb")) >= 4 * (F.size("sa") + F.size("sb"))).select("a", "b")


def _common(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many numbers each set of a has in common with each of b."""
    size_a, size_b = np.fromiter(map(len, a), np.int64, len(a)), np.fromiter(map(len, b), np.int64, len(b))
    every = np.concatenate([*a, *b])
    _, at, times = np.unique(every, return_inverse=True, return_counts=True)
    shared = np.flatnonzero(times[at] > 1)
    column = np.cumsum(times > 1) - 1
    row = np.repeat(np.arange(len(a) + len(b)), np.concatenate([size_a, size_b]))[shared]
    column = column[at[shared]]
    out = np.zeros((len(a), len(b)), np.float32)
    for low in range(0, int(column.max()) + 1 if len(column) else 0, COMPARE_COLUMNS):
        here = (column >= low) & (column < low + COMPARE_COLUMNS)
        m = np.zeros((len(a) + len(b), COMPARE_COLUMNS), np.float32)
        m[row[here], column[here] - low] = 1
        out += m[: len(a)] @ m[len(a) :].T
    return out


def compared(members: DataFrame) -> DataFrame:
    """Links (a, b), thinned in each task, that join all members (family, group, id, s) of one family with a Jaccard similarity of 0.8
    or more that are not in one group.

    A family is dealt into blocks of about COMPARE_BYTES; each pair of blocks is a task of its own, which compares its members
    in squares of COMPARE_ROWS and returns no more links than it has members.
    """
    parts = members.groupBy("family").agg(F.ceil(F.sum(F.size("s") * 8 + 64) / COMPARE_BYTES).cast("int").alias("m"), F.min("group").alias("lo"), F.max("group").alias("hi")).where("lo <> hi")
    dealt = members.join(parts.select("family", "m"), "family").withColumn("i", F.pmod(F.xxhash64(F.lit("part"), "id"), F.col("m")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    dealt = stored(dealt.select("id", "group", "s", F.xxhash64("family", F.least("i", "j"), F.greatest("i", "j")).alias("k"), F.when(F.col("i") == F.col("j"), 2).otherwise((F.col("i") > F.col("j")).cast("int")).alias("side")))
    n, held = dealt.agg(F.countDistinct("k"), F.coalesce(F.sum(F.size("s") * 8 + 64), F.lit(0))).first()

    def run(batches):
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        t = pa.Table.from_batches(parts).combine_chunks()
        k, side, ids, group = (t.column(c).to_numpy() for c in ("k", "side", "id", "group"))
        lists = t.column("s").chunk(0)
        edge, values = lists.offsets.to_numpy(), lists.values.to_numpy()
        order = np.lexsort((group, side, k))
        change = np.flatnonzero(np.concatenate([[True], k[order][1:] != k[order][:-1], [True]]))
        for lo, hi in zip(change[:-1].tolist(), change[1:].tolist(), strict=True):
            at = order[lo:hi]
            split = int(np.searchsorted(side[at], 1)) if side[at[-1]] == 1 else 0  # two blocks: pairs across them only
            first, second = (at[:split], at[split:]) if split else (at, at)
            found: list[tuple[np.ndarray, np.ndarray]] = []
            for i in range(0, len(first), COMPARE_ROWS):
                for j in range(0 if split else i, len(second), COMPARE_ROWS):
                    a, b = first[i : i + COMPARE_ROWS], second[j : j + COMPARE_ROWS]
                    if group[a[0]] == group[b[-1]] and group[a[-1]] == group[b[0]]:  # one group on both sides
                        continue
                    sa, sb = ([values[edge[x] : edge[x + 1]] for x in y] for y in (a, b))
                    sizes = np.add.outer(*(np.fromiter(map(len, x), np.int64, len(x)) for x in (sa, sb)))
                    p, q = np.nonzero((9 * _common(sa, sb) >= 4 * sizes) & (group[a][:, None] != group[b][None, :]))
                    found.append((ids[a[p]], ids[b[q]]))
                    if len(found) > 64:
                        found = [forest(*map(np.concatenate, zip(*found, strict=True)))]
            if found:
                a, b = forest(*map(np.concatenate, zip(*found, strict=True)))
                yield batch(a=(a, pa.int64()), b=(b, pa.int64()))

    return arrow_map(dealt.repartition(max(16, min(n, -(-held // COMPARE_BYTES))), "k"), run, "a long, b long")


def similar_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """similar_groups() of placed docs with each row's key, and `chosen`: whether it is the one row of its group that a deduplicated table holds."""
    bits, errors, tables, words = plan_similar(docs.count())
    names = [f"f{w}" for w in range(words)]
    checks = names[:CHECK_WORDS]
    tested = 64 * len(checks)
    most = round(tested * BIT_DIFFERS + DEVIATIONS * (tested * BIT_DIFFERS * (1 - BIT_DIFFERS)) ** 0.5)
    rows = stored(fingerprints(docs, SIMILAR_SHINGLE, words, id_col, text_col, sets=True))
    low = F.min(F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), *ROW)).alias("low")
    classes = stored(rows.groupBy("id", "n", *names).agg(low))
    fps = tuple(F.shiftleft(F.col(n), i * bits) for n in names for i in range(64 // bits))[:tables]
    # stars: each class with the smallest one that shares a fingerprint, so that large groups of near copies are one before pairs are sought
    pieces = classes.select("id", *checks, F.posexplode(F.array(*(F.shiftrightunsigned(fp, 64 - bits) for fp in fps))).alias("p", "v"))
    hubs = pieces.groupBy("p", "v").agg(F.min(F.struct(F.col("id").alias("a"), *(F.col(n).alias(f"h{n}") for n in checks))).alias("hub"), F.count(F.lit(1)).alias("m")).where("m > 1").select("p", "v", "hub.*")
    far = sum((F.bit_count(F.col(n).bitwiseXOR(F.col(f"h{n}"))) for n in checks), F.lit(0))
    stars = pieces.join(hubs, ["p", "v"]).where((F.col("id") != F.col("a")) & (far <= most)).select("a", F.col("id").alias("b"))
    stars = stored(stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    starred = stored(similar(docs, classes, stars, id_col, text_col))
    grouped = stored(classes.join(components(starred), "id", "left").withColumn("star", F.coalesce("root", "id")).drop("root", "low"))
    made = stored(near_links(grouped, bits, errors, fps, tuple(checks), most, thinned=False, group="star", nearest=NEAREST))
    pairs = made.where("not lost").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(stars, ["a", "b"], "left_anti")
    lost = made.where("lost").select("a", "b")
    links = starred
    if not lost.isEmpty():
        family = stored(components(lost).withColumnRenamed("root", "family"))
        for end in "ab":
            pairs = pairs.join(family.select(F.col("id").alias(end), F.col("family").alias(f"family_{end}")), end, "left")
        pairs = pairs.where("family_a is null or family_b is null or family_a <> family_b").select("a", "b")
        sets = shingle_sets(docs, classes.join(family, "id").select("low.*"), id_col, text_col)
        links = links.union(stored(compared(grouped.join(family, "id").join(sets, "id").select("id", "family", F.col("star").alias("group"), "s"))))
    links = links.union(stored(similar(docs, classes, stored(pairs), id_col, text_col)))
    roots = components(links)
    named = stored(classes.join(roots, "id", "left").select("id", "low", F.coalesce("root", "id").alias("root")))
    lowest = named.groupBy("root").agg(F.min("low").alias("keep"))
    by_class = named.join(lowest, "root").select("id", "keep")
    chosen = F.lit(True)
    for c in ROW:
        chosen = chosen & (F.col(c) == F.col(f"keep.{c}"))
    return rows.select("doc_id", *ROW, "id").join(by_class, "id").select("doc_id", F.nullif("keep.doc_id", F.lit(NO_ID)).alias("component_id"), *ROW, chosen.alias("chosen"))


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, component_id, for texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

    A single fingerprint with three errors finds only texts that are almost equal. So each set gets several fingerprints:
    up to 50 million texts ten of 32 bits, beyond that more and longer ones (PLANS), so that pairs proposed by chance stay
    few enough to look at. A trie self-join of each proposes pairs (a pair at 0.8 is in one of them with over 0.95;
    pairs already joined through others are left out), CHECK_WORDS words of bits drop those that are far apart, and the sets themselves decide.
    Each text proposes its NEAREST ones alone; texts that have more to propose (large groups of near copies) are, by those links,
    families, whose sets are compared block by block, all with all but those already joined: no row is made for a pair that fails.
    Equal sets are one class. Texts without words are similar to each other only. Nulls and ties as in simhash_groups;
    an empty table gives no rows. A table that is not read from files is stored first.
    """
    return similar_rows(placed(docs), id_col, text_col).drop(*ROW, "chosen")


def without_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, all columns, with one row of each group of similar texts: one with the smallest doc_id (nulls are the largest), whatever ids repeat."""
    docs = placed(docs)
    return without(docs, similar_rows(docs, id_col, text_col).where(~F.col("chosen")))
