"""Context-tree weighting over bytes: code lengths of texts under KT estimates mixed across context depths."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .common import arrow_map, id_and_text, stored, utf8
from .exact_dedup import mix
from .substring_dedup import word_hashes

#: Bytes of context, the nearest of them that a range has in common, and the parts of a bit that code lengths are rounded up to.
DEPTH = 5
TOP = 2
PARTS = 1024
CHUNK = 1 << 16
#: Parts of a natural logarithm in which weighted probabilities are summed over ranges.
LOG_UNIT = 1 << 16
_TABLE = 1 << 16
_half = np.concatenate([[0.0], np.cumsum(np.log(np.arange(_TABLE) + 0.5))])
_fact = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, _TABLE + 1)))])


def _log_rising(n: np.ndarray, table: np.ndarray, shift: float) -> np.ndarray:
    """log of shift (shift + 1) ... (shift + n - 1), by table or Stirling's series."""
    x = np.maximum(n, _TABLE).astype(np.float64) + shift
    big = (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - math.lgamma(shift)
    return np.where(n <= _TABLE, table[np.minimum(n, _TABLE)], big)


def kt_log(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov probability of a sequence with so many zeros and ones."""
    return _log_rising(zeros, _half, 0.5) + _log_rising(ones, _half, 0.5) - _log_rising(zeros + ones, _fact, 1.0)


def is_held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 == 2


def stream(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Texts as bytes (words joined by one space, then a line feed as end), and each text's number of bytes."""
    flat = [b" ".join(t.split()) + b"\n" for t in texts]
    return np.frombuffer(b"".join(flat), np.uint8), np.fromiter(map(len, flat), np.int64, len(flat))


def gram_keys(raw: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each byte its context, the nearest byte highest, and the byte itself lowest. Before a text: line feeds."""
    key = raw.astype(np.uint64)
    since = np.arange(len(raw)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    for j in range(1, DEPTH + 1):
        before = np.full(len(raw), 10, np.uint64)
        before[j:] = raw[:-j] if j < len(raw) else 0
        before[since < j] = 10
        key |= before << np.uint64(8 * (DEPTH + 1 - j))
    return key


class _Level:
    """Counts of one depth: distinct (context, byte), and totals of the binary nodes that a byte is decomposed into."""

    def __init__(self, key: np.ndarray, n: np.ndarray, depth: int) -> None:
        cut = ((key >> np.uint64(8 * (DEPTH - depth + 1))) << np.uint64(8)) | (key & np.uint64(255))
        self.u, self.of = np.unique(cut, return_inverse=True)
        count = np.bincount(self.of, weights=n, minlength=len(self.u)).astype(np.int64)
        self.node, self.first, self.total = [], [], []
        for b in range(9):
            v = self.u >> np.uint64(8 - b)
            new = np.concatenate([[True], v[1:] != v[:-1]])
            self.first.append(np.flatnonzero(new))
            self.node.append(np.cumsum(new) - 1)
            self.total.append(np.add.reduceat(count, self.first[-1]))

    def ones(self, b: int) -> np.ndarray:
        """For each node of level b how often a one follows."""
        child = self.total[b + 1]
        bit = (self.u[self.first[b + 1]] >> np.uint64(7 - b)) & np.uint64(1)
        return np.bincount(self.node[b][self.first[b + 1]], weights=np.where(bit == 1, child, 0), minlength=len(self.total[b])).astype(np.int64)

    def kt(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        """For each (context, byte): KT estimate of the byte's bit b, and how often the node was seen."""
        t = self.total[b][self.node[b]]
        return (self.total[b + 1][self.node[b + 1]] + 0.5) / (t + 1), t


def _weights(levels: list[_Level], b: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """For nodes of bit b: log of the weighted probability of the training bits at depth TOP, and at each depth the
    posterior weight of stopping there, from the deepest contexts up."""
    below, stop = None, [np.zeros(0)] * len(levels)
    for i in range(len(levels) - 1, -1, -1):
        lv = levels[i]
        ones = lv.ones(b)
        own = kt_log(lv.total[b] - ones, ones)
        if below is None:
            below, stop[i] = own, np.ones(len(own))
            continue
        deep = levels[i + 1]
        parent = np.searchsorted(lv.u, ((deep.u >> np.uint64(16)) << np.uint64(8)) | (deep.u & np.uint64(255)))
        below, stop[i] = _weighted(own, np.bincount(lv.node[b][parent[deep.first[b]]], weights=below, minlength=len(own)))
    return below, stop


def _weighted(own: np.ndarray, split: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Half the estimate of a node itself and half that of its children together, as a logarithm; the share of the first half."""
    weighted = np.logaddexp(own, split) - math.log(2)
    return weighted, np.exp(own - math.log(2) - weighted)


def top_sums(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the weighted log probabilities of depth TOP over all contexts with one nearest byte: places (nearest byte * 255 + node) and sums
    in units of 1 / LOG_UNIT, as integers, which add up to the same number in any order."""
    levels = [_Level(key, n, d) for d in range(TOP, DEPTH + 1)]
    out = np.zeros(256 * 255)
    for b in range(8):
        below, _ = _weights(levels, b)
        u = levels[0].u[levels[0].first[b]].astype(np.int64)
        np.add.at(out, (u >> 16) * 255 + (1 << b) - 1 + ((u & 255) >> (8 - b)), below)
    at = np.flatnonzero(out)
    return at, np.round(out[at] * LOG_UNIT).astype(np.int64)


def _nodes(counts: np.ndarray, b: int) -> tuple[np.ndarray, np.ndarray]:
    """Zeros and ones at each node of bit b; counts[..., byte]."""
    halves = counts.reshape(*counts.shape[:-1], 1 << b, 2, 1 << (7 - b)).sum(axis=-1)
    return halves[..., 0], halves[..., 1]


class Shallow:
    """Estimates and weights of depths zero and one, from counts[nearest byte, byte] and the sums that all ranges' top_sums() make."""

    def __init__(self, counts: np.ndarray, sums: np.ndarray) -> None:
        self.kt, self.seen, self.stop = [], [], []
        sums = sums.reshape(256, 255)
        for b in range(8):
            zeros, ones = _nodes(counts, b)
            deep, stop = _weighted(kt_log(zeros, ones), sums[:, (1 << b) - 1 : (2 << b) - 1])
            all_zeros, all_ones = zeros.sum(axis=0, keepdims=True), ones.sum(axis=0, keepdims=True)
            _, root = _weighted(kt_log(all_zeros, all_ones), deep.sum(axis=0, keepdims=True))
            self.stop.append((root, stop))
            self.kt.append(((all_ones + 0.5) / (all_zeros + all_ones + 1), (ones + 0.5) / (zeros + ones + 1)))
            self.seen.append((all_zeros + all_ones > 0, zeros + ones > 0))

    def bits(self, b: int, depth: int, c1: np.ndarray, sym: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each (nearest byte, byte): KT estimate of the byte's bit b, whether the node was seen, and the weight of stopping there."""
        row, prefix = (c1 if depth else np.zeros_like(c1)), sym >> (8 - b)
        one = self.kt[b][depth][row, prefix]
        return np.where((sym >> (7 - b)) & 1 == 1, one, 1 - one), self.seen[b][depth][row, prefix], self.stop[b][depth][row, prefix]


def code_lengths(key: np.ndarray, n: np.ndarray, shallow: Shallow) -> np.ndarray:
    """Bits of each distinct sorted key, whose training counts are n; all keys that share the nearest TOP bytes are here.

    At each binary node the weights of all depths, zero to DEPTH, follow from the probabilities that the tree's two
    choices (stop here, or split by one more byte) give to the training bytes, from the deepest contexts up. A
    context that training never saw has no say.
    """
    levels = [_Level(key, n, d) for d in range(TOP, DEPTH + 1)]
    out = np.zeros(len(key))
    c1, sym = (key >> np.uint64(8 * DEPTH)).astype(np.int64), (key & np.uint64(255)).astype(np.int64)
    for b in range(8):
        _, stop = _weights(levels, b)
        mixed, known = np.full(len(key), 0.5), np.zeros(len(key), bool)
        for depth in range(DEPTH, -1, -1):
            if depth >= TOP:
                lv = levels[depth - TOP]
                kt, seen = lv.kt(b)
                kt, here, w = kt[lv.of], seen[lv.of] > 0, stop[depth - TOP][lv.node[b]][lv.of]
            else:
                kt, here, w = shallow.bits(b, depth, c1, sym)
            w = np.where(known, w, 1.0)
            mixed, known = np.where(here, w * kt + (1 - w) * mixed, mixed), here | known
        out -= np.log2(mixed)
    return out


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    Texts are A-Z lower-cased words joined by one space with one end. Blocks of texts send the distinct
    (context, byte) keys of all their bytes, with counts from training texts, to ranges that hold all contexts
    with the same nearest two bytes; a range adds up the counts of all blocks, weights its trees and answers
    with code lengths, so no task and not the driver ever holds the model, which grows with the corpus. Ranges first
    send up the weighted probabilities of their trees, summed by nearest byte: with the counts of byte pairs
    these 65,280 numbers give the weights of depths zero and one, so estimates of all depths are mixed. Word counts
    for base_score go the same way by the word's hash. Code lengths are rounded up, so probabilities never sum
    to over one. Null text: empty (its end alone); null doc_id: its text form is empty, in training; repeated
    rows count each; with no training text all estimates are even; an empty table gives no rows.
    """
    stored_blocks = B.block_table(id_and_text(docs, id_col, text_col))
    total = stored_blocks.agg(F.sum("n_bytes")).first()[0] or 0
    ranges = B.ranges_for(total // 8)
    word_ranges = B.ranges_for(total // 30)
    shift = np.uint64(8 * (DEPTH - 1))

    def prepared(payload: bytes):
        t = B.load(payload)
        ids, texts = t.column("doc_id").to_pylist(), [x.lower() for x in utf8(t.column("text"))]
        return ids, texts, np.array([is_held_out(i) for i in ids], bool)

    def range_of(key: np.ndarray) -> np.ndarray:
        return (mix((key >> shift) + np.uint64(1)) % np.uint64(ranges)).astype(np.int64)

    def distinct(x: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct numbers under 2**63 and how many of them are from training."""
        y = x << np.uint64(1)
        y |= train
        y.sort()
        k = y >> np.uint64(1)
        first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
        return k[first], np.add.reduceat(y & np.uint64(1), first) if len(k) else y

    def gram_parts(key: np.ndarray):
        """(range, places) of each range; the places of one range are in order."""
        spot = np.flatnonzero(np.concatenate([[True], (key[1:] >> shift) != (key[:-1] >> shift)])) if len(key) else np.zeros(0, np.int64)
        g = np.repeat(range_of(key[spot]), np.diff(np.append(spot, len(key))))
        order = np.argsort(g, kind="stable")
        if not len(g):
            return
        edge = np.flatnonzero(np.concatenate([[True], g[order][1:] != g[order][:-1]]))
        for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(g)], strict=True):
            yield int(g[order[a]]), order[a:b]

    schema = pa.schema([("range", pa.int32()), ("block", pa.int64()), ("numbers", pa.binary()), ("extra", pa.binary()), ("pair", pa.int32()), ("n", pa.int64())])
    kinds = "range int, block long, numbers binary, extra binary, pair int, n long"

    def ask(batches):
        for rb in batches:
            for block, payload in zip(rb.column("block").to_pylist(), rb.column("payload").to_pylist(), strict=True):
                _, texts, held = prepared(payload)
                raw, sizes = stream(texts)
                train = np.repeat(~held, sizes).astype(np.uint64)
                keys = gram_keys(raw, sizes)
                pairs = np.bincount((((keys >> np.uint64(8 * DEPTH)) << np.uint64(8)) | (keys & np.uint64(255))).astype(np.int64), weights=train, minlength=65536).astype(np.int64)
                key, n = distinct(keys, train)
                del keys
                rows = [(g, block, B.code(key[at]), B.planes(n[at]), None, None) for g, at in gram_parts(key)]
                rows += [(None, block, None, None, p, int(pairs[p])) for p in np.flatnonzero(pairs).tolist()]
                rows.append((None, block, None, None, -1, int((~held).sum())))
                words, counts = word_hashes(texts)
                word, n = distinct(words >> np.uint64(1), np.repeat(~held, counts).astype(np.uint64))
                rows += [(-1 - g, block, B.code(word[a:b]), B.planes(n[a:b]), None, None) for g, a, b in B.range_cuts(word, 63, word_ranges)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    asked = stored(arrow_map(stored_blocks.select("block", "payload"), ask, kinds))
    shallow = np.zeros(65536, np.int64)
    train_docs = 0
    for pair, n in asked.where("pair is not null").groupBy("pair").agg(F.sum("n")).collect():
        if pair < 0:
            train_docs = n
        else:
            shallow[pair] = n
    shallow = shallow.reshape(256, 256)

    def merged(t: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        each, n = [B.decode(x) for x in t.column("numbers").to_pylist()], [B.unplanes(x) for x in t.column("extra").to_pylist()]
        every, n = np.concatenate(each), np.concatenate(n).astype(np.int64)
        order = np.argsort(every, kind="stable")
        every = every[order]
        first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
        return each, every[first], np.add.reduceat(n[order], first)

    def sums(t: pa.Table) -> pa.Table:
        _, key, n = merged(t)
        at, s = top_sums(key, n)
        return pa.table({"at": pa.array(at, pa.int32()), "s": pa.array(s, pa.int64())})

    asking = asked.where("range is not null").select("range", "block", "numbers", "extra")
    top = np.zeros(256 * 255)
    for at, value in asking.where("range >= 0").groupBy("range").applyInArrow(sums, "at int, s long").groupBy("at").agg(F.sum("s")).collect():
        top[at] = value / LOG_UNIT
    tree = Shallow(shallow, top)

    def answer(t: pa.Table) -> pa.Table:
        each, key, n = merged(t)
        if t.column("range")[0].as_py() >= 0:
            value = np.minimum(np.ceil(code_lengths(key, n, tree) * PARTS), 2**32 - 1).astype(np.uint64)
            stats = (0, 0)
        else:
            value, stats = n.astype(np.uint64), (int((n > 0).sum()), int(n.sum()))
        out = [B.planes(value[np.searchsorted(key, x)]) for x in each]
        size = len(out)
        return pa.table({"block": t.column("block"), "range": t.column("range"), "answer": pa.array(out, pa.binary()), "v": pa.array([stats[0]] + [0] * (size - 1), pa.int64()), "n": pa.array([stats[1]] + [0] * (size - 1), pa.int64())})

    answers = stored(asking.groupBy("range").applyInArrow(answer, "block long, range int, answer binary, v long, n long"))
    v, n = answers.agg(F.coalesce(F.sum("v"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    distinct_tokens, train_tokens = v + (train_docs > 0), n + train_docs
    unit = train_tokens + distinct_tokens + 1
    result = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("bits_per_byte", pa.float64())])

    def lookup(keys: np.ndarray, known: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Values of keys of at most 48 bits; chunks are sorted first, so that the search goes through memory in order."""
        out = np.zeros(len(keys), value.dtype)
        for i in range(0, len(keys), CHUNK):
            part = keys[i : i + CHUNK]
            s = np.sort(part << np.uint64(16) | np.arange(len(part), dtype=np.uint64))
            out[i + (s & np.uint64(0xFFFF)).astype(np.int64)] = value[np.searchsorted(known, s >> np.uint64(16))]
        return out

    def finish(block: int, payload: bytes, got: dict[int, bytes]) -> pa.Table:
        ids, texts, held = prepared(payload)
        raw, sizes = stream(texts)
        keys = gram_keys(raw, sizes)
        key = distinct(keys, np.zeros(len(keys), np.uint64))[0]
        value = np.zeros(len(key), np.uint32)
        for g, at in gram_parts(key):
            value[at] = B.unplanes(got[g])
        bits = np.add.reduceat(lookup(keys, key, value).astype(np.int64), np.cumsum(sizes) - sizes) / PARTS
        del keys
        words, counts = word_hashes(texts)
        word, at = np.unique(words >> np.uint64(1), return_inverse=True)
        c = [B.unplanes(got[-1 - g]) for g, _, _ in B.range_cuts(word, 63, word_ranges)]
        c = np.concatenate(c).astype(np.float64)[at] if c else np.zeros(0)
        ends = np.cumsum(counts)
        known = np.concatenate([[0], np.cumsum(c > 0)])
        begin = ends - counts
        base = np.array([math.fsum(np.log10((c[a:b] + 1) / unit).tolist()) for a, b in zip(begin.tolist(), ends.tolist(), strict=True)]) + math.log10((train_docs + 1) / unit)
        return pa.table([
            pa.array(ids, pa.int64()), pa.array(held), pa.array(counts + 1), pa.array(known[ends] - known[begin] + (train_docs > 0), pa.int64()), pa.array([train_tokens] * len(ids), pa.int64()),
            pa.array(base), pa.array(-bits * math.log10(2)), pa.array(bits / sizes),
        ], schema=result)

    out = B.with_answers(stored_blocks, answers, finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double", result)
    return out
