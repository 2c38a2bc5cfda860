"""Hierarchical multi-length packing of token ids into sequences."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import arrow_map, batch, by_bytes, id_and_text, rows_of
from .tokens import BATCH_BYTES, rank_id_bytes

#: Context tiers, the longest first. Tokens of one packing block, and of one step group.
TIERS = (1024, 512, 256, 128)
BLOCK_TOKENS = 4_000_000
STEP_TOKENS = 8192
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


def _slots(starts: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cut a stream of items (their starts, then its end) at `bounds` too: item, slot and length of each piece."""
    cuts = np.union1d(starts, bounds)
    cuts = cuts[cuts <= starts[-1]]
    left = cuts[:-1]
    return np.searchsorted(starts, left, "right") - 1, np.searchsorted(bounds, left, "right") - 1, np.diff(cuts)


def _sums(x: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(x)]).astype(np.int64)


def pack_lengths(lengths: np.ndarray, tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS) -> dict[str, np.ndarray]:
    """Pieces of documents of these lengths: doc, start, length, seq, offset, tier, step.

    A document fills as many windows of the longest tier as it can; its rest is routed to the shortest tier
    that holds it. Rests of the longest tier open a window each, whose gap is filled from the shorter tiers.
    If gaps remain, those rests are run together; if shorter rests remain, each tier is cut into sequences of
    exactly its length, what is left going down a tier. So only the last sequence has padding.
    Step groups are runs of sequences of one tier with equal numbers of tokens.
    """
    window, parts, seqs = tiers[0], [], []  # parts: doc, start, length, seq, offset; seqs: tier of each sequence
    n = 0

    def take(doc, start, length, seq, offset) -> None:
        if len(doc):
            parts.append([np.asarray(a, np.int64) for a in (doc, start, length, seq, offset)])

    def opened(k: int, tier: int) -> int:
        nonlocal n
        seqs.append(np.full(k, tier, np.int64))
        n += k
        return n - k

    full = lengths // window
    doc = np.repeat(np.arange(len(lengths)), full)
    nth = np.arange(len(doc)) - np.repeat(_sums(full)[:-1], full)
    take(doc, nth * window, np.full(len(doc), window), opened(len(doc), window) + np.arange(len(doc)), np.zeros(len(doc)))
    rest, at = lengths % window, full * window
    route = np.searchsorted(np.array(tiers[::-1]), np.maximum(rest, 1))  # the shortest tier that holds the rest
    long = np.flatnonzero((rest > 0) & (route == len(tiers) - 1))
    short = [np.flatnonzero((rest > 0) & (route == len(tiers) - 1 - k)) for k in range(1, len(tiers))]
    order = np.concatenate(short) if short else np.zeros(0, np.int64)
    gaps, have = _sums(window - rest[long]), _sums(rest[order])
    filled = int(np.searchsorted(gaps, have[-1], "right")) - 1  # windows whose gap the shorter tiers fill
    base = opened(filled, window)
    take(long[:filled], at[long[:filled]], rest[long[:filled]], base + np.arange(filled), np.zeros(filled))
    item, slot, size = _slots(have, gaps[: filled + 1])
    left = have[:-1][item] + 0
    begin = np.cumsum(size) - size
    inside = begin < gaps[filled]
    item_, slot_ = item[inside], slot[inside]
    take(order[item_], at[order[item_]] + begin[inside] - left[inside], size[inside], base + slot_, rest[long[slot_]] + begin[inside] - gaps[slot_])
    used = gaps[filled]  # of the stream of shorter rests
    streams: list[list[np.ndarray]] = [[] for _ in tiers]  # by tier: doc, start, length of what is left
    streams[0].append(np.stack([long[filled:], at[long[filled:]], rest[long[filled:]]]))
    gone = np.clip(used - have[:-1], 0, rest[order])
    k = np.concatenate([np.full(len(s), i + 1) for i, s in enumerate(short)]) if short else np.zeros(0, int)
    for i in range(1, len(tiers)):
        keep = (k == i) & (gone < rest[order])
        to = 0 if filled < len(long) else i  # with windows still open, all goes to the longest tier
        streams[to].append(np.stack([order[keep], at[order[keep]] + gone[keep], (rest[order] - gone)[keep]]))
    for i, tier in enumerate(tiers):
        d, s, m = np.concatenate(streams[i], axis=1).astype(np.int64) if streams[i] else np.zeros((3, 0), np.int64)
        ends = _sums(m)
        whole = ends[-1] // tier
        last = i == len(tiers) - 1
        count = int(whole + (last and ends[-1] % tier > 0))
        bounds = np.arange(whole + 1) * tier
        item, slot, size = _slots(ends, bounds)
        begin = np.cumsum(size) - size
        here = np.ones(len(item), bool) if last else slot < whole
        base = opened(count, tier)
        take(d[item[here]], s[item[here]] + (begin - ends[item])[here], size[here], base + slot[here], (begin - slot * tier)[here])
        if not last:
            go = ~here
            streams[i + 1].insert(0, np.stack([d[item[go]], s[item[go]] + (begin - ends[item])[go], size[go]]))
    out = np.concatenate(parts, axis=1) if parts else np.zeros((5, 0), np.int64)
    tier_of = np.concatenate(seqs) if seqs else np.zeros(0, np.int64)
    step = np.zeros(n, np.int64)
    first = 0
    for tier in tiers:
        mine = np.flatnonzero(tier_of == tier)
        step[mine] = first + np.arange(len(mine)) // max(1, step_tokens // tier)
        first = step[mine[-1]] + 1 if len(mine) else first
    return dict(zip(("doc", "start", "length", "seq", "offset"), out, strict=True)) | {"tier": tier_of[out[3]], "step": step[out[3]]}


def pack(docs: DataFrame, path: str, ranks_path: str, pattern: str, tiers: tuple[int, ...] = TIERS, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents (their ids, then end_id) packed into sequences.

    Each input partition packs its own documents in blocks of about BLOCK_TOKENS, so there is no shuffle, no
    task depends on another, and a lost task is run again alone; the price is less than one partly filled
    sequence a block. Sequence and step group ids hold the partition's number in their upper half. The last
    sequence of a block has fewer tokens than the shortest tier and is padded to the longest; all others are
    exactly as long as their tier. A null text is an empty document (its end_id only); null and repeated
    doc_ids are packed like others; an empty table gives no rows.
    """

    def run(batches):
        encode = rank_id_bytes(path, ranks_path, pattern)
        end = np.array([end_id], "<u4").tobytes()
        base = TaskContext.get().partitionId() << 32
        seqs = steps = held = 0
        block: list[tuple[int | None, bytes]] = []

        def flush():
            nonlocal seqs, steps
            lengths = np.array([len(b) // 4 for _, b in block], np.int64)
            p = pack_lengths(lengths, tiers)
            docs_, starts, sizes = p["doc"].tolist(), p["start"].tolist(), p["length"].tolist()
            crc = [zlib.crc32(memoryview(block[d][1])[4 * s : 4 * (s + m)]) for d, s, m in zip(docs_, starts, sizes, strict=True)]
            yield batch(
                doc_id=([block[d][0] for d in docs_], pa.int64()), start=(p["start"], pa.int64()), length=(p["length"], pa.int64()), ids_crc32=(crc, pa.int64()), doc_tokens=(lengths[p["doc"]], pa.int64()),
                sequence_id=(base + seqs + p["seq"], pa.int64()), offset=(p["offset"], pa.int64()), tier=(p["tier"], pa.int32()), step_group=(base + steps + p["step"], pa.int64()),
            )
            seqs += int(p["seq"].max()) + 1
            steps += int(p["step"].max()) + 1

        for group in by_bytes(rows_of(batches), lambda r: len(r[1]) + 64, BATCH_BYTES):
            for (i, _), ids in zip(group, encode([t.decode(errors="replace") for _, t in group]), strict=True):
                block.append((i, ids + end))
                held += len(block[-1][1]) // 4
                if held >= BLOCK_TOKENS:
                    yield from flush()
                    block, held = [], 0
        if block:
            yield from flush()

    return arrow_map(id_and_text(docs, id_col, text_col), run, SCHEMA)
