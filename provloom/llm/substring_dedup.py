"""Substring dedup: word k-mers are edges of a De Bruijn graph, whose repeated nonbranching paths are compacted."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from . import blocks as B
from .common import NO_ID, arrow_map, discard, id_and_text, stored, utf8
from .exact_dedup import mix

#: Words of a window, the number that bytes and words are powers of, and bytes hashed at once.
WINDOW = 13
BASE = np.uint64(0x9E3779B97F4A7C15)
PIECE = 1 << 19

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(PIECE, 1 << (n - 1).bit_length()) + 1
    if size not in _tables:
        ones = np.full(size, BASE)
        ones[0] = 1
        back = np.full(size, np.uint64(pow(int(BASE), -1, 1 << 64)))
        back[0] = 1
        _tables.clear()
        _tables[size] = np.cumprod(ones), np.cumprod(back)
    return _tables[size]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and each text's number of words. A word's hash is a polynomial in its bytes."""
    words, counts, i = [], np.zeros(len(texts), np.int64), 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) < PIECE):
            size += len(texts[j]) + 1
            j += 1
        raw = np.frombuffer(b"\n" + b"\n".join(texts[i:j]) + b"\n", np.uint8)
        space = _SPACE[raw]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        start, end = edge[::2], edge[1::2]
        power, back = _powers(len(raw) + 1)
        sums = np.concatenate([[np.uint64(0)], np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[: len(raw)])])
        words.append(mix((sums[end] - sums[start]) * back[start]))
        ends = np.cumsum([len(t) + 1 for t in texts[i:j]])
        counts[i:j] = np.diff(np.searchsorted(start, ends, "right"), prepend=0)
        i = j
    return (np.concatenate(words) if words else np.zeros(0, np.uint64)), counts


def among(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which numbers of x are in `known`, which is sorted: a search for each, so that many small x cost no more than one large."""
    if not len(known):
        return np.zeros(len(x), bool)
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    n = max(0, len(words) - k + 1)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h = h * BASE + words[j : j + n]
    return mix(h)


def window_hashes(words: np.ndarray, counts: np.ndarray, bits: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows inside one text, and the places (in words) where they start."""
    doc = np.repeat(np.arange(len(counts)), counts)
    at = np.flatnonzero(doc[: len(doc) - k + 1] == doc[k - 1 :]) if len(doc) >= k else np.zeros(0, np.int64)
    return gram_hashes(words, k)[at] >> np.uint64(64 - bits), at


def free_name(docs: DataFrame, name: str) -> str:
    """`name`, or the first of name_1, name_2, ... that docs has no column of (in any case)."""
    taken, n, out = {c.lower() for c in docs.columns}, 0, name
    while out in taken:
        n += 1
        out = f"{name}_{n}"
    return out


def _result(rows: pa.Table, names: tuple[str, str], n_words: list[int], n_removed: list[int], kept: list[bytes] | None, digests: list[str] | None) -> pa.Table:
    out = rows.drop_columns(["text"]).append_column(names[0], pa.array(n_words, pa.int64())).append_column(names[1], pa.array(n_removed, pa.int64()))
    return out.append_column("kept_sha256", pa.array(digests, pa.string())) if kept is None else out.append_column("text", pa.array([k.decode(errors="replace") for k in kept], pa.string()))


def remove_repeats(docs: DataFrame, k: int = WINDOW, texts: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove each word that a window of k words covers whose words also start somewhere in a document with a smaller doc_id.

    One row per row of docs: doc_id, n_words, n_removed and kept_sha256 (of the kept words, joined by one
    space); with texts=True all columns of docs, with the text that stays (unchanged where nothing goes),
    n_words and n_removed (under the names of free_name where docs has such columns).

    Windows are edges between their first and last k - 1 words. (1) Blocks of documents ask the ranges of the
    window hash which of their edges are repeated. (2) Runs of repeated edges are paths; a node where some run
    starts or ends, or where two documents come or go differently, is a cut. Blocks send each node with a digest
    of its edges to the ranges of the node hash, and learn the cuts. Between cuts a path never branches, so
    every document that has one of its edges has all of it. (3) Each such path is one row, named by a digest of
    its words themselves as they stand at the block's coordinates, with the smallest doc_id; an aggregation and
    a join give its first source; (4) what is not in its first source goes. Hashes only ever add cuts or name
    candidates; removal needs equal words.

    Blocks hold about the same number of bytes and hash ranges are even, so no passage, however common, meets in
    one task. A repeated doc_id is not smaller than itself: its copies stay. A null doc_id comes after all
    others. Null text: no words. Texts shorter than a window stay whole. An empty table gives no rows.
    """
    source = docs.withColumns({id_col: F.col(id_col).cast("long"), text_col: F.col(text_col).cast("string")}).withColumnsRenamed({id_col: "doc_id", text_col: "text"}) if texts else id_and_text(docs, id_col, text_col)
    names = [c for c in source.columns if c != "text"]
    counted = (free_name(source, "n_words"), free_name(source, "n_removed"))
    made = f"{counted[0]} long, {counted[1]} long, " + ("text string" if texts else "kept_sha256 string")
    kinds = ", ".join(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in names) + ", " + made
    stored_blocks = B.block_table(source)
    total = stored_blocks.agg(F.sum("n_bytes")).first()[0] or 0
    numbers = total // 6
    bits, ranges = B.bits_for(numbers), B.ranges_for(numbers)
    req = pa.schema([("range", pa.int32()), ("block", pa.int64()), ("numbers", pa.binary()), ("extra", pa.binary())])

    def ask_edges(batches):
        for b in batches:
            for block, payload in zip(b.column("block").to_pylist(), b.column("payload").to_pylist(), strict=True):
                words, counts = word_hashes(utf8(B.load(payload).column("text")))
                h = np.sort(window_hashes(words, counts, bits, k)[0])
                first = np.concatenate([[True], h[1:] != h[:-1]]) if len(h) else np.zeros(0, bool)
                once, n = h[first], np.diff(np.append(np.flatnonzero(first), len(h)))
                rows = [(g, block, B.code(once[i:j]), B.pack_bits(n[i:j] > 1)) for g, i, j in B.range_cuts(once, bits, ranges)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), req, strict=True)], schema=req)

    def repeated(numbers: list[bytes], extra: list[bytes]) -> list[bytes]:
        each = [B.decode(x) for x in numbers]
        every = np.sort(np.concatenate(each))
        again = every[1:][every[1:] == every[:-1]]
        return [B.pack_bits(among(x, again) | B.unpack_bits(e, len(x))) for x, e in zip(each, extra, strict=True)]

    flags = B.answered(arrow_map(stored_blocks.select("block", "payload"), ask_edges, "range int, block long, numbers binary, extra binary"), repeated)

    def flagged_of(sorted_once: np.ndarray, got: dict[int, bytes]) -> np.ndarray:
        parts = [sorted_once[i:j][B.unpack_bits(got[g], j - i)] for g, i, j in B.range_cuts(sorted_once, bits, ranges)]
        return np.concatenate(parts) if parts else sorted_once

    def runs_of(words: np.ndarray, counts: np.ndarray, hot: np.ndarray):
        """Places of hot windows, and whether each goes on from the one before it."""
        h, at = window_hashes(words, counts, bits, k)
        on = among(h, hot)
        h, at = h[on], at[on]
        doc = np.repeat(np.arange(len(counts)), counts)
        follows = np.concatenate([[False], (at[1:] == at[:-1] + 1) & (doc[at[1:]] == doc[at[:-1]])]) if len(at) else np.zeros(0, bool)
        return h, at, follows, doc

    def nodes_of(words: np.ndarray, h: np.ndarray, at: np.ndarray, follows: np.ndarray):
        """Node before each hot window and node after each that ends a run; a digest of the edges there, 0 at ends."""
        nodes = gram_hashes(words, k - 1) >> np.uint64(64 - bits)
        ends = np.concatenate([~follows[1:], [True]]) if len(at) else np.zeros(0, bool)
        both = np.where(follows, (mix(np.concatenate([h[:1] * 0, h[:-1]]) * BASE + h) >> np.uint64(24)) | np.uint64(1), np.uint64(0))
        return np.concatenate([nodes[at], nodes[at[ends] + 1]]), np.concatenate([both, np.zeros(int(ends.sum()), np.uint64)])

    wide = pa.schema([("block", pa.int64()), ("payload", pa.binary()), ("range", pa.int32()), ("numbers", pa.binary()), ("extra", pa.binary()), ("done", pa.binary())])

    def row(block: int, payload=None, g=None, numbers=None, extra=None, done=None) -> tuple:
        return block, payload, g, numbers, extra, done

    def finish(t: pa.Table, doc_words: list[int], gone: dict[int, np.ndarray]) -> pa.Table:
        """Result rows; gone: for a row, which of its words go."""
        kept, digests, removed = [], [], []
        for i, raw in enumerate(utf8(t.column("text"))):
            go = gone.get(i)
            if go is None and texts:
                kept.append(raw)
            else:
                w = raw.split()
                left = b" ".join(w if go is None else [x for x, g in zip(w, go.tolist(), strict=True) if not g])
                (kept if texts else digests).append(left if texts else hashlib.sha256(left).hexdigest())
            removed.append(0 if go is None else int(go.sum()))
        return _result(t, counted, doc_words, removed, kept if texts else None, None if texts else digests)

    def ask_nodes(block: int, payload: bytes, got: dict[int, bytes]) -> pa.Table:
        t = B.load(payload)
        words, counts = word_hashes(utf8(t.column("text")))
        hot = flagged_of(np.unique(window_hashes(words, counts, bits, k)[0]), got)
        h, at, follows, doc = runs_of(words, counts, hot)
        some = np.zeros(len(counts), bool)
        some[doc[at]] = True
        rows = [row(block, done=B.dump(finish(t.filter(pa.array(~some)), counts[~some].tolist(), {})))]
        if some.any():
            rows.append(row(block, payload=B.dump(pa.table({"rows": [B.dump(t.filter(pa.array(some)))], "hot": [B.code(hot)]}))))
            node, both = nodes_of(words, h, at, follows)
            order = np.lexsort((both, node))
            node, both = node[order], both[order]
            first = np.concatenate([[True], node[1:] != node[:-1]])
            spot = np.flatnonzero(first)
            same = np.minimum.reduceat(both, spot) == np.maximum.reduceat(both, spot)
            node, both = node[spot], np.where(same, both[spot], np.uint64(0))
            rows += [row(block, g=g, numbers=B.code(node[i:j]), extra=B.planes(both[i:j])) for g, i, j in B.range_cuts(node, bits, ranges)]
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), wide, strict=True)], schema=wide)

    second = stored(B.with_answers(stored_blocks, flags, ask_nodes, "block long, payload binary, range int, numbers binary, extra binary, done binary", wide))

    discard(stored_blocks)

    def cuts(numbers: list[bytes], extra: list[bytes]) -> list[bytes]:
        each = [B.decode(x) for x in numbers]
        node, both = np.concatenate(each), np.concatenate([B.unplanes(x) for x in extra])
        order = np.argsort(node, kind="stable")
        s = node[order]
        spot = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        low, high = np.minimum.reduceat(both[order], spot), np.maximum.reduceat(both[order], spot)
        bad = s[spot][(low != high) | (low == 0)]
        return [B.pack_bits(among(x, bad)) for x in each]

    node_answers = B.answered(second.where("numbers is not null"), cuts)
    third_schema = pa.schema([("block", pa.int64()), ("payload", pa.binary()), ("path", pa.string()), ("first", pa.int64())])

    def name_paths(block: int, payload: bytes, got: dict[int, bytes]) -> pa.Table:
        p = B.load(payload)
        t, hot = B.load(p.column("rows")[0].as_py()), B.decode(p.column("hot")[0].as_py())
        raw, ids = utf8(t.column("text")), [NO_ID if i is None else i for i in t.column("doc_id").to_pylist()]
        words, counts = word_hashes(raw)
        h, at, follows, doc = runs_of(words, counts, hot)
        cut = flagged_of(np.unique(nodes_of(words, h, at, follows)[0]), got)
        nodes = gram_hashes(words, k - 1) >> np.uint64(64 - bits)
        begins = ~follows | among(nodes[at], cut)
        spot = np.flatnonzero(begins)
        length = np.diff(np.append(spot, len(at))) + k - 1  # in words
        base = np.cumsum(counts) - counts
        d, start = doc[at[spot]], at[spot] - base[doc[at[spot]]]
        names, split, now = [], [], -1
        for i, a, n in zip(d.tolist(), start.tolist(), length.tolist(), strict=True):
            if i != now:
                split, now = raw[i].split(), i
            names.append(hashlib.blake2b(b" ".join(split[a : a + n]), digest_size=16).hexdigest())
        low: dict[str, int] = {}
        for i, name in zip(d.tolist(), names, strict=True):
            low[name] = min(low.get(name, NO_ID), ids[i])
        more = pa.table({"doc": d, "start": start, "length": length, "path": names})
        body = B.dump(pa.table({"rows": [B.dump(t)], "paths": [B.dump(more)], "counts": [counts.tolist()]}))
        return pa.table([pa.array(c, f.type) for c, f in zip(([block] * (len(low) + 1), [body] + [None] * len(low), [None, *low], [None, *low.values()]), third_schema, strict=True)], schema=third_schema)

    third = stored(B.with_answers(second.where("payload is not null"), node_answers, name_paths, "block long, payload binary, path string, first long", third_schema))
    paths = third.where("path is not null").select("block", "path", "first")
    firsts = paths.groupBy("path").agg(F.min("first").alias("source"))
    answers = paths.join(firsts, "path").select(F.col("block").alias("asked_by"), "path", "source")
    final_schema = to_arrow_schema(_parse_datatype_string(kinds))

    def remove(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return final_schema.empty_table()
        source = dict(zip(right.column("path").to_pylist(), right.column("source").to_pylist(), strict=True))
        out = []
        for payload in left.column("payload").to_pylist():
            p = B.load(payload)
            t, found = B.load(p.column("rows")[0].as_py()), B.load(p.column("paths")[0].as_py())
            ids = [NO_ID if i is None else i for i in t.column("doc_id").to_pylist()]
            counts = p.column("counts")[0].as_py()
            gone: dict[int, np.ndarray] = {}
            for d, start, n, path in zip(*(found.column(c).to_pylist() for c in ("doc", "start", "length", "path")), strict=True):
                if source[path] < ids[d]:
                    gone.setdefault(d, np.zeros(counts[d], bool))[start : start + n] = True
            out.append(finish(t, counts, gone))
        return pa.concat_tables(out)

    changed = third.where("payload is not null").select("block", "payload").groupBy("block").cogroup(answers.groupBy("asked_by")).applyInArrow(remove, kinds)

    def rows_out(batches):
        for b in batches:
            for done in b.column("done").to_pylist():
                yield from B.load(done).to_batches(max_chunksize=5000)

    return arrow_map(second.where("done is not null").select("done"), rows_out, kinds).union(changed)
