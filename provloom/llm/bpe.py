"""Byte-level BPE by prefix dynamic programming: every byte prefix keeps its one valid last token."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from itertools import chain
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_map, batch, by_bytes, id_and_text, rows_of
from .tokens import BATCH_BYTES, chunks_of, read_ranks

#: Pieces, chunks and pairs of tokens that a worker remembers (about 400 bytes each).
MEMO = 600_000


class Vocabulary:
    """Ranks of byte strings, and which tokens may stand next to each other in an encoding."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks, self.bytes_of = ranks, {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self.reach: dict[bytes, int] = {}  # last three bytes -> length of the longest token that ends with them
        for b in ranks:
            if len(b) > 2:
                self.reach[b[-3:]] = max(self.reach.get(b[-3:], 0), len(b))
        self.close: dict[int, bool] = {}
        self.parts: dict[int, tuple[int, int] | None] = {}

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one (None for a byte, or if its own encoding is not itself)."""
        if token not in self.parts:
            b = self.bytes_of[token]
            parts = [b[i : i + 1] for i in range(len(b))]
            last = None
            while len(parts) > 1:
                best = min((self.ranks.get(x + y, 1 << 60), i) for i, (x, y) in enumerate(zip(parts, parts[1:], strict=False)))
                if best[0] == 1 << 60:
                    break
                i = best[1]
                last = (self.ranks[parts[i]], self.ranks[parts[i + 1]])
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            self.parts[token] = last if len(parts) == 1 else None
        return self.parts[token]

    def whole(self, token: int) -> bool:
        return len(self.bytes_of[token]) == 1 or self.halves(token) is not None

    def adjacent(self, left: int, right: int) -> bool:
        """Whether left, right is the encoding of their joined bytes: no merge across their border comes before one inside."""
        known = self.close.get(left << 32 | right)
        if known is None:
            if len(self.close) > MEMO:
                self.close.clear()
            known = self.close[left << 32 | right] = self._adjacent(left, right)
        return known

    def _adjacent(self, left: int, right: int) -> bool:
        limit, a, b = 1 << 60, left, right
        while True:  # undo the latest merge on either side and see whether one across the border was due before it
            across = self.ranks.get(self.bytes_of[a] + self.bytes_of[b], 1 << 60)
            if across < limit:
                return False
            x, y = self.halves(a), self.halves(b)
            if x is None and y is None:
                return True
            # of equal ranks the left one is merged first, so the right one is undone first
            if y is None or (x is not None and a > b):
                limit, a = a, x[1]  # a border merge of the same rank as a is to its right: a comes first
            else:
                limit, b = b + 1, y[0]  # one of the same rank as b is to its left: it comes first


class PrefixEncoder:
    """Encoding of a growing or edited byte string. last[i]: the last token of the encoding of the first i bytes.

    A prefix's encoding ends with token t exactly if t ends there and may stand after the last token of what is
    before t; just one token does. So bytes can be appended without looking back further than the longest
    token, and after an edit only prefixes up to where the last tokens agree again are computed anew.
    """

    def __init__(self, vocabulary: Vocabulary, data: bytes = b"") -> None:
        self.v, self.data, self.last = vocabulary, b"", [-1]
        self.append(data)

    def _token_at(self, data: bytes, end: int) -> int:
        ranks, last, v = self.v.ranks, self.last, self.v
        for start in range(max(0, end - max(v.reach.get(data[max(0, end - 3) : end], 2), 2)), end):
            t = ranks.get(data[start:end])
            if t is not None and v.whole(t) and (start == 0 or v.adjacent(last[start], t)):
                return t
        raise ValueError("the vocabulary lacks single bytes")

    def append(self, more: bytes) -> None:
        first = len(self.data) + 1
        self.data += more
        for end in range(first, len(self.data) + 1):
            self.last.append(self._token_at(self.data, end))

    def edit(self, start: int, stop: int, new: bytes) -> int:
        """Replace bytes start to stop; returns how many prefixes were computed."""
        data = self.data[:start] + new + self.data[stop:]
        old, shift = self.last, len(new) - (stop - start)
        self.last, agreed, done = old[: start + 1], 0, 0
        for end in range(start + 1, len(data) + 1):
            t = self._token_at(data, end)
            self.last.append(t)
            done += 1
            agreed = agreed + 1 if end > start + len(new) and old[end - shift] == t else 0
            if agreed >= self.v.longest:  # all that later prefixes look at is as before
                self.last += old[end - shift + 1 :]
                break
        self.data = data
        return done

    def ids(self) -> list[int]:
        out, end = [], len(self.data)
        while end:
            out.append(self.last[end])
            end -= len(self.v.bytes_of[out[-1]])
        return out[::-1]


#: Bytes up to which pieces are computed many at once; longer ones go through PrefixEncoder. Pairs that are kept for that.
SHORT = 64
PAIRS = 400_000


class SuffixTrie:
    """The vocabulary's tokens from their last byte backward, as an open hash table of (node, byte) -> node."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        tokens = sorted((b[::-1], t) for b, t in ranks.items())
        width = max(map(len, ranks))
        text = np.zeros((len(tokens), width), np.int64)
        for i, (b, _) in enumerate(tokens):
            text[i, : len(b)] = np.frombuffer(b, np.uint8)
        lengths = np.array([len(b) for b, _ in tokens])
        ids = np.array([t for _, t in tokens])
        at, nodes, edges, to = np.zeros(len(tokens), np.int64), 1, [], []
        self.token = [np.array([-1])]
        for d in range(width):
            live = np.flatnonzero(lengths > d)
            key, first, inverse = np.unique(at[live] << 8 | text[live, d], return_index=True, return_inverse=True)
            at[live] = nodes + inverse
            token = np.full(len(key), -1)
            done = live[lengths[live] == d + 1]
            token[at[done] - nodes] = ids[done]
            self.token.append(token)
            edges.append(key)
            to.append(nodes + np.arange(len(key)))
            nodes += len(key)
        self.token = np.concatenate(self.token)
        key, to = np.concatenate(edges), np.concatenate(to)
        self.mask = (1 << (4 * len(key)).bit_length()) - 1
        self.keys, self.to = np.full(self.mask + 1, -1, np.int64), np.zeros(self.mask + 1, np.int64)
        left, slot = np.arange(len(key)), self._slot(key)
        while len(left):
            free = self.keys[slot] == -1
            self.keys[slot[free]] = key[left[free]]
            placed = self.keys[slot] == key[left]
            self.to[slot[placed]] = to[left[placed]]
            left, slot = left[~placed], (slot[~placed] + 1) & self.mask

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key * 0x9E3779B97F4A7C1 >> 20) & self.mask

    def child(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """0 where there is none."""
        key = node << 8 | byte
        slot = self._slot(key)
        found, out = self.keys[slot], np.zeros(len(key), np.int64)
        hit = found == key
        out[hit] = self.to[slot[hit]]
        open_ = np.flatnonzero(~hit & (found != -1))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & self.mask
            found = self.keys[slot[open_]]
            hit = found == key[open_]
            out[open_[hit]] = self.to[slot[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
        return out


class ManyEncoder:
    """The prefix program for many short pieces together: prefixes of one length at a time."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v, self.trie = vocabulary, SuffixTrie(vocabulary.ranks)
        self.size = np.zeros(max(vocabulary.bytes_of) + 1, np.int64)
        for t, b in vocabulary.bytes_of.items():
            self.size[t] = len(b)
        self.known, self.fit = np.array([-1], np.int64), np.array([False])

    def fits(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """For pairs of tokens whether they may be neighbours; left -1: the beginning."""
        pair = (left + 1) << 32 | right
        at = np.minimum(np.searchsorted(self.known, pair), len(self.known) - 1)
        new = np.unique(pair[self.known[at] != pair])
        if len(new):
            v = self.v
            fit = [v.whole(p & 0xFFFFFFFF) and (p >> 32 == 0 or v.adjacent((p >> 32) - 1, p & 0xFFFFFFFF)) for p in new.tolist()]
            if len(self.known) > PAIRS:
                self.known, self.fit = np.array([-1], np.int64), np.array([False])
                return self.fits(left, right)
            where = np.searchsorted(self.known, new)
            self.known, self.fit = np.insert(self.known, where, new), np.insert(self.fit, where, fit)
            at = np.searchsorted(self.known, pair)
        return self.fit[at]

    def encode(self, pieces: list[bytes]) -> list[list[int]]:
        if not pieces:
            return []
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        order = np.argsort(-lengths, kind="stable")
        lengths, n, width = lengths[order], len(pieces), int(lengths.max())
        text = np.zeros((n, width), np.int64)
        text[np.arange(width) < lengths[:, None]] = np.frombuffer(b"".join(pieces[i] for i in order.tolist()), np.uint8)
        last = np.full((n, width + 1), -1, np.int64)
        for end in range(1, width + 1):
            rows = np.arange(np.searchsorted(-lengths, -end, "right"))  # pieces of at least `end` bytes come first
            node, live, options = np.zeros(len(rows), np.int64), rows, []
            for back in range(1, end + 1):
                node = self.trie.child(node, text[live, end - back])
                live, node = live[node > 0], node[node > 0]
                token = self.trie.token[node]
                if (token >= 0).any():
                    options.append((back, live[token >= 0], token[token >= 0]))
                if not len(live):
                    break
            for back, who, token in reversed(options):
                free = last[who, end] == -1
                who, token = who[free], token[free]
                good = self.fits(last[who, end - back], token)
                last[who[good], end] = token[good]
        out: list[list[int]] = [[] for _ in pieces]
        at, rows = lengths.copy(), np.arange(n)
        while len(rows):
            token = last[rows, at[rows]]
            for i, t in zip(order[rows].tolist(), token.tolist(), strict=True):
                out[i].append(t)
            at[rows] -= self.size[token]
            rows = rows[at[rows] > 0]
        return [x[::-1] for x in out]


class Codec:
    """Encodes texts, each match of the split pattern by itself; remembers pieces, and chunks between safe boundaries."""

    def __init__(self, ranks_path: str, pattern: str) -> None:
        import regex

        self.v, self.split = Vocabulary(read_ranks(ranks_path)), regex.compile(pattern).findall
        self.many = ManyEncoder(self.v)
        self.pieces: dict[str, list[int]] = {}
        self.chunks: dict[str, tuple[int, bytes, bytes]] = {}

    def learn(self, pieces: set[str]) -> None:
        """Encode those pieces that are not remembered."""
        if len(self.pieces) > MEMO:
            self.pieces.clear()
        new = [p for p in pieces if p not in self.pieces]
        raw = [p.encode() for p in new]
        short = [i for i, r in enumerate(raw) if len(r) <= SHORT]
        for i, ids in zip(short, self.many.encode([raw[i] for i in short]), strict=True):
            self.pieces[new[i]] = ids
        for i in set(range(len(new))).difference(short):
            self.pieces[new[i]] = PrefixEncoder(self.v, raw[i]).ids()

    def encode(self, text: str) -> list[int]:
        pieces = self.split(text)
        self.learn(set(pieces))
        return list(chain.from_iterable(map(self.pieces.__getitem__, pieces)))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.v.bytes_of.__getitem__, ids))

    def _chunks(self, chunks: list[str]) -> Iterator[tuple[int, bytes, bytes]]:
        cut = [self.split(c) for c in chunks]
        self.learn(set(chain.from_iterable(cut)))
        for pieces in cut:
            ids = list(chain.from_iterable(map(self.pieces.__getitem__, pieces)))
            yield len(ids), " ".join(map(str, ids)).encode(), self.decode(ids)

    def coded(self, texts: list[str]) -> Iterator[tuple[int, bytes, bytes]]:
        """For each text: number of ids, ids in decimal joined by one space, and the bytes that the ids decode to."""
        cut = [chunks_of(t) for t in texts]
        if len(self.chunks) > MEMO:
            self.chunks.clear()
        heads = list(self._chunks([c[0] for c in cut]))
        new = list(set(chain.from_iterable(c[1:] for c in cut)).difference(self.chunks))
        self.chunks.update(zip(new, self._chunks([" " + c for c in new]), strict=True))
        for c, head in zip(cut, heads, strict=True):
            out = [x for x in (head,) if x[0]] + list(map(self.chunks.__getitem__, c[1:]))
            yield sum(map(itemgetter(0), out)), b" ".join(map(itemgetter(1), out)), b"".join(map(itemgetter(2), out))


@cache
def codec_of(ranks_path: str, pattern: str) -> Codec:
    """One for each worker process: what it remembers serves all its tasks."""
    return Codec(ranks_path, pattern)


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, ids_sha256, decoded_sha256; no shuffle.

    Null text: empty (no ids; digests of nothing). Null and repeated doc_ids are coded like others; an empty
    table gives no rows. The rank file must be readable at ranks_path on every executor.
    """

    def run(batches):
        codec = codec_of(ranks_path, pattern)
        for group in by_bytes(rows_of(batches), lambda r: len(r[1]) + 64, BATCH_BYTES):
            out = list(codec.coded([t.decode(errors="replace") for _, t in group]))
            yield batch(doc_id=([i for i, _ in group], pa.int64()), n_tokens=([n for n, _, _ in out], pa.int64()), ids_sha256=([hashlib.sha256(x).hexdigest() for _, x, _ in out], pa.string()), decoded_sha256=([hashlib.sha256(x).hexdigest() for _, _, x in out], pa.string()))

    return arrow_map(id_and_text(docs, id_col, text_col), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
