"""Token counts and ids with a byte-level BPE vocabulary, through a memo of the chunks between single spaces.

A single space between two characters that are not white space always starts a new match of the
vocabulary's split pattern, and no special string holds a space. So a text may be cut there, its
chunks encoded one by one, and chunks seen before looked up: the results are those of the whole text.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterable, Iterator
from functools import cache
from itertools import chain
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, batch, by_bytes, id_and_text, rows_of

#: Bytes of text that one batch of the encoder holds, and chunks that a worker remembers.
BATCH_BYTES = 2_000_000
MEMO = 300_000
_ODD_SPACE = re.compile(r" \s")
_SAFE_CUT = re.compile(r"(?<=\S) (?=\S)")


def chunks_of(text: str) -> list[str]:
    """Chunks between safe boundaries. All but the first have lost the one space before them."""
    return _SAFE_CUT.split(text) if _ODD_SPACE.search(text) else text.split(" ")


class ChunkMemo:
    """encode: many strings at once to one value each; a value stands for a chunk with the space before it."""

    def __init__(self, encode: Callable[[list[str]], Iterable[Any]], most: int = MEMO) -> None:
        self.encode, self.most, self.known = encode, most, {}

    def of(self, texts: list[str]) -> Iterator[list[Any]]:
        """For each text the values of its chunks."""
        cut = [chunks_of(t) for t in texts]
        heads = self.encode([c[0] for c in cut])
        tails = [c[1:] for c in cut]
        if len(self.known) > self.most:
            self.known = {}
        new = list(set(chain.from_iterable(tails)).difference(self.known))
        self.known.update(zip(new, self.encode([" " + c for c in new]), strict=True))
        get = self.known.__getitem__
        for head, tail in zip(heads, tails, strict=True):
            yield [head, *map(get, tail)]


def load(path: str):
    """The vocabulary file's tokenizer, on one thread, without truncation or padding."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


@cache
def counter(path: str) -> ChunkMemo:
    t = load(path)
    return ChunkMemo(lambda xs: [len(e) for e in t.encode_batch_fast(xs, add_special_tokens=False)])


@cache
def id_bytes(path: str) -> ChunkMemo:
    """Values are little-endian unsigned 32-bit ids."""
    t = load(path)
    return ChunkMemo(lambda xs: [np.array(e.ids, "<u4").tobytes() for e in t.encode_batch_fast(xs, add_special_tokens=False)])


#: Characters whose class no Unicode version has changed: here both libraries split alike.
_PLAIN = re.compile("[\t-\r -~\u00a0-\u024f\u2010-\u2027\u20ac]*")


@cache
def rank_id_bytes(path: str, ranks_path: str, pattern: str) -> Callable[[list[str]], list[bytes]]:
    """Texts to their ids as little-endian unsigned 32-bit numbers. Plain texts go through the same
    vocabulary's rank file, which is several times as fast on words never seen before; all others
    (special strings, rare scripts) through the tokenizer itself."""
    from array import array

    memo, plain = id_bytes(path), _PLAIN.fullmatch
    quick = rank_encoding(ranks_path, pattern).encode_ordinary

    def encode(xs: list[str]) -> list[bytes]:
        odd = [i for i, x in enumerate(xs) if not plain(x) or "<|" in x]
        slow = dict(zip(odd, map(b"".join, memo.of([xs[i] for i in odd])), strict=True)) if odd else {}
        return [slow[i] if i in slow else array("I", quick(x)).tobytes() for i, x in enumerate(xs)]

    return encode


def read_ranks(path: str) -> dict[bytes, int]:
    import base64

    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def rank_encoding(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={})


def count_tokens(docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_tokens, over_limit.

    The vocabulary file must be readable at `path` on every executor. Only lengths leave the workers.
    Batches hold about BATCH_BYTES of text whatever the number of rows; very long texts are cut at safe
    boundaries like all others. A null text counts as empty (0 bytes, 0 tokens); a null doc_id stays null;
    repeated rows are counted each; an empty table gives an empty result. No shuffle.
    """

    def run(batches):
        memo = counter(path)
        for group in by_bytes(rows_of(batches), lambda r: len(r[1]) + 64, BATCH_BYTES):
            n = [sum(v) for v in memo.of([t.decode(errors="replace") for _, t in group])]
            yield batch(doc_id=([i for i, _ in group], pa.int64()), n_bytes=([len(t) for _, t in group], pa.int64()), n_tokens=(n, pa.int64()))

    out = arrow_map(id_and_text(docs, id_col, text_col), run, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
