"""Blocks of documents that are stored as single rows, and requests that blocks send to ranges of a hash and get answered.

A block row is written once to the shared folder, so its number stays its own through all later passes,
whatever executors are lost. Requests are sorted numbers, coded by their differences: a few bytes each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, batch, stored

BLOCK_BYTES = 8_000_000
#: Numbers that one range takes (about), and the least number of ranges. From GROWTH numbers on (30 GB of text) ranges grow with the
#: square root of all, up to MOST_NUMBERS, so that messages stay longer as blocks become more.
RANGE_NUMBERS = 1_500_000
LEAST_RANGES = 64
GROWTH = 5_000_000_000
MOST_NUMBERS = 12_000_000


def dump(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(table)
    return sink.getvalue().to_pybytes()


def load(payload: bytes) -> pa.Table:
    return pa.ipc.open_stream(payload).read_all()


def block_table(docs: DataFrame, text: str = "text", most: int | None = None) -> DataFrame:
    """block, n_rows, n_bytes, payload: all rows of docs in blocks of about `most` bytes of text."""
    most = most or BLOCK_BYTES

    def run(batches):
        part, n = TaskContext.get().partitionId() << 24, 0
        held: list[pa.RecordBatch] = []
        size = 0

        def out():
            t = pa.Table.from_batches(held)
            return batch(block=([part + n], pa.int64()), n_rows=([t.num_rows], pa.int64()), n_bytes=([size], pa.int64()), payload=([dump(t)], pa.binary()))

        for b in batches:
            lengths = np.array([len(x or b"") for x in b.column(text).cast(pa.binary()).to_pylist()], np.int64) + 16
            at = 0
            while at < b.num_rows:
                take = max(1, int(np.searchsorted(np.cumsum(lengths[at:]), most - size, "right")))
                held.append(b.slice(at, take))
                size += int(lengths[at : at + take].sum())
                at += take
                if size >= most or at < b.num_rows:
                    yield out()
                    held, size, n = [], 0, n + 1
        if size:
            yield out()

    return stored(arrow_map(docs, run, "block long, n_rows long, n_bytes long, payload binary"), rows_a_file=1)


def planes(x: np.ndarray) -> bytes:
    """Numbers as bytes, the lowest bytes of all first; the high, mostly zero ones shrink to nothing."""
    x = np.ascontiguousarray(x, "<u8")
    width = max(1, -(-int(x.max()).bit_length() // 8)) if len(x) else 1
    return bytes([width]) + zstandard.compress(x.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes(), 1)


def unplanes(b: bytes) -> np.ndarray:
    width, raw = b[0], np.frombuffer(zstandard.decompress(b[1:]), np.uint8)
    out = np.zeros((len(raw) // width, 8), np.uint8)
    out[:, :width] = raw.reshape(width, -1).T
    return out.reshape(-1).view("<u8")


def code(sorted_numbers: np.ndarray) -> bytes:
    return planes(np.diff(sorted_numbers, prepend=np.uint64(0)))


def decode(b: bytes) -> np.ndarray:
    return np.cumsum(unplanes(b), dtype=np.uint64)


def pack_bits(x: np.ndarray) -> bytes:
    return zstandard.compress(np.packbits(x).tobytes(), 1)


def unpack_bits(b: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zstandard.decompress(b), np.uint8), count=n).astype(bool)


def ranges_for(numbers: int) -> int:
    """A power of two."""
    each = min(MOST_NUMBERS, int(RANGE_NUMBERS * max(1.0, numbers / GROWTH) ** 0.5))
    return 1 << max(LEAST_RANGES - 1, -(-numbers // each) - 1).bit_length()


def bits_for(numbers: int) -> int:
    """Bits of a hash that keep chance agreements under 1 in 256 of the numbers."""
    return min(56, max(40, (max(1, numbers) - 1).bit_length() + 8))


def range_cuts(sorted_numbers: np.ndarray, bits: int, ranges: int) -> Iterator[tuple[int, int, int]]:
    """(range, from, to) of each range that has numbers; ranges are equal shares of the hash's values."""
    if not len(sorted_numbers):
        return
    g = (sorted_numbers >> np.uint64(bits - (ranges - 1).bit_length())).astype(np.int64)
    edge = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
    for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(g)], strict=True):
        yield int(g[a]), a, b


def answered(requests: DataFrame, answer: Callable[[list[bytes], list[bytes]], list[bytes]]) -> DataFrame:
    """Requests (range, block, numbers, extra) of one range meet in a task; each gets an answer: block, range, answer."""

    def run(t: pa.Table) -> pa.Table:
        out = answer(t.column("numbers").to_pylist(), t.column("extra").to_pylist())
        return pa.table({"block": t.column("block"), "range": t.column("range"), "answer": pa.array(out, pa.binary())})

    return requests.select("range", "block", "numbers", "extra").groupBy("range").applyInArrow(run, "block long, range int, answer binary")


def with_answers(payloads: DataFrame, answers: DataFrame, fn: Callable[[int, bytes, dict[int, bytes]], pa.Table | None], schema: str, empty: pa.Schema) -> DataFrame:
    """Each block's payload with the answers that it got, by range."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return empty.empty_table()
        got = dict(zip(right.column("range").to_pylist(), right.column("answer").to_pylist(), strict=True))
        out = [fn(b, p, got) for b, p in zip(left.column("block").to_pylist(), left.column("payload").to_pylist(), strict=True)]
        out = [t for t in out if t is not None]
        return pa.concat_tables(out) if out else empty.empty_table()

    small = answers.select(F.col("block"), F.col("range"), F.col("answer"))
    return payloads.select("block", "payload").groupBy("block").cogroup(small.groupBy("block")).applyInArrow(run, schema)
