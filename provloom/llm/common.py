"""Helpers that the operators of this subpackage share: tables, shared scratch space, Arrow batches."""

from __future__ import annotations

import atexit
import logging
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from typing import Any

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A missing doc_id is read as this: after every real one.
NO_ID = 2**63 - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only a local session that has none (tests) gets one of its own."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        where = tempfile.mkdtemp(prefix="provloom-")
        spark.sparkContext.setCheckpointDir(where)
        where = spark.sparkContext.getCheckpointDir()
    return where.rstrip("/")


#: Spark deletes a query's shuffle files as soon as the query is over.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, rows_a_file: int | None = None) -> DataFrame:
    """Write a table to the shared folder and read it again: cuts lineage, survives lost executors, and frees the
    shuffle files that made it. Deleted by discard(), or when the application ends."""
    spark = df.sparkSession
    to = f"{shared_dir(spark)}/provloom-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if rows_a_file:
        writer = writer.option("maxRecordsPerFile", rows_a_file)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        writer.parquet(to)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(to)
    out.stored_at = to
    atexit.register(_delete, spark, to)
    for made in _open:
        made.append(to)
    return out


_open: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables stored inside are deleted at the end, but for those whose `stored_at` has been taken out by keep()."""
    made: list[str] = []
    _open.append(made)
    try:
        yield
    finally:
        _open.remove(made)
        for to in made:
            _delete(spark, to)


def keep(df: DataFrame) -> DataFrame:
    """A stored table that outlives the scratch() it was stored in."""
    for made in _open:
        if df.stored_at in made:
            made.remove(df.stored_at)
    return df


def discard(df: DataFrame) -> None:
    """Delete a stored table that no later step reads."""
    _delete(df.sparkSession, df.stored_at)


def _delete(spark: SparkSession, to: str) -> None:
    try:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(to)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session has ended; the folder is named for cleaning by hand
        return


#: Bytes of one Arrow batch. Spark's default of 64 MB, in the JVM and in Python at once, is far over a worker's share of memory.
ARROW_BYTES = 4_000_000


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow in batches of about ARROW_BYTES or one row (lowers the session's limit where it is larger: it is read when a plan runs)."""
    key, conf = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession.conf
    now = conf.get(key, None)
    if now is None or not now.rstrip("b").isdigit() or int(now.rstrip("b")) > ARROW_BYTES:
        conf.set(key, str(ARROW_BYTES))
    return df.mapInArrow(fn, schema)


def utf8(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8 bytes, null as empty. Operators that need characters read bytes that are no UTF-8 as U+FFFD."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def batch(**columns: tuple[Any, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v, t) for v, t in columns.values()], list(columns))


def by_bytes(items: Iterable[tuple], size: Callable[[tuple], int], most: int) -> Iterator[list[tuple]]:
    """Groups of consecutive items that together hold about `most` bytes; an item larger than that is alone."""
    group: list[tuple] = []
    held = 0
    for x in items:
        n = size(x)
        if group and held + n > most:
            yield group
            group, held = [], 0
        group.append(x)
        held += n
    if group:
        yield group


def id_and_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator reads, under fixed names (other columns never clash and are never scanned)."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def rows_of(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int | None, bytes]]:
    for b in batches:
        yield from zip(b.column("doc_id").to_pylist(), utf8(b.column("text")), strict=True)


#: Rows of row keys (two longs each) up to which a table of them is broadcast; longer ones are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: The columns of a row key: which file, and which row of it.
ROW = ("row_file", "row_at")


def numbered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text and the key (row_file, row_at) of every row: two rows never share it, whatever their columns hold.

    Rows of Parquet files are named by their file and place in it, which no retry changes. Other tables have no such
    place: they must be stored() first, as pipeline stages are.
    """
    meta = F.col("_metadata")
    where = [F.xxhash64(meta["file_path"]).alias(ROW[0]), meta["row_index"].alias(ROW[1])]
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *where)


def placed(docs: DataFrame) -> DataFrame:
    """docs if its rows have places that numbered() can name, else docs stored."""
    log = logging.getLogger("DataFrameQueryContextLogger")
    was, log.disabled = log.disabled, True  # that a table has no places is no error
    try:
        numbered(docs, docs.columns[0], docs.columns[0])
    except AnalysisException:
        return stored(docs)
    finally:
        log.disabled = was
    return docs


def without(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of placed docs whose key is not in rows (row_file, row_at)."""
    rows = stored(rows.select(*ROW))
    if rows.isEmpty():
        return docs
    names = [f"c{i}" for i in range(len(docs.columns))]  # so that no column of docs clashes with the key's
    meta = F.col("_metadata")
    keyed = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True)), F.xxhash64(meta["file_path"]).alias(ROW[0]), meta["row_index"].alias(ROW[1]))
    left = keyed.join(F.broadcast(rows) if rows.count() <= BROADCAST_IDS else rows, list(ROW), "left_anti")
    return left.select(*(F.col(n).alias(c) for c, n in zip(docs.columns, names, strict=True)))
