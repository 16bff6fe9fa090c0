"""Helpers shared by the operators: shared folder, vectorised tokenising and hashing."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that separate words in most contracts: space and 0x09-0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of a text that are worked on at once by the vectorised code.
CHUNK_BYTES = 4 << 20
_MUL1, _MUL2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where that is unset, one of our own, in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        if context._jsc.sc().getCheckpointDir().isEmpty():
            if not re.fullmatch(r"local(\[.*\])?", context.master):
                raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="strandline-"))
        found = context._jsc.sc().getCheckpointDir().get()
    return found


@contextlib.contextmanager
def shuffles_released(spark: SparkSession):
    """Spark removes the shuffle files of plans that are made and run inside when they end: for those whose result is written."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a checkpoint in the shared folder; the shuffles behind it are not needed any more."""
    shared_dir(df.sparkSession)
    with shuffles_released(df.sparkSession):
        return df.select("*").checkpoint()


def parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def named(column: str) -> Column:
    """A column by its name, whatever characters that has."""
    return F.col("`" + column.replace("`", "``") + "`")


def packed(df: DataFrame) -> Column:
    """All columns of df as one struct `_row`, so that none clashes with an operator's own."""
    return F.struct(*(named(c).alias(f"_{i}") for i, c in enumerate(df.columns))).alias("_row")


def unpacked(columns: list[str]) -> list[Column]:
    """The columns that ``packed`` put into `_row`."""
    return [F.col(f"_row._{i}").alias(c) for i, c in enumerate(columns)]


def groups_for(texts: DataFrame, column: str, size: int, least: int) -> int:
    """A number of groups with about `size` bytes of text each: it follows from the data, one number of which comes to the driver."""
    total = texts.agg(F.sum(F.octet_length(named(column)))).first()[0]
    return max(least, -(-(total or 0) // size))


def trim() -> None:
    """Gives memory that a finished task held back to the system: workers live on, and share an executor's limit with its JVM."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def tidy(run: Callable) -> Callable:
    """For functions over batches."""

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            trim()

    return tidied


def tidy_group(run: Callable) -> Callable:
    """For functions over a group."""

    def tidied(rows):
        out = run(rows)
        trim()
        return out

    return tidied


def tidy_groups(run: Callable) -> Callable:
    """For functions over a group of each of two tables."""

    def tidied(left, right):
        out = run(left, right)
        trim()
        return out

    return tidied


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _MUL1
    x = (x ^ (x >> np.uint64(27))) * _MUL2
    return x ^ (x >> np.uint64(31))


def chunks(texts: pa.Array | pa.ChunkedArray, size: int = CHUNK_BYTES):
    """(first row, rows, bytes with 8 zero bytes after them, offsets) of slices with about `size` bytes; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
        if isinstance(texts, pa.ChunkedArray):
            texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.string())
    if not len(texts):
        return
    flat = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(flat.buffers()[1], np.int64, len(flat) + 1, flat.offset * 8)
    data = np.frombuffer(flat.buffers()[2], np.uint8) if flat.buffers()[2] is not None and flat.buffers()[2].size else np.zeros(0, np.uint8)
    at = 0
    while at < len(flat):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1)
        own = offsets[at : to + 1] - offsets[at]
        yield at, to - at, np.concatenate([data[offsets[at] : offsets[to]], np.zeros(8, np.uint8)]), own
        at = to


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def spans(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each maximal run of bytes that are no separators; none crosses a row's bounds."""
    n = int(offsets[-1])
    if n == 0:
        return (np.zeros(0, np.int64),) * 3
    inside = ~separator[data[:n]]
    bound = np.zeros(n + 1, bool)
    bound[offsets] = True
    start, end = inside & bound[:n], inside & bound[1:]
    start[1:] |= inside[1:] & ~inside[:-1]
    end[:-1] |= inside[:-1] & ~inside[1:]
    start = np.flatnonzero(start)
    return start, np.flatnonzero(end) + 1, np.searchsorted(offsets, start, side="right") - 1


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of the bytes of each span; `data` has 8 bytes more than the spans use."""
    out = mix((end - start).astype(np.uint64) * _GOLD + np.uint64(seed))
    if not len(start):
        return out
    words = np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))
    at, left, own = start, end - start, None
    while True:
        block = words[at] & _MASK[np.minimum(left, 8)]
        if own is None:
            out = mix((out ^ block) * _GOLD + _MUL2)
        else:
            out[own] = mix((out[own] ^ block) * _GOLD + _MUL2)
        more = np.flatnonzero(left > 8)
        if not len(more):
            return out
        own, at, left = (more if own is None else own[more]), at[more] + 8, left[more] - 8


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive values (one for each start), over row bounds too: callers mask those."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = words[:n].copy()
    for j in range(1, k):
        out = out * _GOLD + words[j : j + n]
    return mix(out + np.uint64((int(_MUL1) * k) & (1 << 64) - 1))
