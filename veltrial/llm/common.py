"""Helpers shared by the text operators: Arrow text columns as byte buffers,
word boundaries and word hashes, all vectorised with numpy."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Text handled by one numpy pass; larger single texts form a pass of their own.
PASS_BYTES = 1 << 20


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 (public domain constants)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


@dataclass
class TextBlock:
    """Rows lo..hi of a record batch; ``data`` holds their UTF-8 bytes back to
    back, row i at starts[i]..starts[i + 1]; with a separator, each row is
    followed by that one byte, which starts[i + 1] includes."""

    lo: int
    hi: int
    data: np.ndarray
    starts: np.ndarray


def text_blocks(column: pa.Array, limit: int = PASS_BYTES, separator: bytes = b"") -> Iterator[TextBlock]:
    """Cut a string column into blocks of about ``limit`` bytes (null: empty)."""
    values = pc.fill_null(column.cast(pa.large_string()), "").cast(pa.large_binary())
    if len(values) == 0:
        return
    if separator:
        values = pc.binary_join_element_wise(values, pa.scalar(separator, pa.large_binary()), pa.scalar(b"", pa.large_binary()))
    offsets = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
    raw = values.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(values):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield TextBlock(lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi


_RNG = np.random.default_rng(20240611)
_BYTE = _RNG.integers(0, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_MULT = U64(0x9E3779B97F4A7C15)
_POWERS = np.cumprod(np.full(4096, _MULT, np.uint64))


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if n >= len(_POWERS):
        _POWERS = np.cumprod(np.full(2 * n, _MULT, np.uint64))
    return _POWERS


def words(block: TextBlock, is_word: np.ndarray, fold: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of a block made with a separator: their begin and end offsets and
    64-bit hashes.  ``is_word`` and ``fold`` are tables over byte values; the
    separator must not be a word byte."""
    if not len(block.data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    inside = is_word[block.data]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edge = np.concatenate(([0], edge))
    begin, end = edge[0::2], edge[1::2]
    return begin, end, hash_ranges(fold[block.data], begin, end)


def hash_ranges(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[begin[i]:end[i]]; the ranges ascend, don't overlap and aren't empty."""
    if not len(begin):
        return np.zeros(0, np.uint64)
    length = end - begin
    total = int(length.sum())
    first = np.cumsum(length) - length
    place = np.arange(total) - np.repeat(first, length)
    value = _BYTE[data[place + np.repeat(begin, length)]] * _powers(int(length.max()))[place]
    return mix64(np.add.reduceat(value, first) + length.astype(np.uint64))


def rows_of(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The row that each ascending offset lies in."""
    return np.searchsorted(starts, points, "right") - 1


#: Most bytes of a packed number: 42 bits.
_GAP_BYTES = 6


def pack_gaps(gap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Base-128 bytes of non-negative numbers below 2^42, and where each number begins."""
    gap = gap.astype(np.int64)
    width = np.ones(len(gap), np.int64)
    for k in range(1, _GAP_BYTES):
        width += gap >= 1 << (7 * k)
    first = np.cumsum(width) - width
    out = np.zeros(int(width.sum()), np.uint8)
    most = int(width.max(initial=1))
    for k in range(most):
        if k and not (width > k).all():
            has = np.flatnonzero(width > k)
            out[first[has] + k] = ((gap[has] >> (7 * k)) & 127) | ((width[has] > k + 1) << 7)
        else:
            out[first + k] = ((gap >> (7 * k)) & 127) | ((width > k + 1) << 7)
    return out, first


def unpack_gaps(raw: np.ndarray) -> np.ndarray:
    last = np.flatnonzero(raw < 128)
    if not len(last):
        return np.zeros(0, np.int64)
    first = np.concatenate(([0], last[:-1] + 1))
    width = last - first + 1
    out = (raw[first] & 127).astype(np.int64)
    for k in range(1, int(width.max())):
        has = np.flatnonzero(width > k)
        out[has] |= (raw[first[has] + k] & 127).astype(np.int64) << (7 * k)
    return out


def pack_ascending(values: np.ndarray) -> bytes:
    """Ascending numbers below 2^42 as packed differences."""
    return pack_gaps(np.diff(values.astype(np.int64), prepend=0))[0].tobytes()


def unpack_ascending(data: bytes) -> np.ndarray:
    return np.cumsum(unpack_gaps(np.frombuffer(data, np.uint8)))


def binary_list(parts: list[np.ndarray]) -> pa.Array:
    """One binary value for each numpy array."""
    return pa.array([p.tobytes() for p in parts], pa.binary())


def released(run: Callable) -> Callable:
    """A task's function over batches that gives its freed memory back when it
    ends: Python workers are kept for later stages, and what their allocators
    hold counts against the executor."""

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def release() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def task_key() -> int:
    """Tells apart the blocks of different partitions within one run of a stage."""
    context = TaskContext.get()
    return (context.partitionId() if context else 0) << 32


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.  Only a local
    session may do without that setting, as in tests: its executors are the driver."""
    context = spark.sparkContext._jsc.sc()
    if context.getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            if not (spark.sparkContext.master or "").startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            import tempfile

            named = tempfile.mkdtemp(prefix="veltrial-checkpoint-")
        spark.sparkContext.setCheckpointDir(named)
    return context.getCheckpointDir().get()


def shared_checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def sampled(df: DataFrame, most: int, columns: tuple[str, ...] = ("doc_id", "text"), once: bool = True) -> DataFrame:
    """The rows of about ``most`` distinct ones at most, chosen by a hash of the
    columns, so that neither null nor shared ids decide; with ``once``, each distinct
    row once, so that a text that most rows have can't take the sample.  One pass
    counts the distinct rows."""
    key = F.xxhash64(*columns, F.lit(7))
    distinct = df.select(F.approx_count_distinct(key, 0.02)).first()[0]
    parts = max(1, -(-distinct // max(1, most)))
    rows = df.withColumn("_key", key).where(F.pmod("_key", F.lit(parts)) == 0)
    return (rows.dropDuplicates(["_key"]) if once else rows).drop("_key")


def unused(df: DataFrame, name: str) -> str:
    """A column name that the table doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
