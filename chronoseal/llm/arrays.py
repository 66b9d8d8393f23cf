"""Arrow and numpy helpers that run inside tasks.

Texts arrive as Arrow batches. A batch is cut into slices of about ``SLICE_BYTES`` so that the wide
intermediate arrays of a slice stay small; a longer text is a slice of its own.
"""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, DataType, IntegerType, LongType, StringType, StructField, StructType

from ..session import checkpoint_dir

SLICE_BYTES = 1 << 20
_U = np.uint64
_ODD = _U(0x9E3779B97F4A7C15)
INT, LONG, STRING, IDS = IntegerType(), LongType(), StringType(), ArrayType(IntegerType())
_POWERS: dict[int, np.ndarray] = {}


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a string column; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, starts, data = column.buffers()
    offsets = np.frombuffer(starts, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes, at least one row each."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes (splitmix)."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def powers(n: int) -> np.ndarray:
    """Powers 0..n-1 of an odd number modulo 2**64."""
    have = _POWERS.get(0)
    if have is None or len(have) < n:
        size = 1 << max(10, int(n).bit_length())
        factors = np.full(size, _ODD, _U)
        factors[0] = 1
        have = _POWERS[0] = np.cumprod(factors)
    return have[:n]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions ``starts[i] .. starts[i] + lengths[i] - 1`` of all i, one after the other."""
    total = int(lengths.sum())
    first = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts - first, lengths)


def span_hashes(units: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64-bit hash of every span ``units[start : start + length]``; spans are not empty."""
    if len(starts) == 0:
        return np.zeros(0, _U)
    first = np.cumsum(lengths) - lengths
    picked = units[ragged(starts, lengths)].astype(_U) + _U(1)
    within = np.arange(len(picked), dtype=np.int64) - np.repeat(first, lengths)
    table = powers(int(lengths.max()))
    return mix(np.add.reduceat(picked * table[within], first) + lengths.astype(_U) * _U(0xD6E8FEB86659FD93))


def runs(mask: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of true; no run crosses a position in ``breaks``."""
    n = len(mask)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(n + 1, bool)
    edge[breaks] = True
    edge[0] = True
    start = mask & (edge[:n] | ~np.concatenate(([False], mask[:-1])))
    end = mask & (edge[1:] | ~np.concatenate((mask[1:], [False])))
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def give_back() -> None:
    """Return memory that the allocators hold to the system: Python workers live on and serve other tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def released(run: Callable) -> Callable:
    """A function over Arrow batches that gives its memory back when its task ends."""

    @wraps(run)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def list_array(values: pa.Array, lengths: np.ndarray) -> pa.Array:
    """List column of consecutive runs of ``values``."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def schema_with(df: DataFrame, **columns: DataType) -> StructType:
    """Schema of ``df`` followed by further columns."""
    return StructType([*df.schema.fields, *(StructField(name, kind) for name, kind in columns.items())])


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared folder of the cluster."""
    return f"{checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write a table (with the writer's ``options``) to the shared folder and read it again: short lineage, safe when executors are lost."""
    path = shared_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
