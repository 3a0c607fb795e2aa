"""Arrow batches as flat byte arrays, in chunks of bounded size."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK_BYTES = 1 << 20


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column on end, and the offsets of its values; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    a = column.cast(pa.large_string()).fill_null("")
    if not len(a):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = a.buffers()
    offsets = np.frombuffer(off, np.int64, len(a) + 1, a.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES, rows: int = 4096) -> Iterator[tuple[int, int]]:
    """Ranges of values of at most `most` bytes and `rows` values; a longer value has a range of its own."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1
        b = min(max(b, a + 1), n, a + rows)
        yield a, b
        a = b


def small(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, where the work on a batch needs several times its memory."""
    for b in batches:
        for a in range(0, len(b), rows):
            yield b.slice(a, rows)


def texts(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only key and text, whatever other columns there are."""
    return df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


_kept: dict[str, Callable[[], None]] = {}


def keep(owner: str, clear: Callable[[], None]) -> None:
    """Says how to drop what an operator keeps in a worker process from task to task."""
    _kept[owner] = clear


def trim() -> None:
    """Gives memory that is free in this process back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass  # not glibc


def enter(owner: str) -> None:
    """Drops what other operators keep in this process. (A function of the module, as closures travel with copies of its
    variables.)"""
    others = [name for name in _kept if name != owner]
    for name in others:
        _kept.pop(name)()
    if others:
        gc.collect()
    trim()


def tidied(owner: str, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """The same map over batches. Worker processes serve one operator after another: what others keep goes before it
    begins, and what it has freed goes back to the system when it ends."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter(owner)
        yield from run(batches)
        trim()

    return wrapped


def partitions(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
