"""What the operators share: reading a table, scratch tables, bytes of a batch of texts."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut

__all__ = ["cut", "table", "texts", "as_bytes", "pieces", "held", "give_back", "let_go"]

_HELD: dict[tuple, object] = {}


def held(key: tuple, make: Callable[[], object]):
    """What a worker keeps from task to task: one thing at a time, the one last asked for, so that
    the tables of operators that follow one another do not add up."""
    if key not in _HELD:
        let_go()
        _HELD[key] = make()
    return _HELD[key]


def give_back() -> None:
    """Give back freed memory that a worker's allocators keep.  For the end of a task: a worker that
    waits for its next one counts too."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        # Other C libraries have no such call; their memory stays where it is.
        pass


def let_go() -> None:
    """Give back what a worker holds as well.  For the start of a task that needs no held thing."""
    _HELD.clear()
    give_back()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text (null: empty), so that no other column can clash with ours."""
    return docs.select(F.col(id_col).alias("doc_id"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def as_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column without nulls, one after the other, and n + 1 offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    _, at, data = column.buffers()
    at = np.frombuffer(at, dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[at[0]:at[-1]], at - at[0]


def pieces(batches: Iterator[pa.RecordBatch], column: str,
           size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``size`` bytes of text, so that memory stays bounded."""
    for batch in batches:
        if not batch.num_rows:
            continue
        texts_ = batch.column(column).cast(pa.large_string())
        at = np.frombuffer(texts_.buffers()[1], dtype=np.int64)
        at = at[texts_.offset:texts_.offset + len(texts_) + 1]
        part = (at[1:] - at[0]) // size
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for start, end in zip(cuts, cuts[1:]):
            yield batch.slice(start, end - start)
