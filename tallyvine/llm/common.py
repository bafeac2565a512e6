"""What the operators of this subpackage share: tables, shared storage, joins of a checked size, texts in Arrow."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import cut, mark, release, set_batches, small_batches, written  # noqa: F401

#: Ids that a broadcast may hold (eight bytes each); above it the same join runs as a shuffle.
MAX_BROADCAST_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_ids(df: DataFrame, ids: DataFrame, key: str, keep: bool, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Rows of df whose key is (keep) or is not (not keep) in ids; ids are broadcast only if at most max_rows."""
    how = "left_semi" if keep else "left_anti"
    few = ids.limit(max_rows + 1).count() <= max_rows
    return df.join(F.broadcast(ids) if few else ids.hint("merge"), key, how)


#: Matches that with_match() sends to all tasks (slim rows); beyond it only those of heavy keys go by broadcast.
MAX_MATCHES = 200_000
#: Rows of one key from which a join sends its match by broadcast: a table of n rows has at most n / HEAVY such keys.
HEAVY = 20_000


def with_match(rows: DataFrame, key: str, matches: DataFrame, how: str = "left") -> DataFrame:
    """rows joined (left or inner) with matches: key (unique), further columns, and `_n`, the rows that have the key.

    Keys of more than HEAVY rows are met by broadcast, so that no task gets all rows of one; the others are shuffled,
    unless all matches are few enough to be broadcast.
    """
    matches = cut(matches)
    plain = matches.drop("_n")
    if matches.limit(MAX_MATCHES + 1).count() <= MAX_MATCHES:
        return rows.join(F.broadcast(plain), key, how)
    heavy = F.broadcast(matches.where(F.col("_n") > HEAVY).drop("_n"))
    light = matches.where(F.col("_n") <= HEAVY).drop("_n")
    rest = rows.join(heavy.select(key), key, "left_anti")
    return rows.join(heavy, key).unionByName(rest.join(light.hint("merge"), key, how))


def first_by_hash(df: DataFrame, key: str, n: int, chosen: Column) -> DataFrame:
    """At most n of the chosen rows of df, those of the smallest hashes of their key.

    A share of hashes that holds somewhat more than that is kept before anything is ranked, so that what is sorted
    does not grow with df; each task sorts and sends n rows at most.
    """
    df = df.where(chosen)
    place = F.pmod(F.xxhash64(key), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return df.where(place <= (n + 6 * n**0.5 + 10) / max(1, df.count())).orderBy(place, key).limit(n)


def lean(rows: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow whose worker gives large arrays back to the system at once, and all the rest at the
    end of a task: workers live on between tasks, and what they keep adds up on an executor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with contextlib.suppress(OSError, AttributeError):  # no glibc
            ctypes.CDLL(None).mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD
        yield from rows(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)

    return run


def text_views(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, UTF-8 bytes, offsets of rows in them) of runs of rows that hold about `most` bytes each."""
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end
