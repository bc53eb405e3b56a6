"""Helpers of the corpus operators: tables, written intermediates, Arrow columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from patchsieve.session import new_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: computed once, kept if executors are lost."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, also if `body` uses it in lambdas."""
    return F.transform(F.array(value), body)[0]


def strings(column: pa.Array) -> pa.Array:
    """Null texts as empty ones."""
    return column.fill_null("") if column.null_count else column


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and its n + 1 offsets, starting at 0."""
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0]:at[-1]], at - at[0]


def slices(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Runs of consecutive rows of at most `limit` together, or single rows beyond it."""
    begin, total = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if total and total + size > limit:
            yield begin, i
            begin, total = i, 0
        total += size
    if begin < len(sizes):
        yield begin, len(sizes)


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups with the first row of each, from batches sorted by `keys`.

    The rows of the last group of a batch wait for the next batch.
    """
    kept: list[pa.RecordBatch] = []

    def starts(rows: pa.Table) -> np.ndarray:
        new = np.zeros(rows.num_rows, bool)
        new[0] = True
        for k in keys:
            v = rows.column(k).to_numpy()
            new[1:] |= v[1:] != v[:-1]
        return np.flatnonzero(new)

    for batch in batches:
        if not batch.num_rows:
            continue
        kept.append(batch)
        rows = pa.Table.from_batches(kept)
        at = starts(rows)
        if len(at) > 1:
            yield rows.slice(0, at[-1]), at[:-1]
            kept = pa.Table.from_batches(rows.slice(at[-1]).to_batches()).combine_chunks().to_batches()
    if kept:
        rows = pa.Table.from_batches(kept)
        yield rows, starts(rows)
