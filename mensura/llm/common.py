"""Helpers shared by the corpus operators."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from mensura.session import ensure_checkpoint_dir


def raw_texts(column: pa.Array) -> tuple[bytes, np.ndarray]:
    """UTF-8 bytes of a text column and its ``len + 1`` offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    if not len(column):
        return b"", np.zeros(1, dtype=np.int64)
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    lo, hi = int(offsets[0]), int(offsets[-1])
    return (data.slice(lo, hi - lo).to_pybytes() if hi > lo else b""), offsets - lo


def byte_batches(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes each; a longer row stands alone."""
    start, rows = 0, len(offsets) - 1
    while start < rows:
        end = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        end = min(rows, max(end, start + 1))
        yield start, end
        start = end


def fold(column: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null ids fold as the empty text."""
    return F.pmod(F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")), F.lit(parts))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder, for tables between jobs."""
    ensure_checkpoint_dir(spark)
    base = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    unique = spark.sparkContext._jvm.java.util.UUID.randomUUID().toString()
    return f"{base}/{re.sub(r'[^A-Za-z0-9_]', '_', name)}-{unique}"


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends here."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sample_per(df: DataFrame, key: str, order: Column, n: int) -> DataFrame:
    """At most ``n`` rows of each ``key``, the first in ``order``; map tasks keep ``n`` before the shuffle."""
    rank = fresh(df, "_rank")
    place = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return df.withColumn(rank, place).filter(F.col(rank) <= n).drop(rank)
