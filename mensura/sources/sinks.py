"""Result tables and run records."""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from mensura.sources.storage import new_file


def write_table(df: DataFrame, path: str, columns: list[str], fmt: str = "parquet") -> None:
    """Write fixed columns in a fixed order; an existing folder is refused."""
    writer = df.select(*columns).write.mode("error")
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.format(fmt).save(path)


def write_unit_tables(df: DataFrame, unit: str, path: str, folder: str = "folder") -> int:
    """A folder ``folder=<unit>`` with one CSV file for each unit; returns their number.

    A unit's rows meet in one task, which writes its file line by line.  Spark's
    own partitioned sink takes many times as long for many small files.
    """
    head = (",".join(df.columns) + "\n").encode()
    name = F.coalesce(F.col(unit).cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__"))
    lines = df.select(name.alias("name"), F.to_csv(F.struct(*df.columns)).alias("line"))
    # a fixed number of tasks: adaptive execution would join small ones
    placed = lines.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "name").sortWithinPartitions("name")

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.Array]]:
        for batch in batches:
            same, start = pc.run_end_encode(batch.column("name")), 0
            for end, unit_name in zip(same.run_ends.to_pylist(), same.values.to_pylist()):
                yield unit_name, batch.column("line").slice(start, end - start)
                start = end

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for unit_name, pieces in groupby(runs(batches), itemgetter(0)):
            with new_file(f"{path}/{folder}={unit_name}/part.csv") as out:
                out.write(head)
                for _, piece in pieces:
                    out.write(("\n".join(piece.to_pylist()) + "\n").encode())
            n += 1
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    return placed.mapInArrow(write, "n bigint").agg(F.sum("n")).first()[0] or 0


def empty_table(spark: SparkSession, schema: T.StructType | str) -> DataFrame:
    """No rows, but the declared columns."""
    return spark.createDataFrame([], schema)


def write_manifest(spark: SparkSession, path: str, parameters: dict, inputs: DataFrame, **counts: int) -> None:
    """One JSON record: parameters, row counts and the identities of the inputs."""
    record = inputs.agg(F.sort_array(F.collect_list(F.struct("path", "sha256"))).alias("inputs")).select(
        F.lit(json.dumps(parameters, sort_keys=True)).alias("parameters"),
        *[F.lit(v).alias(k) for k, v in counts.items()], "inputs",
    )
    record.write.mode("error").json(path)
