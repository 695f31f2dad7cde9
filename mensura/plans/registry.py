"""Query registration: a Spark plan and, where SQL can say it, a DuckDB twin.

``columns`` fixes the output: ``name`` as is, ``name:i`` as BIGINT, ``name:6``
as a double rounded to six places.  Both sides get the same treatment.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _parse(columns: str) -> list[tuple[str, str]]:
    return [tuple((c + ":").split(":")[:2]) for c in columns.split()]


def shape(df: DataFrame, columns: str) -> DataFrame:
    out = []
    for name, kind in _parse(columns):
        c = F.col(name)
        if kind == "i":
            c = c.cast("bigint")
        elif kind:
            c = F.round(c.cast("double"), int(kind)) + F.lit(0.0)
        out.append(c.alias(name))
    return df.select(*out)


def shape_sql(sql: str, columns: str) -> str:
    out = []
    for name, kind in _parse(columns):
        if kind == "i":
            out.append(f"cast({name} as bigint) as {name}")
        elif kind:
            out.append(f"round(cast({name} as double), {kind}) + 0.0 as {name}")
        else:
            out.append(name)
    return f"select {', '.join(out)} from ({sql}) _q"


def query(name: str, columns: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: shape(fn(spark, sf_dir), columns)
        if sql is not None:
            ORACLES[name] = shape_sql(sql, columns)
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
