"""Wide and long forms.  Pivot values are always given, so no extra scan finds them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def pivot_one(df: DataFrame, keys: list[str], column: str, levels: list[str], value: str) -> DataFrame:
    return df.groupBy(*keys).pivot(column, levels).agg(F.first(value, ignorenulls=True))


def pivot_many(df: DataFrame, keys: list[str], column: str, levels: list[str], values: list[str]) -> DataFrame:
    """Columns named ``<level>_<value>``."""
    return df.groupBy(*keys).pivot(column, levels).agg(*[F.first(v, ignorenulls=True).alias(v) for v in values])


def condition_differences(
    df: DataFrame, keys: list[str], condition: str, conditions: tuple[str, str], metric: str
) -> DataFrame:
    """First minus second condition per key, kept long; keys lacking a side drop out."""
    side = lambda c: F.first(F.when(F.col(condition) == c, F.col(metric)), ignorenulls=True)
    wide = df.groupBy(*keys).agg(side(conditions[0]).alias("_a"), side(conditions[1]).alias("_b"))
    return wide.select(*keys, (F.col("_a") - F.col("_b")).alias("difference")).filter("difference is not null")


def unstack_means(
    df: DataFrame, keys: list[str], columns: list[str], levels: list[str], metric: str, separator: str = "_"
) -> DataFrame:
    """Grouped means with one column per combination of ``columns``."""
    means = df.groupBy(*keys, *columns).agg(F.avg(metric).alias("_mean"))
    return (
        means.withColumn("_cell", F.concat_ws(separator, *columns))
        .groupBy(*keys).pivot("_cell", levels).agg(F.first("_mean"))
    )


def long_metrics(df: DataFrame, ids: list[str], metrics: list[str]) -> DataFrame:
    return df.unpivot(ids, metrics, "metric", "value")


def explode_list(df: DataFrame, column: str, item: str, separator: str = ";") -> DataFrame:
    return df.withColumn(item, F.explode(F.split(column, separator)))


def collapse_list(df: DataFrame, keys: list[str], item: str, name: str, separator: str = ";") -> DataFrame:
    """Distinct items of a bounded label set, sorted and joined."""
    return df.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set(item)), separator).alias(name))


def union_filled(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out
