"""Keyed joins with validation, interval joins and table comparison."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from mensura.operators.ordering import running


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def one_to_one(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join that fails while running if a key repeats on either side.

    The check rides along as a per-key aggregate that the join needs anyway:
    each side is grouped by its key, so no second scan is made.
    """
    def unique(df: DataFrame, side: str) -> DataFrame:
        others = [c for c in df.columns if c not in keys]
        packed = df.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("_copies"), *[F.first(c).alias(c) for c in others]
        )
        return packed.filter(
            F.assert_true(F.col("_copies") == 1, f"repeated key on the {side} side").isNull()
        ).drop("_copies")

    return unique(left, "left").join(unique(right, "right"), keys, how)


def outer_levels(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """Full outer join of per-level tables, each with unique keys."""
    return reduce(lambda a, b: one_to_one(a, b, keys, "full_outer"), parts)


def look_up(df: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """Left join to a unique-key table: a miss gives null."""
    return df.join(table, keys, "left")


def keep_members(df: DataFrame, members: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(members.select(*keys).distinct(), keys, "left_semi")


def select_by_key(available: DataFrame, wanted: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows selected by identity, plus the repeated and the missing keys."""
    repeated = duplicate_keys(available, keys)
    missing = wanted.select(*keys).join(available.select(*keys), keys, "left_anti")
    return available.join(wanted.select(*keys), keys, "inner"), repeated, missing


def windows_join(
    samples: DataFrame,
    windows: DataFrame,
    keys: list[str],
    sample: str,
    low: str,
    high: str,
    width: int,
) -> DataFrame:
    """Samples inside ``[low, high)`` of each window of the same recording.

    Both sides carry a bucket of ``width`` samples, so the join is an equi-join
    on ``(recording, bucket)``: a long recording spreads over many tasks.  With
    ``width`` near the window length each window falls in two or three buckets.
    """
    spread = windows.withColumn(
        "_bucket",
        F.explode(F.sequence(
            F.floor(F.col(low) / F.lit(width)), F.floor((F.col(high) - 1) / F.lit(width))
        )),
    )
    placed = samples.withColumn("_bucket", F.floor(F.col(sample) / F.lit(width)))
    return (
        placed.join(spread, [*keys, "_bucket"])
        .filter((F.col(sample) >= F.col(low)) & (F.col(sample) < F.col(high)))
        .drop("_bucket")
    )


def epoch_bounds(trials: DataFrame, onset: str, before: int, after: int, n_samples: str | Column) -> DataFrame:
    total = F.col(n_samples) if isinstance(n_samples, str) else n_samples
    bounded = trials.withColumn("lo", F.col(onset) - before).withColumn("hi", F.col(onset) + after)
    return bounded.withColumn("within_bounds", (F.col("lo") >= 0) & (F.col("hi") <= total))


def latest_stimulus(
    events: DataFrame, keys: list[str], order: list[str], time: str, is_stimulus: Column, is_response: Column,
    rows_per_slice: int | None = None,
) -> DataFrame:
    """Each response with the time of the latest stimulus before it.

    A running value over the ordered log replaces an interval join, so no
    stimulus-response pairs are formed.
    """
    seen = running(
        events, keys, order, {"stimulus_time": ("before", F.when(is_stimulus, F.col(time)))},
        rows_per_slice=rows_per_slice,
    )
    return seen.filter(is_response)


def response_windows(assigned: DataFrame, time: str, windows: list[float], keys: list[str]) -> DataFrame:
    """Assigned and unassigned responses for each window length, in one pass."""
    delay = F.col(time) - F.col("stimulus_time")
    counted = assigned.withColumn("window_s", F.explode(F.array(*[F.lit(float(w)) for w in windows])))
    hit = F.coalesce(delay <= F.col("window_s"), F.lit(False))
    return counted.groupBy(*keys, "window_s").agg(
        F.count(F.lit(1)).alias("n_responses"),
        F.sum(hit.cast("bigint")).alias("n_assigned"),
        F.sum((~hit).cast("bigint")).alias("n_unassigned"),
        F.count_distinct(F.when(hit, F.struct(*keys, "stimulus_time"))).alias("n_stimuli_answered"),
    )


def compare_tables(
    archived: DataFrame, reproduced: DataFrame, keys: list[str], rtol: float = 1e-10, atol: float = 1e-12
) -> DataFrame:
    """Cells that differ beyond ``max(atol, rtol * max(|a|, |b|))``; null equals null.

    A key on one side only is one row with field ``(row)`` and ``present`` on
    its side.  Tables with different columns are refused.
    """
    if set(archived.columns) != set(reproduced.columns):
        raise ValueError(f"columns on one side only: {sorted(set(archived.columns) ^ set(reproduced.columns))}")
    values = [c for c in archived.columns if c not in keys]
    numeric = {c for c, t in archived.dtypes if t in ("double", "float", "int", "bigint", "smallint")}
    side = lambda df, name: df.select(*[F.col(k).alias(f"_{name}_{k}") for k in keys], F.struct(F.lit(True).alias("_there"), *values).alias(name))
    same_key = reduce(lambda x, y: x & y, [F.col(f"_a_{k}").eqNullSafe(F.col(f"_b_{k}")) for k in keys])
    both = side(archived, "a").join(side(reproduced, "b"), same_key, "full_outer")
    in_both = F.col("a").isNotNull() & F.col("b").isNotNull()
    where = lambda name: F.when(F.col(name).isNotNull(), "present")
    cells = [F.when(~in_both, F.struct(F.lit("(row)").alias("field"), where("a").alias("archived"), where("b").alias("reproduced")))]
    for c in values:
        a, b = F.col(f"a.{c}"), F.col(f"b.{c}")
        if c in numeric:
            a, b = a.cast("double"), b.cast("double")
            close = F.abs(a - b) <= F.greatest(F.lit(atol), F.lit(rtol) * F.greatest(F.abs(a), F.abs(b)))
        else:
            close = a == b
        same = F.when(a.isNull() & b.isNull(), F.lit(True)).otherwise(F.coalesce(close, F.lit(False)))
        cells.append(F.when(in_both & ~same, F.struct(F.lit(c).alias("field"), a.cast("string").alias("archived"), b.cast("string").alias("reproduced"))))
    named = [F.when(F.col("a").isNotNull(), F.col(f"_a_{k}")).otherwise(F.col(f"_b_{k}")).alias(k) for k in keys]
    return both.select(*named, F.explode(F.array_compact(F.array(*cells))).alias("cell")).select(*keys, "cell.*")
