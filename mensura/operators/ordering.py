"""Exact ordered operators that never put a whole group into one task.

A window partitioned by a unit puts all rows of that unit in one task, which
fails when one unit holds a third of the data.  Here the rows are range
partitioned once by the group keys and the full order, ties told apart by their
place in the input, so hot groups, dominating values, nulls, NaN and texts with
a common start are split like any others, in Spark's own sort order (nulls
first, NaN last).  The partition is the slice: window functions run inside
``(group, slice)``, and a short table with one row per slice carries totals
from slice to slice.

Range bounds are sampled, so the sliced rows are written out before use
(``session.cut_lineage``); whatever is run again later reads the same slices.
A null key is a group like any other.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from mensura.session import cut_lineage


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` with null equal to null; the key columns come from ``left``."""
    renamed = right.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    return left.join(renamed, same, how).drop(*[f"_k_{k}" for k in keys])


def attach(df: DataFrame, table: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join a table with at most one row per key onto ``df``.

    No broadcast is forced: adaptive execution broadcasts the table when its
    measured size allows, and otherwise splits a skewed key of the large side.
    Without keys the table is one aggregate row and becomes a scalar subquery.
    """
    if keys:
        return join_null_safe(df, table, keys, how)
    names = table.columns
    packed = table.select(F.struct(*names).alias("_one"))
    return df.withColumn("_one", packed.scalar()).select(
        *[F.col(c) for c in df.columns], *[F.col(f"_one.{n}").alias(n) for n in names]
    )


#: rows of a table that are sent to every task instead of moving the large side to them
SENT_ROWS = 1000


def attach_few(df: DataFrame, table: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``attach`` for groups that may be few, such as models or flags.

    A shuffle by such keys would bring all rows of a group into one task, and
    aggregates by the same keys would stay there.  The table is written out and
    counted; up to ``SENT_ROWS`` rows go to the tasks of the large side, whose
    rows stay where they are.
    """
    if not keys:
        return attach(df, table, keys, how)
    table = cut_lineage(table)
    return attach(df, F.broadcast(table) if table.limit(SENT_ROWS + 1).count() <= SENT_ROWS else table, keys, how)


#: rows of a unit that one task adds up one after the other
IN_ORDER_ROWS = 100_000


def in_order(df: DataFrame, unit: str, order: str, most: int = IN_ORDER_ROWS) -> DataFrame:
    """A unit's rows in one task, ascending by ``order``, so that sums by the unit and further keys add them one by one.

    A sum of doubles over a shuffle depends in its last digit on how the tasks
    cut the rows; where signs or places follow from it, that digit shows.
    ``order`` is a whole number, unique within a unit.  ``_part`` is 0, but units
    of more than ``most`` rows are cut into parts of ``most`` numbers each,
    which start at 1; it belongs to the keys of the sums, and ``ordered_mean``
    brings the parts together.
    """
    large = df.groupBy(unit).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > most)
    part = F.when(F.col("_rows").isNull(), F.lit(0).cast("bigint")).otherwise(F.floor(F.col(order) / most) + 1)
    parted = attach_few(df, large, [unit], "left").withColumn("_part", part).drop("_rows")
    return parted.repartition(unit, "_part").sortWithinPartitions(unit, "_part", order)


def ordered_mean(rows: DataFrame, keys: list[str], value: Column, name: str) -> DataFrame:
    """Mean by keys that hold the unit of ``in_order``: the sums of the parts are added in their order."""
    parts = rows.groupBy(*keys, "_part").agg(F.sum(value).alias("_sum"), F.count(value).alias("_n"))
    sums = F.array_sort(F.collect_list(F.struct("_part", "_sum", "_n")))
    total = F.aggregate(sums, F.lit(0.0), lambda s, x: s + F.coalesce(x["_sum"], F.lit(0.0)))
    count = F.aggregate(sums, F.lit(0).cast("bigint"), lambda s, x: s + x["_n"])
    return parts.groupBy(*keys).agg(F.when(count > 0, total / count).alias(name))


def with_group_stats(df: DataFrame, keys: list[str], **aggregates: Column) -> DataFrame:
    """Group aggregates on every row: partial aggregation, then ``attach``."""
    stats = df.groupBy(*keys).agg(*[e.alias(n) for n, e in aggregates.items()])
    return attach(df, stats, keys)


def add_slices(df: DataFrame, keys: list[str], order: list[str], rows_per_slice: int | None = None) -> DataFrame:
    """Add ``_slice``, ascending along ``keys`` and ``order``; written out.

    Without ``rows_per_slice`` the session's shuffle settings decide: adaptive
    execution joins neighbouring small ranges up to its advisory size.
    """
    place = [*[F.col(k) for k in keys], *[F.col(c) for c in order], F.col("_tie")]
    numbered = df.withColumn("_tie", F.monotonically_increasing_id())
    if rows_per_slice:
        # half as many rows again as sampled bounds may be off
        parts = max(1, -(-3 * df.count() // (2 * rows_per_slice)))
        ranged = numbered.repartitionByRange(parts, *place)
    else:
        ranged = numbered.repartitionByRange(*place)
    return cut_lineage(ranged.withColumn("_slice", F.spark_partition_id()).drop("_tie"))


_AGGREGATE = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}
_CARRY = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}
_MERGE = {
    "sum": lambda local, carried: local + F.coalesce(carried, F.lit(0)),
    "count": lambda local, carried: local + F.coalesce(carried, F.lit(0)),
    "min": F.least,
    "max": F.greatest,
}
# kinds that look from the end of the group backwards
_BACKWARD = {"next": "before", "suffix_min": "min"}


def running(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    outputs: dict[str, tuple[str, Column]],
    rows_per_slice: int | None = None,
    keep_sliced: bool = False,
    sliced: bool = False,
    group_sums: dict[str, Column] | None = None,
) -> DataFrame:
    """Running values of each group in ``order``, any number in one pass.

    ``outputs`` maps a column name to ``(kind, expression)``:

    * ``sum``, ``count``, ``min``, ``max``, ``last`` (latest non-null value) up to and including the row,
    * ``before``: latest non-null value strictly earlier,
    * ``next``: first non-null value strictly later,
    * ``suffix_min``: minimum from the row to the end.

    Ordering columns may have any sortable type.  With ``sliced`` the input
    already carries the ``_slice`` of the same order.  With ``keep_sliced`` the
    result keeps ``_slice`` and the number of rows of the group as ``_n``.
    ``group_sums`` adds sums over the whole group.
    """
    base = df if sliced else add_slices(df, keys, order, rows_per_slice)
    slice_keys = [*keys, "_slice"]
    group = keys or [F.lit(0)]
    place = F.struct(*order)
    local, totals, carried = [], [], []
    for name, (kind, e) in outputs.items():
        backward = kind in _BACKWARD
        kind = _BACKWARD.get(kind, kind)
        turn = (lambda c: F.col(c).desc()) if backward else (lambda c: F.col(c).asc())
        rows = Window.partitionBy(*slice_keys).orderBy(*[turn(c) for c in order])
        upto = rows.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        strictly = rows.rowsBetween(Window.unboundedPreceding, -1)
        slices = Window.partitionBy(*group).orderBy(turn("_slice")).rowsBetween(Window.unboundedPreceding, -1)
        total, back = f"_t_{name}", f"_b_{name}"
        if kind in ("last", "before"):
            frame = upto if kind == "last" else strictly
            local.append(F.last(e, ignorenulls=True).over(frame).alias(name))
            latest = F.min_by if backward else F.max_by
            totals.append(latest(e, F.when(e.isNotNull(), place)).alias(total))
            carried.append(F.last(F.col(total), ignorenulls=True).over(slices).alias(back))
        else:
            local.append(_AGGREGATE[kind](e).over(upto).alias(name))
            totals.append(_AGGREGATE[kind](e).alias(total))
            carried.append(_CARRY[kind](total).over(slices).alias(back))

    def merged(name: str, kind: str) -> Column:
        merge = _MERGE.get(_BACKWARD.get(kind, kind), F.coalesce)
        return merge(F.col(name), F.col(f"_b_{name}")).alias(name)

    base = base.drop("_n")
    within = base.select("*", *local)
    whole = {"_n": F.count(F.lit(1)), **{name: F.sum(e) for name, e in (group_sums or {}).items()}}
    sums = [F.sum(f"_w_{name}").over(Window.partitionBy(*group)).alias(name) for name in whole]
    parts = [e.alias(f"_w_{name}") for name, e in whole.items()]
    across = base.groupBy(*slice_keys).agg(*parts, *totals).select(*slice_keys, *sums, *carried)
    result = join_null_safe(within, across, slice_keys).select(
        *[c for c in within.columns if c not in outputs], *whole,
        *[merged(n, k) for n, (k, _) in outputs.items()],
    )
    return result if keep_sliced else result.drop("_slice", "_n")


def row_index(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    name: str = "idx",
    total: str | None = None,
    rows_per_slice: int | None = None,
) -> DataFrame:
    """1-based position of each row in its group, and the group size if asked."""
    out = running(df, keys, order, {name: ("count", F.lit(1))}, rows_per_slice, keep_sliced=True).drop("_slice")
    return out.withColumnRenamed("_n", total) if total else out.drop("_n")


def rank_table(
    df: DataFrame, keys: list[str], value: str, weight: Column | None = None, rows_per_slice: int | None = None,
    keep_sliced: bool = False,
) -> DataFrame:
    """One row per distinct value: its multiplicity and average rank (ties share).

    Columns: keys, value, ``ties``, ``upto`` (rows at or below), ``total``, ``rank``.
    Equal values are counted before the shuffle, so slices hold distinct values.
    """
    counts = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, value)
        .agg((F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("ties"))
    )
    ranked = running(
        counts, keys, [value], {"upto": ("sum", F.col("ties"))}, rows_per_slice, keep_sliced=True, group_sums={"total": F.col("ties")}
    ).withColumn("rank", F.col("upto") - (F.col("ties") - 1) / 2.0)
    return ranked if keep_sliced else ranked.drop("_slice", "_n")


def average_rank(
    df: DataFrame, keys: list[str], value: str, name: str, rows_per_slice: int | None = None
) -> DataFrame:
    """Average-tie rank of ``value`` within the group, null for null values."""
    table = rank_table(df, keys, value, rows_per_slice=rows_per_slice)
    return join_null_safe(df, table.select(*keys, value, F.col("rank").alias(name)), [*keys, value], "left")


def quantile_table(
    df: DataFrame,
    keys: list[str],
    value: str,
    quantiles: dict[str, float],
    weight: Column | None = None,
    rows_per_slice: int | None = None,
) -> DataFrame:
    """Exact linearly interpolated quantiles per group, found by rank selection.

    Equal values are counted before the shuffle and no group is gathered; the
    built-in ``percentile`` would hold all distinct values of a group in one task.
    """
    table = rank_table(df, keys, value, weight, rows_per_slice)
    below, upto, total = F.col("upto") - F.col("ties"), F.col("upto"), F.col("total")
    picks = []
    for name, q in quantiles.items():
        place = F.lit(float(q)) * (total - 1)
        low, high = F.floor(place), F.ceil(place)
        picks += [
            F.max(F.when((below <= low) & (low < upto), F.col(value))).alias(f"_lo_{name}"),
            F.max(F.when((below <= high) & (high < upto), F.col(value))).alias(f"_hi_{name}"),
            F.max(place - low).alias(f"_fr_{name}"),
        ]
    chosen = table.groupBy(*keys).agg(*picks)
    return chosen.select(
        *keys,
        *[
            (F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_fr_{n}")).alias(n)
            for n in quantiles
        ],
    )


def median_table(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    return quantile_table(df, keys, value, {name: 0.5})


def mad_table(df: DataFrame, keys: list[str], value: str, center: str = "center", mad: str = "mad") -> DataFrame:
    """Median and median absolute deviation per group."""
    # one row per group; written out so the deviations do not repeat the ranking
    centers = cut_lineage(median_table(df, keys, value, center))
    spread = attach(df.select(*keys, value), centers, keys).withColumn("_dev", F.abs(F.col(value) - F.col(center)))
    # the centre is constant within a group, so it can ride along as a key
    return median_table(spread, [*keys, center], "_dev", mad)
