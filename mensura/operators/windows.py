"""Within-group scaling, splits, multiplicity correction and event sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from mensura.functions.scalar import normalise_trigger
from mensura.operators.ordering import attach, join_null_safe, mad_table, rank_table, row_index, running, with_group_stats
from mensura.session import cut_lineage


def zscore(df: DataFrame, keys: list[str], columns: dict[str, str], population: bool = False) -> DataFrame:
    """Centre and scale within groups; zero spread gives null.  ``columns``: input -> output."""
    spread = F.stddev_pop if population else F.stddev_samp
    stats = {}
    for c in columns:
        stats[f"_m_{c}"] = F.avg(c)
        stats[f"_s_{c}"] = spread(c)
    out = with_group_stats(df, keys, **stats)
    for c, name in columns.items():
        out = out.withColumn(name, F.when(F.col(f"_s_{c}") != 0, (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}")))
    return out.drop(*stats)


def centre(df: DataFrame, keys: list[str], column: str, name: str) -> DataFrame:
    return with_group_stats(df, keys, _m=F.avg(column)).withColumn(name, F.col(column) - F.col("_m")).drop("_m")


def robust_z(df: DataFrame, keys: list[str], columns: dict[str, str]) -> DataFrame:
    """0.67448975 * (x - median) / MAD; 0 when the MAD is 0.  ``columns``: input -> output.

    All columns are ranked together in long form, in one set of shuffles.
    """
    long = df.select(*keys, *columns).unpivot(keys, list(columns), "_metric", "_x") if len(columns) > 1 else df.select(
        *keys, F.lit(next(iter(columns))).alias("_metric"), F.col(next(iter(columns))).alias("_x"))
    spread = mad_table(long.filter("_x is not null"), [*keys, "_metric"], "_x", "_c", "_mad")
    pick = lambda c, v: F.max(F.when(F.col("_metric") == c, F.col(v)))
    wide = spread.groupBy(*keys).agg(*[pick(c, v).alias(f"{v}_{c}") for c in columns for v in ("_c", "_mad")])
    out = attach(df, wide, keys)
    for c, name in columns.items():
        z = F.lit(0.67448975) * (F.col(c) - F.col(f"_c_{c}")) / F.col(f"_mad_{c}")
        out = out.withColumn(name, F.when(F.col(f"_mad_{c}") == 0, F.lit(0.0)).otherwise(z))
    return out.drop(*[f"{v}_{c}" for c in columns for v in ("_c", "_mad")])


def benjamini_hochberg(
    df: DataFrame, family: list[str], p: str, name: str, rows_per_slice: int | None = None
) -> DataFrame:
    """False-discovery adjusted p within families; null p stays null and is not counted."""
    candidate = F.col(p) * F.col("total") / F.col("upto")
    return _step_adjust(df, family, p, name, "suffix_min", candidate, rows_per_slice)


def holm(df: DataFrame, family: list[str], p: str, name: str, rows_per_slice: int | None = None) -> DataFrame:
    """Step-down family-wise adjusted p within families."""
    candidate = F.col(p) * (F.col("total") - F.col("upto") + F.col("ties"))
    return _step_adjust(df, family, p, name, "max", candidate, rows_per_slice)


def _step_adjust(
    df: DataFrame, family: list[str], p: str, name: str, kind: str, candidate: Column, rows_per_slice: int | None
) -> DataFrame:
    """Monotone pass over the ranked distinct p-values, in the slices of the ranking."""
    ranked = rank_table(df, family, p, rows_per_slice=rows_per_slice, keep_sliced=True)
    adjusted = running(ranked, family, [p], {"_q": (kind, candidate)}, sliced=True)
    table = adjusted.select(*family, p, F.least(F.lit(1.0), F.col("_q")).alias(name))
    return join_null_safe(df, table, [*family, p], "left")


def leave_one_out_mean(df: DataFrame, keys: list[str], column: str, name: str) -> DataFrame:
    out = with_group_stats(df, keys, _sum=F.sum(column), _cnt=F.count(column))
    loo = F.when(F.col("_cnt") > 1, (F.col("_sum") - F.col(column)) / (F.col("_cnt") - 1))
    return out.withColumn(name, loo).drop("_sum", "_cnt")


def leave_one_out_range(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Smallest and largest leave-one-out mean.

    The mean without x falls as x grows, so only the group's extremes matter and
    one aggregate is enough.
    """
    n, total = F.count(column), F.sum(column)
    return df.groupBy(*keys).agg(
        F.when(n > 1, (total - F.max(column)) / (n - 1)).alias("loo_min"),
        F.when(n > 1, (total - F.min(column)) / (n - 1)).alias("loo_max"),
    )


def odd_even_by_position(df: DataFrame, keys: list[str], order: list[str], name: str = "half") -> DataFrame:
    """``odd`` for the 1st, 3rd, ... row of the group."""
    out = row_index(df, keys, order, "_i")
    return out.withColumn(name, F.when(F.col("_i") % 2 == 1, "odd").otherwise("even")).drop("_i")


def odd_even_by_index(index: str) -> Column:
    return F.pmod(F.col(index), F.lit(2))


def time_halves(df: DataFrame, keys: list[str], order: list[str], name: str = "half") -> DataFrame:
    """First half holds n // 2 rows."""
    out = row_index(df, keys, order, "_i", total="_t")
    first = F.col("_i") <= F.floor(F.col("_t") / 2)
    return out.withColumn(name, F.when(first, "first").otherwise("second")).drop("_i", "_t")


def reconstruct_trials(
    events: DataFrame,
    unit: str,
    order: list[str],
    sample: str,
    code: str,
    sfreq: float,
    conditions: dict[int, str],
    responses: dict[int, dict[int, str]],
    congruent: list[int],
    rows_per_slice: int | None = None,
) -> DataFrame:
    """Condition-target-response triples, one row per target; nothing is dropped.

    The output columns and their order are fixed: they are the trial table's schema.

    The condition is the latest one since the previous target, the response is
    the event right after the target.  Both are running values over the ordered
    log, found in one pass, so a recording of any length is cut in slices.
    """
    targets = list(responses)
    log = events.withColumn("_code", normalise_trigger(F.col(code)))
    place = F.struct(*order)
    is_target, is_condition = F.col("_code").isin(targets), F.col("_code").isin(list(conditions))
    both = running(
        log, [unit], order,
        {
            "trial_index": ("count", F.when(is_target, F.lit(1))),
            "_previous_target": ("before", F.when(is_target, place)),
            "_condition": ("last", F.when(is_condition, F.struct(place.alias("place"), F.col(sample).alias("at"), F.col("_code").alias("code")))),
            "_next": ("next", F.struct(F.col(sample).alias("at"), F.col("_code").alias("code"))),
        },
        rows_per_slice=rows_per_slice,
    ).filter(is_target)
    fresh = F.col("_previous_target").isNull() | (F.col("_condition.place") > F.col("_previous_target"))
    table = F.create_map(*[
        item for t, m in responses.items() for r, label in m.items()
        for item in (F.lit(t * 256 + r), F.lit(label))
    ])
    label = table[F.col("_code") * 256 + F.col("_next.code")]
    expected = F.create_map(*[
        item for t, m in responses.items() for item in (F.lit(t), F.lit(next(r for r, v in m.items() if v == "correct")))
    ])
    names = F.create_map(*[item for c, v in conditions.items() for item in (F.lit(c), F.lit(v))])
    condition_code = F.when(fresh, F.col("_condition.code"))
    condition_at = F.when(fresh, F.col("_condition.at"))
    answered = label.isNotNull()
    latency = F.when(answered, (F.col("_next.at") - F.col(sample)) * 1000.0 / sfreq)
    rt = F.when(label.isin("correct", "incorrect"), latency)
    return both.select(
        unit,
        "trial_index",
        condition_code.alias("condition_code"),
        F.coalesce(names[condition_code], F.lit("missing")).alias("condition"),
        condition_at.alias("stimulation_sample"),
        F.col("_code").alias("target_code"),
        F.col(sample).alias("target_sample"),
        F.when(F.col("_code").isin(congruent), "congruent").otherwise("incongruent").alias("congruency"),
        F.when(answered, F.col("_next.code")).alias("response_code"),
        F.when(answered, F.col("_next.at")).alias("response_sample"),
        F.coalesce(label, F.lit("missing_or_unexpected")).alias("response_class"),
        expected[F.col("_code")].alias("expected_correct_code"),
        ((F.col(sample) - condition_at) * 1000.0 / sfreq).alias("stimulation_to_target_ms"),
        latency.alias("response_latency_ms"),
        rt.alias("rt_ms"),
        F.coalesce(rt.between(100, 2000), F.lit(False)).alias("rt_plausible"),
        (condition_code.isNotNull() & answered).alias("sequence_valid"),
    )


def collapse_overlaps(
    events: DataFrame, unit: str, sample: str, code: str, allowed: list[int], max_gap: int = 2,
    rows_per_slice: int | None = None,
) -> DataFrame:
    """Merge short transition states into the marker that follows them.

    An event links to its successor when the gap is at most ``max_gap`` and the
    successor's code is allowed.  Links are consumed pairwise from the start of
    each chain, so inside a chain the parity of the position decides: even
    positions start a pair, odd ones are consumed.
    """
    log = events.withColumn("_code", normalise_trigger(F.col(code)))
    ok = lambda c: F.coalesce(c.isin(allowed), F.lit(False))
    near = lambda gap: F.coalesce((gap > 0) & (gap <= max_gap), F.lit(False))
    linked = cut_lineage(running(
        log, [unit], [sample],
        {
            "_pos": ("count", F.lit(1)), "_prev_at": ("before", F.col(sample)),
            "_next": ("next", F.struct(F.col(sample).alias("at"), F.col("_code").alias("code"))),
        },
        rows_per_slice=rows_per_slice, keep_sliced=True,
    ))
    linked_back = near(F.col(sample) - F.col("_prev_at")) & ok(F.col("_code"))
    chained = running(linked, [unit], [sample], {"_start": ("last", F.when(~linked_back, F.col("_pos")))}, sliced=True)
    links_on = near(F.col("_next.at") - F.col(sample)) & ok(F.col("_next.code"))
    head = (F.col("_pos") - F.col("_start")) % 2 == 0
    return chained.filter(head & (links_on | ok(F.col("_code")))).select(
        unit, sample, F.when(links_on, F.col("_next.code")).otherwise(F.col("_code")).alias("code")
    )
