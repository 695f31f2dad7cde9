"""Filters and checks.  A check returns the offending rows as a DataFrame;
``require_empty`` turns any of them into an error on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from mensura.functions.scalar import one_of


def require_empty(violations: DataFrame, message: str) -> None:
    if not violations.isEmpty():
        raise ValueError(message)


def flagged(flag: str | Column) -> Column:
    """A nullable flag as a plain boolean, null meaning false."""
    column = F.col(flag) if isinstance(flag, str) else flag
    return F.coalesce(column, F.lit(False))


def usable_trials(df: DataFrame, flag: str, strict_flag: str | None = None) -> DataFrame:
    keep = flagged(flag)
    if strict_flag:
        keep = keep & flagged(strict_flag)
    return df.filter(keep)


def membership(column: str, values: list) -> Column:
    return F.coalesce(F.col(column).isin(values), F.lit(False)).cast("int")


def complete_cases(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.na.drop(subset=columns)


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN means missing; Spark would otherwise sort it above every number."""
    return df.select(*[
        F.when(~F.isnan(c), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes
    ])


def correct_with_rt(correct: str = "correct", rt: str = "rt") -> Column:
    return flagged(F.col(correct).cast("boolean")) & F.coalesce(F.col(rt) > 0, F.lit(False))


def two_level(column: str, members: list, inside: str, outside: str) -> Column:
    return F.when(F.col(column).isin(members), inside).otherwise(outside)


def suffix_columns(df: DataFrame, columns: list[str], suffix: str) -> DataFrame:
    return df.withColumnsRenamed({c: f"{c}_{suffix}" for c in columns})


def single_row(df: DataFrame, **filters) -> DataFrame:
    """The one row matching all filters; the query fails if there is not exactly one.

    Boolean filters also match the texts ``true`` and ``false`` in any case.
    """
    for name, value in filters.items():
        if isinstance(value, bool):
            df = df.filter(F.lower(F.col(name).cast("string")) == str(value).lower())
        else:
            df = df.filter(F.col(name) == F.lit(value))
    packed = df.agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct(*df.columns)).alias("_row"))
    message = f"expected one row for {filters}"
    return packed.filter(F.assert_true(F.col("_n") == 1, message).isNull()).select("_row.*")


def id_mismatch(observed: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """Ids on one side only."""
    left = observed.select(key).distinct().withColumn("in_observed", F.lit(True))
    right = expected.select(key).distinct().withColumn("in_expected", F.lit(True))
    both = left.join(right, key, "full_outer").na.fill(False, ["in_observed", "in_expected"])
    return both.filter(~(F.col("in_observed") & F.col("in_expected")))


def is_locked(unit, locked: list) -> None:
    if unit not in set(locked):
        raise ValueError(f"unit {unit} is not in the locked cohort")


def incomplete_pairs(df: DataFrame, unit: str, condition: str, expected: int = 2) -> DataFrame:
    counts = df.groupBy(unit).agg(F.count_distinct(condition).alias("n_conditions"))
    return counts.filter(F.col("n_conditions") != expected)


def low_support(df: DataFrame, keys: list[str], item: str, minimum: int = 3) -> DataFrame:
    counts = df.groupBy(*keys).agg(F.count_distinct(item).alias("n_items"))
    return counts.filter(F.col("n_items") < minimum)


def wrong_counts(df: DataFrame, keys: list[str], expected: int) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).filter(F.col("n_rows") != expected)


def family_report(df: DataFrame, keys: list[str]) -> DataFrame:
    """Row count, distinct key count and duplicated keys of a reported family."""
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("c"))
    return per_key.agg(
        F.coalesce(F.sum("c"), F.lit(0)).alias("n_rows"),
        F.count(F.lit(1)).alias("n_keys"),
        F.coalesce(F.sum((F.col("c") > 1).cast("bigint")), F.lit(0)).alias("n_duplicated"),
    )


def require_family(df: DataFrame, keys: list[str], expected: int) -> DataFrame:
    report = family_report(df, keys).first()
    if report["n_rows"] != expected or report["n_duplicated"]:
        raise ValueError(f"expected {expected} unique rows, found {report['n_rows']}")
    return df


def forbidden_labels(labels: list[str], tokens: list[str]) -> list[str]:
    """The tokens found in the field names, read as one lower-cased text."""
    text = "\n".join(labels).lower()
    return [t for t in sorted(set(tokens)) if text.find(t) >= 0]


def require_clean_schema(df: DataFrame, tokens: list[str], summary: dict | None = None) -> DataFrame:
    """Refuse a table or summary whose field names carry a prohibited word."""
    found = forbidden_labels([*df.columns, *(summary or {})], tokens)
    if found:
        raise ValueError(f"prohibited result fields: {found}")
    return df


def sequence_known(conditions: list[str], condition: str, *columns: str) -> Column:
    """Event structure is present: a known condition and no missing time mark."""
    keep = F.coalesce(F.col(condition).isin(conditions), F.lit(False))
    for c in columns:
        keep = keep & F.col(c).isNotNull()
    return keep


def plausible_range(column: str, low: float = 100.0, high: float = 2000.0) -> Column:
    return F.coalesce(F.col(column).between(low, high), F.lit(False))


def snr_reading(condition: str, target: str, reference_condition: str) -> Column:
    # Interpretation labels of the local signal-to-noise readout.
    return (
        F.when(F.col(target) < 3.0, "descriptive_only_low_frequency_1f_boundary")
        .when(F.col(condition) == reference_condition,
              "same_analysis_frequency_readout_not_stimulus_frequency_specificity")
        .otherwise("primary_frequency_specificity_check")
    )


def target_frequency(condition: str, individual: str, fixed: dict[str, float], factors: dict[str, float]) -> Column:
    """A fixed rate for some conditions, a multiple of the individual rate for others."""
    rate = one_of(condition, fixed)
    factor = one_of(condition, factors)
    return F.coalesce(rate, factor * F.col(individual))


def technical_usability(counts: list[str], metrics: list[str], minimum: int = 100) -> tuple[Column, Column]:
    ok = F.lit(True)
    for c in counts:
        ok = ok & F.coalesce(F.col(c) >= minimum, F.lit(False))
    for m in metrics:
        ok = ok & F.col(m).isNotNull()
    return ok, F.when(ok, F.lit("")).otherwise(F.lit("too_few_valid_trials_or_missing_metric"))


def edge_violations(edges: DataFrame, a: str, b: str, minimum_degree: int) -> DataFrame:
    """Self edges, repeated edges, non-canonical order and low-degree nodes."""
    pair = [F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")]
    self_edges = edges.filter(F.col(a) == F.col(b)).select(F.lit("self_edge").alias("rule"), *pair)
    order = edges.filter(F.col(a) > F.col(b)).select(F.lit("not_canonical").alias("rule"), *pair)
    repeated = (
        edges.groupBy(a, b).agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
        .select(F.lit("repeated").alias("rule"), *pair)
    )
    both = edges.select(F.col(a).alias("node"), F.col(b).alias("other")).unionByName(
        edges.select(F.col(b).alias("node"), F.col(a).alias("other"))
    )
    low = (
        both.groupBy("node").agg(F.count_distinct("other").alias("d"))
        .filter(F.col("d") < minimum_degree)
        .select(F.lit("low_degree").alias("rule"), F.col("node").cast("string").alias("a"), F.lit(None).cast("string").alias("b"))
    )
    return self_edges.unionByName(order).unionByName(repeated).unionByName(low)


def restricted_variants(df: DataFrame, variants: dict[str, Column]) -> DataFrame:
    """One copy of each row per named restriction it satisfies."""
    names = F.array_compact(F.array(*[
        F.when(F.coalesce(cond, F.lit(False)), F.lit(name)) for name, cond in variants.items()
    ]))
    return df.withColumn("variant", F.explode(names))
