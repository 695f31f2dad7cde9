"""Grouped summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from mensura.functions.scalar import safe_ratio
from mensura.functions.special import normal_quantile, t_two_sided_p
from mensura.operators.ordering import attach, mad_table, median_table, ordered_mean, quantile_table, rank_table


def behaviour_summary(
    trials: DataFrame, keys: list[str], correct: str = "correct", rt: str = "rt_ms"
) -> DataFrame:
    """Accuracy over all trials, median correct time, and their ratio.

    Omitted responses stay in the accuracy denominator.
    """
    accuracy = trials.groupBy(*keys).agg(F.avg(F.col(correct).cast("double")).alias("accuracy"))
    answered = trials.filter(F.col(correct) & F.col(rt).isNotNull())
    medians = median_table(answered, keys, rt, "median_correct_rt_ms")
    return accuracy.join(medians, keys, "left").withColumn(
        "inverse_efficiency_ms",
        F.when(F.col("accuracy") > 0, F.col("median_correct_rt_ms") / F.col("accuracy")),
    )


def weighted_mean(value: str, weight: str) -> Column:
    """Mean weighted by counts over rows with a value and a positive weight."""
    keep = F.col(value).isNotNull() & (F.col(weight) > 0)
    return F.sum(F.when(keep, F.col(value) * F.col(weight))) / F.sum(F.when(keep, F.col(weight)))


def corrected_dprime(hits, misses, false_alarms, correct_rejections) -> Column:
    """Difference of normal quantiles of the two rates, each kept off 0 and 1."""
    h, m, f, c = (F.col(x) if isinstance(x, str) else x for x in (hits, misses, false_alarms, correct_rejections))
    return normal_quantile((h + 0.5) / (h + m + 1)) - normal_quantile((f + 0.5) / (f + c + 1))


def rollup_runs(
    runs: DataFrame, keys: list[str], run: str, weight: str, sums: list[str], maxima: list[str], means: list[str]
) -> DataFrame:
    """Runs to units: distinct runs, summed counts, maxima and weighted means in one pass."""
    return runs.groupBy(*keys).agg(
        F.count_distinct(run).alias("n_runs"),
        F.sum(weight).alias(weight),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums],
        *[F.max(c).alias(f"max_{c}") for c in maxima],
        *[weighted_mean(c, weight).alias(c) for c in means],
    )


def trial_summary(trials: DataFrame, keys: list[str], rt: str, plausible: str, valid: str) -> DataFrame:
    """Counts, median time and flag fractions per cell; null keys form their own cells."""
    base = trials.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_trials"),
        F.avg(F.col(plausible).cast("double")).alias("plausible_fraction"),
        F.avg(F.col(valid).cast("double")).alias("valid_fraction"),
    )
    medians = median_table(trials.filter(F.col(rt).isNotNull()), keys, rt, "median_rt")
    return attach(base, medians, keys, "left").select(*keys, "n_trials", "median_rt", "plausible_fraction", "valid_fraction")


def code_counts(events: DataFrame, code: str, allowed: list) -> DataFrame:
    return (
        events.groupBy(code).agg(F.count(F.lit(1)).alias("n"))
        .withColumn("allowed", F.coalesce(F.col(code).isin(allowed), F.lit(False)))
    )


def worst_cell(df: DataFrame, unit: list[str], cell: str, flag: str) -> DataFrame:
    rates = df.groupBy(*unit, cell).agg(F.avg(F.col(flag).cast("double")).alias("rate"))
    return rates.groupBy(*unit).agg(F.min("rate").alias("minimum_rate"), F.count(F.lit(1)).alias("n_cells"))


def collapse_repeats(predictions: DataFrame, keys: list[str]) -> DataFrame:
    """Mean prediction over repeats; the observed value is constant within a key."""
    return predictions.groupBy(*keys).agg(
        F.min("observed").alias("observed"), F.avg("predicted").alias("predicted"), F.count(F.lit(1)).alias("n_repeats")
    )


def moments(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count(value).alias("n"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("sd"),
        (F.stddev_samp(value) / F.sqrt(F.count(value))).alias("sem"),
    )


def distribution(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Median, interquartile range, fraction below zero and range."""
    quartiles = quantile_table(df, keys, value, {"median": 0.5, "q25": 0.25, "q75": 0.75})
    rest = df.groupBy(*keys).agg(
        F.avg((F.col(value) < 0).cast("double")).alias("fraction_below_zero"),
        F.min(value).alias("minimum"), F.max(value).alias("maximum"),
    )
    joined = attach(rest, quartiles, keys)
    return joined.withColumn("iqr", F.col("q75") - F.col("q25"))


def corrected_skewness(value: str) -> Column:
    """Bias-corrected skewness; 0 for a constant column."""
    n = F.count(value)
    return F.when(F.min(value) == F.max(value), F.lit(0.0)).otherwise(
        F.skewness(value) * F.sqrt(n * (n - 1.0)) / (n - 2.0)
    )


def robust_upper(df: DataFrame, keys: list[str], value: str, multiplier: float = 6.0) -> DataFrame:
    """Median plus a multiple of the median absolute deviation, per group."""
    return mad_table(df, keys, value).withColumn("upper", F.col("center") + multiplier * F.col("mad"))


def signal_summary(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Share of present samples, root mean square, SD, median, MAD and 1%/99% quantiles."""
    base = df.groupBy(*keys).agg(
        F.avg(F.col(value).isNotNull().cast("double")).alias("finite_fraction"),
        F.sqrt(F.avg(F.col(value) * F.col(value))).alias("rms"),
        F.stddev_pop(value).alias("sd"),
    )
    present = df.filter(F.col(value).isNotNull())
    tails = quantile_table(present, keys, value, {"p01": 0.01, "p99": 0.99})
    centers = mad_table(present, keys, value, "median", "mad")
    return base.join(tails, keys, "left").join(centers, keys, "left")


def peak_to_peak(df: DataFrame, trial_keys: list[str], channel: str, value: str) -> DataFrame:
    """Range per channel, then the median over the channels of a trial.

    A trial has a fixed, small number of channels, so the built-in median is used.
    """
    per_channel = df.groupBy(*trial_keys, channel).agg((F.max(value) - F.min(value)).alias("ptp"))
    return per_channel.groupBy(*trial_keys).agg(F.median("ptp").alias("median_ptp"), F.max("ptp").alias("max_ptp"))


def pearson(df: DataFrame, keys: list[str], x: str, y: str, minimum: int = 3) -> DataFrame:
    """Correlation over complete pairs; null with too few pairs or no spread."""
    pairs = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    out = pairs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.corr(x, y).alias("_r"),
        F.min(x).alias("_x0"), F.max(x).alias("_x1"), F.min(y).alias("_y0"), F.max(y).alias("_y1"),
    )
    usable = (F.col("n") >= minimum) & (F.col("_x0") < F.col("_x1")) & (F.col("_y0") < F.col("_y1"))
    return out.select(*keys, "n", F.when(usable, F.col("_r")).alias("r"))


def spearman(df: DataFrame, keys: list[str], x: str, y: str, minimum: int = 3) -> DataFrame:
    """Pearson correlation of average ranks over complete pairs."""
    pairs = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, x, y)
    # both rank tables come from the same pairs, so neither ranking waits for the other
    ranked = pairs
    for column, name in ((x, "_rx"), (y, "_ry")):
        ranks = rank_table(pairs, keys, column).select(*keys, column, F.col("rank").alias(name))
        ranked = ranked.join(ranks, [*keys, column])
    return pearson(ranked, keys, "_rx", "_ry", minimum).withColumnRenamed("r", "rho")


def correlation_p(r: str, n: str = "n") -> Column:
    """Two-sided p of a correlation by the t approximation with n - 2 degrees of freedom."""
    rr = F.col(r)
    t = rr * F.sqrt((F.col(n) - 2) / (1.0 - rr * rr))
    return F.when(F.abs(rr) >= 1, F.lit(0.0)).when(F.col(n) > 2, t_two_sided_p(t, F.col(n) - 2))


def pair_sums(x: Column, y: Column, prefix: str = "") -> list[Column]:
    both = x.isNotNull() & y.isNotNull()
    return [
        F.sum(F.when(both, 1).otherwise(0)).alias(f"{prefix}n"),
        F.sum(F.when(both, x)).alias(f"{prefix}sx"), F.sum(F.when(both, y)).alias(f"{prefix}sy"),
        F.sum(F.when(both, x * x)).alias(f"{prefix}sxx"), F.sum(F.when(both, y * y)).alias(f"{prefix}syy"),
        F.sum(F.when(both, x * y)).alias(f"{prefix}sxy"),
    ]


def region_contrast(
    df: DataFrame, unit: str, condition: str, region: str, metric: str,
    conditions: tuple[str, str], regions: tuple[str, str],
) -> DataFrame:
    """Difference of differences: (first - second condition) in region one minus region two."""
    cell = lambda c, r: F.avg(F.when((F.col(condition) == c) & (F.col(region) == r), F.col(metric)))
    first = cell(conditions[0], regions[0]) - cell(conditions[1], regions[0])
    second = cell(conditions[0], regions[1]) - cell(conditions[1], regions[1])
    return df.groupBy(unit).agg(
        first.alias("contrast_first"), second.alias("contrast_second"), (first - second).alias("contrast")
    )


def held_out_loss(
    predictions: DataFrame, keys: list[str], binary_outcomes: list[str], outcome: str = "outcome", ordered: bool = False
) -> DataFrame:
    """Mean log loss for binary outcomes, mean absolute error otherwise; of ``ordered`` rows (``in_order``) added in their order."""
    eps = 2.220446049250313e-16
    p = F.greatest(F.lit(eps), F.least(F.lit(1.0 - eps), F.col("predicted")))
    y = F.col("observed")
    log_loss = -(y * F.log(p) + (1.0 - y) * F.log(1.0 - p))
    binary = F.coalesce(F.col(outcome).isin(binary_outcomes), F.lit(False))
    loss = F.when(binary, log_loss).otherwise(F.abs(y - F.col("predicted")))
    grouped = ordered_mean(predictions, keys, loss, "loss") if ordered else predictions.groupBy(*keys).agg(F.avg(loss).alias("loss"))
    return grouped.withColumn(
        "metric", F.when(F.col(outcome).isin(binary_outcomes), "log_loss").otherwise("absolute_error")
    )


def model_performance(predictions: DataFrame, keys: list[str]) -> DataFrame:
    error = F.col("observed") - F.col("predicted")
    base = predictions.groupBy(*keys).agg(
        F.avg(F.abs(error)).alias("mae"), F.sqrt(F.avg(error * error)).alias("rmse")
    )
    rho = spearman(predictions, keys, "observed", "predicted")
    return attach(base, rho.select(*keys, "rho"), keys)


def percent_of_baseline(summary: DataFrame, baseline: str, columns: list[str]) -> DataFrame:
    return summary.select("*", *[
        (100.0 * safe_ratio(F.col(c), F.col(baseline))).alias(f"{c}_percent") for c in columns
    ])


def neighbour_profile(correlations: DataFrame, edges: DataFrame) -> DataFrame:
    """Median, range and strongest neighbour per channel, and the median over all others.

    ``correlations`` holds (a, b, r) for every ordered pair of a fixed channel set;
    ``edges`` holds both directions (a, b).
    """
    local = correlations.join(edges.select("a", "b").distinct(), ["a", "b"])
    by_channel = local.groupBy("a").agg(
        F.count(F.lit(1)).alias("n_neighbours"),
        F.median("r").alias("median_neighbour_r"), F.min("r").alias("minimum_neighbour_r"),
        F.max("r").alias("maximum_neighbour_r"),
        F.max_by("b", F.when(F.col("r").isNotNull(), F.struct("r", "b"))).alias("strongest_neighbour"),
    )
    overall = correlations.groupBy("a").agg(F.median("r").alias("median_global_r"))
    return by_channel.join(overall, "a")


def degree_summary(edges: DataFrame, a: str, b: str) -> DataFrame:
    ends = edges.select(F.col(a).alias("node")).unionByName(edges.select(F.col(b).alias("node")))
    degrees = ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    return degrees.agg(
        F.count(F.lit(1)).alias("n_nodes"), (F.sum("degree") / 2).cast("bigint").alias("n_edges"),
        F.min("degree").alias("min_degree"), F.max("degree").alias("max_degree"),
    )


def cv_summary(scores: DataFrame, keys: list[str], item: list[str]) -> DataFrame:
    """Mean score per model, mean difference and number of wins of the extended model."""
    wide = scores.groupBy(*keys, *item).agg(
        F.max(F.when(F.col("model") == "base", F.col("score"))).alias("base"),
        F.max(F.when(F.col("model") == "extended", F.col("score"))).alias("extended"),
    ).withColumn("delta", F.col("extended") - F.col("base"))
    return wide.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg("base").alias("mean_base"), F.avg("extended").alias("mean_extended"),
        F.avg("delta").alias("mean_delta"), F.sum((F.col("delta") < 0).cast("bigint")).alias("n_improved"),
    )
