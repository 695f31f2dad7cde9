"""Report-level compositions (C rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from mensura.functions.scalar import spearman_brown
from mensura.operators import models as m
from mensura.operators import resampling as r
from mensura.operators.aggregates import collapse_repeats, correlation_p, region_contrast, spearman
from mensura.operators.guards import require_family, single_row
from mensura.operators.reshape import union_filled
from mensura.operators.windows import benjamini_hochberg, holm
from mensura.plans.bindings import (
    BEH, BEHLONG, CD, CM, EV, FT, PR, TESTS, TR, channel_differences, channel_metrics, event_types, line_edges, tests_table,
)
from mensura.plans.q_aggregates import GATE, LOSS, behaviour, gate_record, losses
from mensura.plans.q_models import accuracy_predictions, binary_calibration, fold_predictions, prepared, rt_predictions, unit_means, _HC3
from mensura.plans.q_tests import (
    AUDIT, CLUSTER_TABLE, METRICS, _clusters_sql, _HV, _one_sample_sql, behaviour_differences, clusters, half_values, user_summary,
)
from mensura.plans.registry import query, table
from mensura.plans.sqltext import ctes, t_critical, t_p
from mensura.session import cut_lineage


def alignment(spark, d, replicates: int = 10_000):
    """Reliability next to validity, one row per evidence pair.

    A reliability is attached only to a coefficient of the same measure and
    level: trial-level models and measures without a reliability keep null.
    """
    users = cut_lineage(user_summary(spark, d).withColumn("x", F.round("itpc40", 9)))
    reliability = cut_lineage(
        r.split_half_table(half_values(spark, d), ["condition"], "odd", "even").withColumn("primary", F.col("condition") == "A"))
    neural = single_row(reliability, primary=True).select(F.col("spearman_brown").alias("neural_reliability")).withColumn("k", F.lit(1))
    parts = []
    for i, outcome in enumerate(("accuracy", "mean_rt")):
        frame = users.select("unit", F.lit(outcome).alias("outcome"), "x", F.round(outcome, 9).alias("y"))
        boot = r.bootstrap_spearman(frame, ["outcome"], "unit", "x", "y", 20260923 + i, replicates)
        parts.append(boot.select(
            F.concat(F.lit("unit_mean_on_"), "outcome").alias("evidence_pair"), F.lit("units").alias("level"),
            F.col("rho").alias("estimate"), "ci_low", "ci_high", correlation_p("rho").alias("p_value"), F.col("n").alias("n_units"),
            F.lit("same measure and level").alias("status"), F.lit(1).alias("k")).join(neural, "k").drop("k"))
    rows, products = m.add_products(prepared(spark, d).filter("correct = 1"), [("m40_z", "auditory")])
    fit = m.cluster_ols(rows, [], "unit", ["order_z", "m40_z", "m36_z", "auditory", *products], "log_rt")
    trial = m.linear_contrasts(fit, [], {"average": {"m40_z": 1.0, products[0]: 0.5}, "plain": {"m40_z": 1.0}})
    parts.append(trial.select(
        F.concat(F.lit("trial_on_log_rt_"), "contrast").alias("evidence_pair"), F.lit("trials").alias("level"), "estimate", "ci_low", "ci_high",
        "p_value", F.lit(None).cast("bigint").alias("n_units"), F.lit("same level, measure without a reliability").alias("status")))
    adjusted = m.ols_hc3(users, [], ["itpc40", "itpc36"], "accuracy")
    parts.append(m.coefficient_rows(adjusted, []).filter("term <> 'Intercept'").select(
        F.concat(F.lit("both_measures_on_accuracy_"), "term").alias("evidence_pair"), F.lit("units").alias("level"), "estimate", "ci_low", "ci_high", "p_value",
        F.col("n").alias("n_units"), F.lit("same level, reliability of another model").alias("status")))
    return union_filled(parts)


@query("c1_reliability_validity_alignment", "evidence_pair level neural_reliability:6 estimate:6 ci_low:6 ci_high:6 p_value:6 n_units:i status")
def _(spark, d):
    return alignment(spark, d)


@query("c2_effect_families", "metric n:i mean:6 ci95_low:5 ci95_high:5 dz:6 direction_fraction:6 p_t:6 p_holm:6 equivalent",
       _one_sample_sql(f""", pv as (select *, {t_p('t', '(n - 1)')} as p_t from one),
       h as (select *, row_number() over (order by p_t) as i, count(*) over () as k from pv)
       select metric, n, mean, mean - t975 * sem as ci95_low, mean + t975 * sem as ci95_high, dz, direction_fraction, p_t,
         least(1.0, max(p_t * (k - i + 1)) over (order by i rows unbounded preceding)) as p_holm,
         mean - t95 * sem > -0.3 * sd and mean + t95 * sem < 0.3 * sd as equivalent from h"""))
def _(spark, d):
    tests = r.equivalence(r.one_sample_t(behaviour_differences(spark, d), ["metric"], "difference"))
    return holm(cut_lineage(tests.withColumn("family", F.lit("behaviour"))), ["family"], "p_t", "p_holm")


_SPATIAL_T = f""", stt as (select metric, channel, count(*) as n, avg(difference) as mean, stddev_samp(difference) / sqrt(count(*)) as sem, stddev_samp(difference) as sd from cd group by all),
eff as (select 'channel' as part, metric, cast(channel as varchar) as label, n as size, mean as value, {t_p('mean / sem', '(n - 1)')} as p_value from stt),
rc0 as (select unit, avg(case when condition = 'A' and channel <= 3 then price end) - avg(case when condition = 'R' and channel <= 3 then price end)
   - avg(case when condition = 'A' and channel > 3 then price end) + avg(case when condition = 'R' and channel > 3 then price end) as c from cm group by unit),
rc as (select count(c) as n, avg(c) as mean, stddev_samp(c) / sqrt(count(c)) as sem from rc0),
roi as (select 'region' as part, 'price' as metric, 'front_minus_back' as label, n as size, mean as value, {t_p('mean / sem', '(n - 1)')} as p_value from rc)"""


@query("c3_spatial_report", "part metric label size:i value:6 p_value:6",
       _clusters_sql(CLUSTER_TABLE + _SPATIAL_T + """ select * from eff union all select * from roi
         union all select 'cluster', metric, channels, n_channels, cluster_mass, p_value from clusters""", 0.6))
def _(spark, d):
    effects = r.one_sample_t(channel_differences(spark, d), ["metric", "channel"], "difference").select(
        F.lit("channel").alias("part"), "metric", F.col("channel").cast("string").alias("label"), F.col("n").alias("size"), F.col("mean").alias("value"), F.col("p_t").alias("p_value"))
    found = clusters(spark, d).select(
        F.lit("cluster").alias("part"), "metric", F.col("channels").alias("label"), F.col("n_channels").alias("size"), F.col("cluster_mass").alias("value"), "p_value")
    region = channel_metrics(spark, d).withColumn("region", F.when(F.col("channel") <= 3, "front").otherwise("back"))
    contrast = region_contrast(region, "unit", "condition", "region", "price", ("A", "R"), ("front", "back")).withColumn("metric", F.lit("price"))
    roi = r.one_sample_t(contrast, ["metric"], "contrast").select(
        F.lit("region").alias("part"), "metric", F.lit("front_minus_back").alias("label"), F.col("n").alias("size"), F.col("mean").alias("value"), F.col("p_t").alias("p_value"))
    return effects.unionByName(found).unionByName(roi)


@query("c4_prediction_audit", "dataset outcome n:i observed:6 p_value:6 model slope:6 slope_se:6 method")
def _(spark, d):
    """Three refitted prediction sources to losses, increments and calibration."""
    shape = ["dataset", "outcome", "unit", "model", "observed", "predicted"]
    source = lambda df, ds, oc: df.withColumn("dataset", F.lit(ds)).withColumn("outcome", F.lit(oc)).select(*shape)
    refit_rt = source(rt_predictions(spark, d), "users", "log_rt")
    refit_acc = source(accuracy_predictions(spark, d), "users", "accuracy")
    repeated = source(collapse_repeats(fold_predictions(spark, d), ["unit", "model"]), "participants", "dprime")
    rows = cut_lineage(repeated.unionByName(refit_rt).unionByName(refit_acc))
    from mensura.operators.aggregates import held_out_loss

    loss = cut_lineage(held_out_loss(rows, ["dataset", "outcome", "unit", "model"], ["accuracy"]))
    audit = r.loss_audit(loss, ["dataset", "outcome"], "unit", 20261105, 10_000)
    linear = m.calibration_hc3(unit_means(rows.filter("outcome <> 'accuracy'"), ["dataset", "outcome", "model"]), ["dataset", "outcome", "model"])
    linear = linear.select("dataset", "outcome", "model", "slope", "slope_se", F.lit("hc3_on_unit_means").alias("method"))
    keys = ["dataset", "outcome", "model"]
    terms = m.coefficient_rows(binary_calibration(rows.filter("outcome = 'accuracy'"), keys), keys)
    binary = terms.filter("term = 'logit_prediction'").select(
        *keys, F.col("estimate").alias("slope"), F.col("std_error").alias("slope_se"), F.lit("gee_logit_by_unit").alias("method"))
    calibration = linear.unionByName(binary)
    return audit.select("dataset", "outcome", "n", "observed", "p_value").join(calibration, ["dataset", "outcome"])


@query("c5_family_extract", "outcome term:i p_value:9 q_value_bh:9",
       ctes(TESTS) + """, r as (select *, row_number() over (partition by family order by p_value) as i, count(p_value) over (partition by family) as n from tests where p_value is not null),
       q as (select family, term, p_value, least(1.0, min(p_value * n / i) over (partition by family order by i desc rows unbounded preceding)) as q from r)
       select family as outcome, term, p_value, q as q_value_bh from q where family = (select min(family) from tests)""")
def _(spark, d):
    t = tests_table(spark, d)
    first = t.agg(F.min("family").alias("family"))
    adjusted = benjamini_hochberg(t.join(first, "family"), ["family"], "p_value", "q_value_bh")
    kept = cut_lineage(adjusted.filter("q_value_bh is not null").withColumnRenamed("family", "outcome"))
    expected = t.join(first, "family").filter("p_value is not null").count()
    return require_family(kept, ["outcome", "term"], expected)


@query("c6_effect_views", "metric channel:i dz:6 dz_low:5 dz_high:5 wald_z:6 label",
       ctes(CD, "st as (select metric, channel, count(*) as n, avg(difference) as mean, stddev_samp(difference) as sd from cd group by all)", "nus as (select n - 1 as nu from st)",
            t_critical("nus", {"t975": 0.05}), recursive=True)
       + """select metric, channel, mean / sd as dz, (mean - t975 * sd / sqrt(n)) / sd as dz_low, (mean + t975 * sd / sqrt(n)) / sd as dz_high, mean / (sd / sqrt(n)) as wald_z,
       printf('%+.3f', mean / sd) as label from st join crit on nu = n - 1""")
def _(spark, d):
    t = r.one_sample_t(channel_differences(spark, d), ["metric", "channel"], "difference")
    return t.select(
        "metric", "channel", "dz", (F.col("ci95_low") / F.col("sd")).alias("dz_low"), (F.col("ci95_high") / F.col("sd")).alias("dz_high"),
        (F.col("mean") / F.col("sem")).alias("wald_z"), F.format_string("%+.3f", "dz").alias("label"))


SWEEP_TERMS = ["order_z", "m40_z", "m36_z", "m40_aud", "m36_aud"]
SWEEP_CONTRASTS = {
    f"{x}_{label}": {f"{x}_z": 1.0, **({f"{x}_aud": weight} if weight else {})}
    for x in ("m40", "m36") for label, weight in (("silent", 0.0), ("auditory", 1.0), ("average", 0.5))
}


def sweep_rows(spark, d):
    """Trials of the four specifications, and the model's columns."""
    one = lambda name, frame: frame.withColumn("specification", F.lit(name))
    # one unit is left out in one specification: the one with the smallest id
    base = cut_lineage(prepared(spark, d))
    first = base.agg(F.min("unit").alias("unit"))
    specs = one("main", base).unionByName(one("strict", prepared(spark, d, strict=True))).unionByName(
        one("without_first_unit", base.join(first, "unit", "left_anti"))).unionByName(one("envelope", prepared(spark, d, family="envelope")))
    rows, dummies = m.treatment_columns(specs, "trial_type", event_types(spark, d))
    return rows, [*SWEEP_TERMS, *dummies]


@query("c7_specification_sweep", "specification analysis term estimate:6 std_error:6 p_value:6 n:i n_clusters:i")
def _(spark, d):
    """Four specifications of two outcomes, each outcome fitted as groups of one job."""
    rows, columns = sweep_rows(spark, d)
    rows = cut_lineage(rows.select("specification", "unit", *[F.col(f"`{c}`") for c in columns], "correct", "rt", "log_rt"))
    accuracy = m.cluster_logit(rows, "unit", columns, "correct", ["specification"])
    time = m.cluster_ols(rows.filter("correct = 1 and rt > 0"), ["specification"], "unit", columns, "log_rt")
    named = lambda fit, outcome: fit.withColumn("analysis", F.lit(outcome))
    fits = cut_lineage(named(accuracy, "accuracy").unionByName(named(time, "log_rt")))
    keys = ["specification", "analysis"]
    shown = [*keys, "term", "estimate", "std_error", "p_value", "n", "n_clusters"]
    terms = m.coefficient_rows(fits, keys, ["n_clusters"]).filter(F.col("term").isin(SWEEP_TERMS)).select(*shown)
    contrasts = m.linear_contrasts(fits, keys, SWEEP_CONTRASTS).withColumnRenamed("contrast", "term")
    return terms.unionByName(contrasts.join(fits.select(*keys, "n_clusters"), keys).select(*shown))


@query("c8_primary_family", "family term:i p_value:9 q_value:9",
       ctes(TESTS) + """, s as (select * from tests where p_value is not null and family like '%3' and family <> 'Brand#13'),
       r as (select *, row_number() over (order by p_value) as i, count(*) over () as n from s)
       select family, term, p_value, least(1.0, min(p_value * n / i) over (order by i desc rows unbounded preceding)) as q_value from r""")
def _(spark, d):
    chosen = tests_table(spark, d).filter(F.col("family").endswith("3") & (F.col("family") != "Brand#13") & F.col("p_value").isNotNull())
    return benjamini_hochberg(chosen.withColumn("one", F.lit("primary")), ["one"], "p_value", "q_value")


@query("c9_go_no_go", "n_units:i n_passed:i go", ctes(EV, FT, GATE) + "select count(*) as n_units, sum(passed::int) as n_passed, sum(passed::int) >= 32 as go from gate")
def _(spark, d):
    return gate_record(spark, d).agg(
        F.count(F.lit(1)).alias("n_units"), F.sum(F.col("passed").cast("bigint")).alias("n_passed"),
        (F.sum(F.col("passed").cast("bigint")) >= 32).alias("go"))
