"""Regression models and held-out prediction (M rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from mensura.functions.scalar import logit
from mensura.functions.special import normal_two_sided_p
from mensura.operators import models as m
from mensura.operators.aggregates import collapse_repeats, cv_summary
from mensura.operators.ordering import row_index
from mensura.operators.resampling import bootstrap_mean, one_sample_t, signed_rank
from mensura.operators.windows import benjamini_hochberg, centre, holm, zscore
from mensura.plans.bindings import (
    BEH, CM, EV, FT, PR, TR, channel_metrics, event_types, events, features, predictions, regression_rows, runs, trials,
)
from mensura.plans.q_aggregates import behaviour, subject_features
from mensura.plans.registry import query, table
from mensura.plans.sqltext import ctes, uniform
from mensura.session import cut_lineage

FLAGS = ["A", "N", "R"]
_RR = """rr as (select l_suppkey as unit, ln(l_extendedprice) as y, l_quantity as quantity, l_discount as discount, l_tax as tax, l_returnflag as flag, l_linestatus as status from lineitem)"""


def coded_rows(spark, d):
    rows, flags = m.treatment_columns(regression_rows(spark, d), "flag", FLAGS)
    return rows.withColumn("quantity", F.col("quantity") / 10.0), flags


@query("m1_design_matrix", "flag n:i n_N:i n_R:i sum_quadratic:4 sum_interaction:4",
       ctes(_RR) + """select flag, count(*) as n, sum((flag = 'N')::int) as n_N, sum((flag = 'R')::int) as n_R, sum(discount * discount) as sum_quadratic,
       sum(case when flag = 'R' then discount else 0 end) as sum_interaction from rr group by flag""")
def _(spark, d):
    rows, names = m.treatment_columns(regression_rows(spark, d), "flag")
    rows, products = m.add_products(rows, [("discount", "discount"), ("discount", "flag[R]")])
    total = lambda c: F.sum(F.col(f"`{c}`"))
    return rows.groupBy("flag").agg(
        F.count(F.lit(1)).alias("n"), total(names[0]).alias("n_N"), total(names[1]).alias("n_R"),
        total(products[0]).alias("sum_quadratic"), total(products[1]).alias("sum_interaction"))


@query("m2_ols_hc3", "term estimate:6 std_error:6 ci_low:6 ci_high:6 p_value:6 n:i r_squared:6 adjusted_r_squared:6")
def _(spark, d):
    rows, flags = coded_rows(spark, d)
    fit = m.ols_hc3(rows, [], ["quantity", "discount", "tax", *flags], "y")
    return m.coefficient_rows(fit, [], ["r_squared", "adjusted_r_squared"])


@query("m3_cluster_ols", "term estimate:6 std_error:6 ci_low:6 ci_high:6 p_value:6 n:i n_clusters:i")
def _(spark, d):
    rows, flags = coded_rows(spark, d)
    return m.coefficient_rows(m.cluster_ols(rows, [], "unit", ["quantity", "discount", "tax", *flags], "y"), [], ["n_clusters"])


@query("m3_cluster_logit", "term estimate:6 std_error:6 ci_low:6 ci_high:6 p_value:6 n:i n_clusters:i")
def _(spark, d):
    rows, _ = coded_rows(spark, d)
    return m.coefficient_rows(m.cluster_logit(rows, "unit", ["quantity", "discount", "tax"], "returned"), [], ["n_clusters"])


def interaction_models(spark, d):
    rows, flags = coded_rows(spark, d)
    rows, products = m.add_products(rows, [("discount", f) for f in flags])
    return m.ols_hc3(rows, ["status"], ["discount", *flags, *products, "quantity", "tax"], "y"), products


GROUP_SLOPES = {"A": {"discount": 1.0}, "N": {"discount": 1.0, "discount:flag[N]": 1.0}, "R": {"discount": 1.0, "discount:flag[R]": 1.0}}


@query("m4_linear_contrasts", "contrast estimate:6 std_error:6 ci_low:6 ci_high:6 p_value:6 n:i")
def _(spark, d):
    rows, flags = coded_rows(spark, d)
    rows, products = m.add_products(rows, [("discount", flags[1])])
    fit = m.cluster_ols(rows, [], "unit", ["discount", *flags, *products], "y")
    return m.linear_contrasts(fit, [], {
        "plain": {"discount": 1.0}, "returned": {"discount": 1.0, products[0]: 1.0}, "average": {"discount": 1.0, products[0]: 0.5}})


@query("m5_group_slopes", "status contrast estimate:6 std_error:6 p_value:6 q_value:6 n:i")
def _(spark, d):
    fit, _ = interaction_models(spark, d)
    slopes = cut_lineage(m.linear_contrasts(fit, ["status"], GROUP_SLOPES).withColumn("family", F.lit("slopes")))
    return benjamini_hochberg(slopes, ["family"], "p_value", "q_value")


@query("m5_joint_wald", "status wald:6 dof:i p_value:6 q_value:6 n:i")
def _(spark, d):
    fit, products = interaction_models(spark, d)
    joint = cut_lineage(m.joint_wald_two(fit, ["status"], *products).withColumn("family", F.lit("joint")))
    return benjamini_hochberg(joint, ["family"], "p_value", "q_value")


_TWO = """var_pop({a}) as s11, var_pop({b}) as s22, covar_pop({a}, {b}) as s12, covar_pop({a}, y) as s1y, covar_pop({b}, y) as s2y"""


@query("m2_ols_hc3_slopes", "term estimate:6 std_error:6 n:i",
       ctes(_RR) + f""", x as (select discount as a, quantity as b, y from rr),
       s as (select count(*) as n, avg(a) as ma, avg(b) as mb, avg(y) as my, {_TWO.format(a='a', b='b')} from x),
       f as (select *, s11 * s22 - s12 * s12 as det, (s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12) as b1, (s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12) as b2 from s),
       e as (select n, b1, b2, (s22 * (a - ma) - s12 * (b - mb)) / det / n as g1, (s11 * (b - mb) - s12 * (a - ma)) / det / n as g2, a - ma as da, b - mb as db,
         y - my - b1 * (a - ma) - b2 * (b - mb) as r from x, f),
       h as (select *, r / (1 - 1.0 / n - da * g1 - db * g2) as q from e)
       select 'discount' as term, any_value(b1) as estimate, sqrt(sum(power(g1 * q, 2))) as std_error, count(*) as n from h
       union all select 'quantity', any_value(b2), sqrt(sum(power(g2 * q, 2))), count(*) from h""")
def _(spark, d):
    return m.coefficient_rows(m.ols_hc3(regression_rows(spark, d), [], ["discount", "quantity"], "y"), []).filter("term <> 'Intercept'")


@query("m3_cluster_ols_slopes", "term estimate:6 std_error:6 n:i n_clusters:i",
       ctes(_RR) + f""", x as (select unit, discount - avg(discount) over (partition by unit) as a, quantity - avg(quantity) over (partition by unit) as b, y - avg(y) over (partition by unit) as y from rr),
       s as (select count(*) as n, count(distinct unit) as g, sum(a * a) as s11, sum(b * b) as s22, sum(a * b) as s12, sum(a * y) as s1y, sum(b * y) as s2y from x),
       f as (select *, s11 * s22 - s12 * s12 as det, (s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12) as b1, (s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12) as b2 from s),
       c as (select unit, sum(a * (x.y - b1 * a - b2 * b)) as u1, sum(b * (x.y - b1 * a - b2 * b)) as u2 from x, f group by unit),
       v as (select sum(power((s22 * u1 - s12 * u2) / det, 2)) as v1, sum(power((s11 * u2 - s12 * u1) / det, 2)) as v2, any_value(g / (g - 1.0) * (n - 1.0) / (n - 2.0 - g)) as k from c, f)
       select 'discount' as term, b1 as estimate, sqrt(k * v1) as std_error, n, g as n_clusters from f, v union all select 'quantity', b2, sqrt(k * v2), n, g from f, v""")
def _(spark, d):
    return m.coefficient_rows(m.cluster_ols(regression_rows(spark, d), [], "unit", ["discount", "quantity"], "y"), [], ["n_clusters"])


@query("m6_unit_slopes", "unit:i slope_0:6 slope_1:6",
       ctes(_RR) + f""", s as (select unit, {_TWO.format(a='discount', b='quantity / 10.0')} from rr group by unit)
       select unit, (s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12) as slope_0, (s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12) as slope_1 from s""")
def _(spark, d):
    rows, _ = coded_rows(spark, d)
    return m.unit_slopes_ols(rows, "unit", ["discount", "quantity"], "y")


@query("m6_two_stage", "analysis term n:i mean:6 t:6 p_t:6 statistic:2 p_wilcoxon:6")
def _(spark, d):
    rows, _ = coded_rows(spark, d)
    linear = m.unit_slopes_ols(rows, "unit", ["discount", "quantity"], "y").withColumn("analysis", F.lit("price"))
    binary = m.unit_slopes_logit(rows, "unit", ["discount", "quantity"], "returned").drop("largest_step").withColumn("analysis", F.lit("returned"))
    slopes = cut_lineage(linear.unionByName(binary).unpivot(["analysis", "unit"], ["slope_0", "slope_1"], "term", "slope"))
    keys = ["analysis", "term"]
    return one_sample_t(slopes, keys, "slope").join(signed_rank(slopes, keys, "slope").select(*keys, "statistic", "p_wilcoxon"), keys)


def coupling_rows(spark, d):
    """Usable trials with a measure centred within user and condition."""
    t = trials(spark, d).filter(F.coalesce("usable", F.lit(False)))
    t = centre(t, ["unit", "condition"], "y", "within").withColumn("within", F.col("within") / 10.0)
    return t.select(
        "unit", "within", (F.col("condition") == "A").cast("double").alias("cond"),
        (F.col("congruency") == "incongruent").cast("double").alias("incong"),
        (F.col("x") > 8).cast("double").alias("high"), F.log(F.col("rt_ms")).alias("log_rt"), "correct",
    ).withColumn("within:cond", F.col("within") * F.col("cond"))


GEE_TERMS = ["within", "cond", "within:cond", "incong"]


@query("m7_gee_coupling", "model term estimate:6 std_error:6 ci_low:6 ci_high:6 p_value:6 p_holm:6 n:i n_units:i")
def _(spark, d):
    rows = cut_lineage(coupling_rows(spark, d))
    one = lambda frame, model, outcome: frame.select("unit", *[F.col(f"`{t}`") for t in GEE_TERMS], F.lit(model).alias("model"), F.col(outcome).alias("value"))
    long = one(rows, "binomial", "high").unionByName(one(rows.filter("correct and log_rt is not null"), "gaussian", "log_rt"))
    fits = m.gee_exchangeable(long, "unit", GEE_TERMS, "value", F.col("model") == "binomial", ["model"])
    terms = m.coefficient_rows(fits, ["model"], ["n_units"]).filter(F.col("term").isin("within", "within:cond"))
    return holm(cut_lineage(terms.withColumn("family", F.lit("coupling"))), ["family"], "p_value", "p_holm")


@query("m8_replication_models", "family status term estimate:6 std_error:6 p_value:6 q_value:6 n:i")
def _(spark, d):
    rows, flags = coded_rows(spark, d)
    long = rows.select("status", "tax", "discount", *[F.col(f"`{f}`") for f in flags], F.explode(F.array(
        F.struct(F.lit("price").alias("family"), F.col("y").alias("value")),
        F.struct(F.lit("quantity").alias("family"), F.col("quantity").alias("value")))).alias("o")).select("*", "o.*").drop("o")
    fits = m.ols_hc3(long, ["family", "status"], ["tax", "discount", *flags], "value")
    terms = m.coefficient_rows(fits, ["family", "status"]).filter("term <> 'Intercept'").withColumn("all", F.lit("all"))
    return benjamini_hochberg(cut_lineage(terms), ["all"], "p_value", "q_value")


Z_COLUMNS = {"m40": "m40_z", "m36": "m36_z"}
NEURAL = ["m40_z", "m36_z", "m40_aud", "m36_aud"]


def prepared(spark, d, strict=False, family="projected"):
    """Usable trials with order z, within-user z of the chosen measures, products and log time."""
    f = features(spark, d)
    keep = F.coalesce("valid", F.lit(False))
    if strict:
        keep = keep & F.coalesce("valid_strict", F.lit(False))
    source = {"projected": ("m40", "m36"), "envelope": ("e40", "e36")}[family]
    f = row_index(f.filter(keep), ["unit"], ["ts", "event_id"], "trial_index")
    f = zscore(f, ["unit"], {"trial_index": "order_z", source[0]: "m40_z", source[1]: "m36_z"})
    f = f.withColumn("m40_aud", F.col("m40_z") * F.col("auditory")).withColumn("m36_aud", F.col("m36_z") * F.col("auditory"))
    return f.withColumn("log_rt", F.log("rt")).filter("m40_z is not null and m36_z is not null")


def model_sets(dummies):
    return {"base": ["order_z", *dummies], "extended": ["order_z", *NEURAL, *dummies]}


def rt_predictions(spark, d):
    frame, dummies = m.treatment_columns(prepared(spark, d).filter("correct = 1 and rt > 0"), "trial_type", event_types(spark, d), keep_first=True)
    frame = cut_lineage(frame.select("unit", "order_z", *NEURAL, *[F.col(f"`{c}`") for c in dummies], "log_rt"))
    return m.leave_unit_out_ridge(frame, [], "unit", ["order_z", *NEURAL], dummies, model_sets(dummies), "log_rt")


def accuracy_predictions(spark, d):
    frame, dummies = m.treatment_columns(prepared(spark, d), "trial_type", event_types(spark, d), keep_first=True)
    frame = cut_lineage(frame.select("unit", "order_z", *NEURAL, *[F.col(f"`{c}`") for c in dummies], "correct"))
    return m.leave_unit_out_logistic(frame, "unit", ["order_z", *NEURAL], dummies, model_sets(dummies), "correct")


@query("m9_leave_unit_out_ridge", "unit:i model n:i mae:6 mean_predicted:6")
def _(spark, d):
    return rt_predictions(spark, d).groupBy("unit", "model").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col("observed") - F.col("predicted"))).alias("mae"), F.avg("predicted").alias("mean_predicted"))


_SUMS = "count(*) as n, sum(x) as sx, sum(y) as sy, sum(x * x) as sxx, sum(x * y) as sxy"
# one standardised feature: slope on the raw scale is (Sxy / n) / (sd^2 (1 + alpha / n)) with alpha 1
_RIDGE_ONE = """mx as (select *, sx / n as mx, sy / n as my, sxx / n - (sx / n) * (sx / n) as v, sxy / n - sx / n * sy / n as c from tr),
fit as (select *, c * n / (v * (n + 1.0)) as w from mx)"""


@query("m9_ridge_one_feature", "unit:i n:i mae:6 mean_predicted:6",
       "with x as (select l_suppkey as unit, l_quantity as x, l_extendedprice / 1009.0 as y from lineitem), t as (select " + _SUMS + " from x), u as (select unit, " + _SUMS + " from x group by unit), "
       "tr as (select u.unit, t.n - u.n as n, t.sx - u.sx as sx, t.sy - u.sy as sy, t.sxx - u.sxx as sxx, t.sxy - u.sxy as sxy from u, t), " + _RIDGE_ONE +
       " select x.unit, count(*) as n, avg(abs(y - my - w * (x - mx))) as mae, avg(my + w * (x - mx)) as mean_predicted from x join fit on fit.unit = x.unit group by x.unit")
def _(spark, d):
    x = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("unit"), F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1009.0).alias("y"))
    p = m.leave_unit_out_ridge(x, [], "unit", ["x"], [], {"one": ["x"]}, "y")
    return p.groupBy("unit").agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col("observed") - F.col("predicted"))).alias("mae"), F.avg("predicted").alias("mean_predicted"))


@query("m10_leave_unit_out_logistic", "unit:i model n:i log_loss:6")
def _(spark, d):
    y, p = F.col("observed"), F.col("predicted")
    return accuracy_predictions(spark, d).groupBy("unit", "model").agg(
        F.count(F.lit(1)).alias("n"), F.avg(-(y * F.log(p) + (1 - y) * F.log(1 - p))).alias("log_loss"))


def fold_predictions(spark, d):
    s = cut_lineage(subject_features(spark, d, 1).filter("usable and dprime_40 is not null"))
    s, sex = m.treatment_columns(s, "sex", ["F", "M"], keep_first=True)
    s, segment = m.treatment_columns(s, "segment", keep_first=True)
    numeric = ["age", "metric_27", "metric_40"]
    s = s.select("unit", *numeric, *[F.col(f"`{c}`") for c in [*sex, *segment]], "dprime_40")
    sets = {"base": ["age", *sex, *segment], "extended": [*numeric, *sex, *segment]}
    return m.repeated_fold_ridge(s, [], "unit", numeric, [*sex, *segment], sets, "dprime_40", seed=20260921)


@query("m11_repeated_fold_ridge", "unit:i model n_repeats:i observed:6 predicted:6")
def _(spark, d):
    return collapse_repeats(fold_predictions(spark, d), ["unit", "model"])


@query("m11_folds_one_feature", "unit:i repeat:i fold:i predicted:6",
       "with s as (select c_custkey as unit, c_acctbal / 1000.0 as x, (c_custkey * 37 % 101)::double as y from customer), "
       f"r as (select s.*, repeat, {uniform('one', 'repeat', 'unit')} as uu from s, range(0, 3) t(repeat)), "
       "f as (select *, ntile(10) over (partition by repeat order by uu, unit) - 1 as fold from r), "
       "t as (select " + _SUMS + " from s), u as (select repeat, fold, " + _SUMS + " from f group by all), "
       "tr as (select u.repeat, u.fold, t.n - u.n as n, t.sx - u.sx as sx, t.sy - u.sy as sy, t.sxx - u.sxx as sxx, t.sxy - u.sxy as sxy from u, t), " + _RIDGE_ONE +
       " select f.unit, f.repeat, f.fold, my + w * (x - mx) as predicted from f join fit on fit.repeat = f.repeat and fit.fold = f.fold")
def _(spark, d):
    s = table(spark, d, "customer").select(F.col("c_custkey").alias("unit"), (F.col("c_acctbal") / 1000.0).alias("x"), (F.col("c_custkey") * 37 % 101).cast("double").alias("y"))
    return m.repeated_fold_ridge(s, [], "unit", ["x"], [], {"one": ["x"]}, "y", repeats=3, seed="one")


def nested_features(spark, d):
    """Per user: two covariates, a paired contrast, split agreement, and the outcome contrast."""
    b = behaviour(spark, d)
    side = lambda v, c: F.max(F.when(F.col("condition") == c, F.col(v)))
    contrast = b.groupBy("unit").agg(
        (side("inverse_efficiency_ms", "A") - side("inverse_efficiency_ms", "B")).alias("outcome"),
        (side("accuracy", "A") - side("accuracy", "B")).alias("contrast"))
    f = features(spark, d)
    cell = f.filter("trial_type in ('click', 'view')").groupBy("unit", "trial_type").agg(
        F.avg(F.when(F.col("event_id") % 2 == 1, F.col("m36"))).alias("odd"), F.avg(F.when(F.col("event_id") % 2 == 0, F.col("m36"))).alias("even"))
    agreement = cell.groupBy("unit").agg(F.avg(-F.abs(F.col("odd") - F.col("even"))).alias("agreement"))
    covariates = f.groupBy("unit").agg(F.avg("m36").alias("freq"), F.avg("rt").alias("bl_rt"), (F.min("event_id") % 2).cast("double").alias("sex"))
    return contrast.join(agreement, "unit").join(covariates, "unit").na.drop()


NESTED = {"base": ["freq", "bl_rt", "sex"], "extended": ["freq", "bl_rt", "contrast", "agreement", "sex"]}


def nested_predictions(spark, d):
    frame = nested_features(spark, d)
    return m.nested_ridge(frame, "unit", ["freq", "bl_rt", "contrast", "agreement"], ["sex"], NESTED, "outcome", seed=20260924)


@query("m12_nested_ridge", "unit:i model alpha:2 observed:4 predicted:4")
def _(spark, d):
    return nested_predictions(spark, d)


@query("m13_train_only_scaling", "event_id:i fold:i scaled:6",
       ctes(EV) + """, x as (select event_id, event_id % 5 as fold, case when k % 9 <> 0 then value end as v from ev),
       tr as (select f.fold, avg(v) as mu, count(*) as n, sum(v * v) as q, count(v) as c from (select distinct fold from x) f join x on x.fold <> f.fold group by f.fold),
       st as (select fold, mu, sqrt((q - c * mu * mu) / n) as sd from tr)
       select event_id, x.fold, (coalesce(v, mu) - mu) / sd as scaled from x join st on st.fold = x.fold""")
def _(spark, d):
    x = events(spark, d).select("event_id", (F.col("event_id") % 5).alias("fold"), F.when(F.col("k") % 9 != 0, F.col("value")).alias("v"))
    return m.train_only_scaling(x, "fold", "v", x.select("fold").distinct())


@query("m14_feature_assembly", "unit:i contrast:6 agreement:6 outcome:4",
       ctes(EV, TR, BEH, FT) + """, c as (select unit, max(case when condition = 'A' then inverse_efficiency_ms end) - max(case when condition = 'B' then inverse_efficiency_ms end) as outcome,
         max(case when condition = 'A' then accuracy end) - max(case when condition = 'B' then accuracy end) as contrast from behaviour group by unit),
       s as (select unit, trial_type, avg(case when event_id % 2 = 1 then m36 end) as odd, avg(case when event_id % 2 = 0 then m36 end) as even from ft where trial_type in ('click', 'view') group by all),
       a as (select unit, avg(-abs(odd - even)) as agreement from s group by unit)
       select c.unit, contrast, agreement, outcome from c join a using (unit) where contrast is not null and outcome is not null and agreement is not null""")
def _(spark, d):
    return nested_features(spark, d)


_HC3 = """b as (select model, count(*) as n, avg(predicted) as mx, avg(observed) as my, var_pop(predicted) * count(*) as sxx, covar_pop(predicted, observed) * count(*) as sxy, var_pop(observed) * count(*) as syy from u group by model),
f as (select *, sxy / sxx as slope, my - sxy / sxx * mx as intercept from b),
e as (select u.model, any_value(n) as n, any_value(intercept) as intercept, any_value(slope) as slope,
  sqrt(sum(power((observed - intercept - slope * predicted) / (1 - 1.0 / n - power(predicted - mx, 2) / sxx) * (predicted - mx) / sxx, 2))) as slope_se,
  sqrt(sum(power((observed - intercept - slope * predicted) / (1 - 1.0 / n - power(predicted - mx, 2) / sxx) * (1.0 / n - mx * (predicted - mx) / sxx), 2))) as intercept_se,
  any_value(sxy * sxy / (sxx * syy)) as r_squared from u join f on f.model = u.model group by u.model)"""


def unit_means(predictions_frame, keys):
    return predictions_frame.groupBy(*keys, "unit").agg(F.avg("observed").alias("observed"), F.avg("predicted").alias("predicted"))


@query("m15_calibration_hc3", "model n:i intercept:6 intercept_se:6 slope:6 slope_se:6 slope_low:6 slope_high:6 r_squared:8",
       ctes(PR, "u as (select model, unit, avg(observed) as observed, avg(predicted) as predicted from pr where outcome = 'amount' group by all)", _HC3)
       + "select *, slope - 1.959963984540054 * slope_se as slope_low, slope + 1.959963984540054 * slope_se as slope_high from e")
def _(spark, d):
    u = unit_means(predictions(spark, d).filter("outcome = 'amount'"), ["model"])
    return m.calibration_hc3(u, ["model"])


def binary_calibration(frame, keys=()):
    rows = cut_lineage(frame.select(*keys, "unit", "observed", logit("predicted").alias("logit_prediction")))
    return m.gee_exchangeable(rows, "unit", ["logit_prediction"], "observed", True, list(keys))


@query("m16_binary_calibration", "term estimate:6 std_error:6 ci_low:6 ci_high:6 n:i n_units:i")
def _(spark, d):
    p = predictions(spark, d).filter("outcome = 'accuracy' and model = 'extended'")
    return m.coefficient_rows(binary_calibration(p), [], ["n_units"])


@query("m17_interaction_features", "event_id:i m40_aud:6 m36_aud:6", ctes(EV, FT) + "select event_id, m40 * auditory as m40_aud, m36 * auditory as m36_aud from ft")
def _(spark, d):
    f, names = m.add_products(features(spark, d), [("m40", "auditory"), ("m36", "auditory")])
    return f.withColumnRenamed(names[0], "m40_aud").withColumnRenamed(names[1], "m36_aud")


@query("m18_feature_family", "family event_id:i a_z:6 b_z:6",
       ctes(EV, FT) + """, l as (select 'projected' as family, unit, event_id, m40 as a, m36 as b from ft union all select 'envelope', unit, event_id, e40, e36 from ft),
       z as (select family, event_id, (a - avg(a) over (partition by family, unit)) / nullif(stddev_samp(a) over (partition by family, unit), 0) as a_z,
         (b - avg(b) over (partition by family, unit)) / nullif(stddev_samp(b) over (partition by family, unit), 0) as b_z from l)
       select * from z where a_z is not null and b_z is not null""")
def _(spark, d):
    pick = lambda n, a, b: F.struct(F.lit(n).alias("family"), F.col(a).alias("a"), F.col(b).alias("b"))
    long = features(spark, d).select("unit", "event_id", F.explode(F.array(pick("projected", "m40", "m36"), pick("envelope", "e40", "e36"))).alias("f")).select("unit", "event_id", "f.*")
    return zscore(long, ["family", "unit"], {"a": "a_z", "b": "b_z"}).na.drop(subset=["a_z", "b_z"])


INFLUENCE = ["age", "metric_27", "metric_40"]


def influence_rows(spark, d):
    s = subject_features(spark, d, 1).filter("usable").na.drop(subset=[*INFLUENCE, "dprime_40"])
    s = zscore(s, [], {c: f"{c}_z" for c in INFLUENCE}, population=True)
    return cut_lineage(s.select("unit", *[f"{c}_z" for c in INFLUENCE], "dprime_40"))


@query("m19_influence", "unit:i leverage:6 loo_estimate:6 cooks_distance:6")
def _(spark, d):
    return m.influence(influence_rows(spark, d), ["unit"], [f"{c}_z" for c in INFLUENCE], "dprime_40", "metric_40_z")


@query("m19_influence_simple", "c_custkey:i leverage:8 loo_estimate:8 cooks_distance:8",
       """with x as (select c_custkey, c_acctbal / 1000.0 as x, (c_custkey * 37 % 101)::double as y from customer),
       s as (select count(*) as n, avg(x) as mx, avg(y) as my, var_pop(x) * count(*) as sxx, covar_pop(x, y) * count(*) as sxy, var_pop(y) * count(*) as syy from x),
       e as (select c_custkey, n, sxx, sxy / sxx as b, x - mx as dx, 1.0 / n + power(x - mx, 2) / sxx as h, y - my - sxy / sxx * (x - mx) as e, (syy - sxy * sxy / sxx) / (n - 2) as s2 from x, s)
       select c_custkey, h as leverage, b - dx / sxx * e / (1 - h) as loo_estimate, e * e * h / (2 * s2 * power(1 - h, 2)) as cooks_distance from e""")
def _(spark, d):
    x = table(spark, d, "customer").select("c_custkey", (F.col("c_acctbal") / 1000.0).alias("x"), (F.col("c_custkey") * 37 % 101).cast("double").alias("y"))
    return m.influence(x, ["c_custkey"], ["x"], "y", "x")


@query("m19_variance_inflation", "term vif:6")
def _(spark, d):
    return m.variance_inflation(influence_rows(spark, d), [f"{c}_z" for c in INFLUENCE])


@query("m19_coefficient_bootstrap", "term ci_low:6 median:6 ci_high:6 n_replicates:i")
def _(spark, d):
    return m.bootstrap_coefficients(influence_rows(spark, d), "unit", [f"{c}_z" for c in INFLUENCE], "dprime_40", 20260921, 10_000)
