"""Aggregations (A rows) and reshaping (V rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from mensura.functions.scalar import safe_ratio
from mensura.operators import aggregates as a
from mensura.operators import graph, reshape
from mensura.operators.ordering import attach, quantile_table
from mensura.plans.bindings import (
    BEH, BEHLONG, CD, CM, EV, FT, LE, LOG, PR, PSMP, RUNS, SMP, TR, channel_differences, channel_metrics, event_log, events, features,
    line_edges, pooled_samples, predictions, runs, samples, trials,
)
from mensura.plans.bindings import nation_keys
from mensura.plans.q_joins import ALLPAIRS, KNN, knn, nation_daily
from mensura.plans.registry import query, table
from mensura.plans.sqltext import average_rank, ctes, normal_quantile


def behaviour(spark, d):
    return a.behaviour_summary(trials(spark, d), ["unit", "condition"])


@query("a1_behaviour_summary", "unit:i condition accuracy:6 median_correct_rt_ms:6 inverse_efficiency_ms:6", ctes(EV, TR, BEH) + "select * from behaviour")
def _(spark, d):
    return behaviour(spark, d)


@query("a2_weighted_mean", "unit:i freq:i metric:6",
       ctes(RUNS) + "select unit, freq, sum(metric * n_valid) / sum(case when metric is not null then n_valid end) as metric from runs group by all")
def _(spark, d):
    return runs(spark, d).groupBy("unit", "freq").agg(a.weighted_mean("metric", "n_valid").alias("metric"))


@query("a3_subject_rollup", "unit:i segment n_runs_27:i n_valid_27:i hits_27:i max_n_bad_27:i metric_27:6 dprime_27:6 n_runs_40:i n_valid_40:i hits_40:i max_n_bad_40:i metric_40:6 dprime_40:6 usable",
       ctes(RUNS) + f""", roll as (select unit, freq, count(distinct run) as n_runs, sum(n_valid) as n_valid, sum(hits) as hits, max(n_bad) as max_n_bad,
         sum(metric * n_valid) / sum(case when metric is not null then n_valid end) as metric,
         (sum(hits) + 0.5) / (sum(hits) + sum(misses) + 1.0) as hr, (sum(false_alarms) + 0.5) / (sum(false_alarms) + sum(correct_rejections) + 1.0) as fr
         from runs group by all),
       dp as (select *, {normal_quantile('hr')} - {normal_quantile('fr')} as dprime from roll),
       p as (select * from dp where freq = 27), q as (select * from dp where freq = 40),
       w as (select coalesce(p.unit, q.unit) as unit, p.n_runs as n_runs_27, p.n_valid as n_valid_27, p.hits as hits_27, p.max_n_bad as max_n_bad_27, p.metric as metric_27, p.dprime as dprime_27,
         q.n_runs as n_runs_40, q.n_valid as n_valid_40, q.hits as hits_40, q.max_n_bad as max_n_bad_40, q.metric as metric_40, q.dprime as dprime_40 from p full join q on p.unit = q.unit)
       select w.*, c_mktsegment as segment, coalesce(n_valid_27 >= 4, false) and coalesce(n_valid_40 >= 4, false) and metric_27 is not null and metric_40 is not null as usable
       from w join customer on c_custkey = w.unit""")
def _(spark, d):
    return subject_features(spark, d)


def subject_features(spark, d, minimum: int = 4):
    from mensura.operators.guards import suffix_columns, technical_usability
    from mensura.operators.joins import one_to_one, outer_levels

    rolled = a.rollup_runs(runs(spark, d), ["unit", "freq"], "run", "n_valid",
                           ["hits", "misses", "false_alarms", "correct_rejections"], ["n_bad"], ["metric"])
    rolled = rolled.withColumn("dprime", a.corrected_dprime("hits", "misses", "false_alarms", "correct_rejections"))
    values = [c for c in rolled.columns if c not in ("unit", "freq")]
    level = lambda f: suffix_columns(rolled.filter(F.col("freq") == f).drop("freq"), values, str(f))
    wide = outer_levels([level(27), level(40)], ["unit"])
    people = table(spark, d, "customer").select(
        F.col("c_custkey").alias("unit"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("age"),
        F.when(F.col("c_nationkey") % 2 == 0, "F").otherwise("M").alias("sex"))
    ok, reason = technical_usability(["n_valid_27", "n_valid_40"], ["metric_27", "metric_40"], minimum)
    return one_to_one(people, wide, ["unit"]).withColumn("usable", ok).withColumn("exclusion_reason", reason)


@query("a4_corrected_dprime", "unit:i hits:i misses:i false_alarms:i correct_rejections:i dprime:6",
       f"""with c as (select l_suppkey as unit, sum((l_returnflag = 'R' and l_linestatus = 'F')::int) as hits, sum((l_returnflag = 'R' and l_linestatus <> 'F')::int) as misses,
         sum((l_returnflag <> 'R' and l_linestatus = 'F')::int) as false_alarms, sum((l_returnflag <> 'R' and l_linestatus <> 'F')::int) as correct_rejections from lineitem group by 1),
       r as (select *, (hits + 0.5) / (hits + misses + 1.0) as h, (false_alarms + 0.5) / (false_alarms + correct_rejections + 1.0) as f from c)
       select *, {normal_quantile('h')} - {normal_quantile('f')} as dprime from r""")
def _(spark, d):
    signal, response = F.col("l_returnflag") == "R", F.col("l_linestatus") == "F"
    n = lambda c: F.sum(c.cast("bigint"))
    counts = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("unit")).agg(
        n(signal & response).alias("hits"), n(signal & ~response).alias("misses"),
        n(~signal & response).alias("false_alarms"), n(~signal & ~response).alias("correct_rejections"))
    return counts.withColumn("dprime", a.corrected_dprime("hits", "misses", "false_alarms", "correct_rejections"))


@query("a5_trial_summary", "condition congruency n_trials:i median_rt:6 plausible_fraction:6 valid_fraction:6",
       ctes(EV, TR) + """select condition, nullif(congruency, 'congruent') as congruency, count(*) as n_trials, quantile_cont(rt_ms, 0.5) as median_rt,
       avg(coalesce(rt_ms between 100 and 2000, false)::int) as plausible_fraction, avg(correct::int) as valid_fraction from tr group by all""")
def _(spark, d):
    t = trials(spark, d).withColumn("congruency", F.nullif(F.col("congruency"), F.lit("congruent")))
    t = t.withColumn("plausible", F.coalesce(F.col("rt_ms").between(100, 2000), F.lit(False)))
    return a.trial_summary(t, ["condition", "congruency"], "rt_ms", "plausible", "correct")


@query("a6_code_counts", "code:i n:i allowed", ctes(EV, LOG) + "select code & 255 as code, count(*) as n, (code & 255) in (8, 9, 20, 21, 50) as allowed from elog group by all")
def _(spark, d):
    return a.code_counts(event_log(spark, d).withColumn("code", F.col("code").bitwiseAND(255)), "code", [8, 9, 20, 21, 50])


@query("a7_category_counts", "c_mktsegment n:i", "select c_mktsegment, count(*) as n from customer group by 1")
def _(spark, d):
    return table(spark, d, "customer").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


@query("a8_worst_cell", "unit:i minimum_rate:6 n_cells:i",
       ctes(EV, FT) + "select unit, min(r) as minimum_rate, count(*) as n_cells from (select unit, trial_type, avg(coalesce(valid, false)::int) as r from ft group by all) group by unit")
def _(spark, d):
    return a.worst_cell(features(spark, d).withColumn("valid", F.coalesce("valid", F.lit(False))), ["unit"], "trial_type", "valid")


@query("a9_distinct_units", "trial_type n_units:i", ctes(EV, FT) + "select trial_type, count(distinct unit) as n_units from ft where valid group by all")
def _(spark, d):
    return features(spark, d).filter("valid").groupBy("trial_type").agg(F.count_distinct("unit").alias("n_units"))


@query("a10_collapse_repeats", "dataset unit:i model observed:6 predicted:6",
       ctes(PR) + "select dataset, unit, model, min(observed) as observed, avg(predicted + observed) as predicted from pr where outcome = 'amount' group by all")
def _(spark, d):
    p = predictions(spark, d).filter("outcome = 'amount'").withColumn("predicted", F.col("predicted") + F.col("observed"))
    return a.collapse_repeats(p, ["dataset", "unit", "model"])


@query("a11_moments", "event_type n:i mean:6 sd:6 sem:6",
       ctes(EV) + "select event_type, count(value) as n, avg(value) as mean, stddev_samp(value) as sd, stddev_samp(value) / sqrt(count(value)) as sem from ev group by all")
def _(spark, d):
    return a.moments(events(spark, d), ["event_type"], "value")


@query("a12_distribution", "l_returnflag median:6 iqr:6 fraction_below_zero:6 minimum:6 maximum:6",
       """with x as (select l_returnflag, l_extendedprice - 45000.0 as v from lineitem)
       select l_returnflag, quantile_cont(v, 0.5) as median, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) as iqr, avg((v < 0)::int) as fraction_below_zero,
         min(v) as minimum, max(v) as maximum from x group by all""")
def _(spark, d):
    x = table(spark, d, "lineitem").select("l_returnflag", (F.col("l_extendedprice") - 45000.0).alias("v"))
    return a.distribution(x, ["l_returnflag"], "v")


@query("a13_corrected_skewness", "unit:i skewness:6", ctes(EV) + "select unit, skewness(value) as skewness from ev group by all")
def _(spark, d):
    return events(spark, d).groupBy("unit").agg(a.corrected_skewness("value").alias("skewness"))


@query("a14_robust_upper", "event_type center:6 mad:6 upper:6",
       ctes(EV) + """, c as (select event_type, quantile_cont(value, 0.5) as center from ev group by all),
       m as (select event_type, center, quantile_cont(abs(value - center), 0.5) as mad from ev join c using (event_type) group by all)
       select event_type, center, mad, center + 6 * mad as upper from m""")
def _(spark, d):
    return a.robust_upper(events(spark, d), ["event_type"], "value")


@query("a15_signal_summary", "channel finite_fraction:6 rms:6 sd:6 median:6 mad:6 p01:6 p99:6",
       ctes(EV) + """, x as (select event_type as channel, case when k <> 3 then value end as v from ev),
       c as (select channel, quantile_cont(v, 0.5) as median from x group by all),
       m as (select channel, quantile_cont(abs(v - median), 0.5) as mad from x join c using (channel) group by all)
       select channel, avg((v is not null)::int) as finite_fraction, sqrt(avg(v * v)) as rms, stddev_pop(v) as sd, any_value(median) as median, any_value(mad) as mad,
         quantile_cont(v, 0.01) as p01, quantile_cont(v, 0.99) as p99 from x join c using (channel) join m using (channel) group by channel""")
def _(spark, d):
    x = events(spark, d).select(F.col("event_type").alias("channel"), F.when(F.col("k") != 3, F.col("value")).alias("v"))
    return a.signal_summary(x, ["channel"], "v")


@query("a16_peak_to_peak", "unit:i trial:i median_ptp:6 max_ptp:6",
       ctes(SMP) + """select unit, trial, quantile_cont(p, 0.5) as median_ptp, max(p) as max_ptp from (select unit, trial, channel, max(x) - min(x) as p from smp group by all) group by all""")
def _(spark, d):
    return a.peak_to_peak(samples(spark, d), ["unit", "trial"], "channel", "x")


@query("a17_pair_correlation", "a:i b:i n:i r:6",
       ctes(KNN) + """, long as (select a, b, unnest(x.v) as p, unnest(y.v) as q from edges join emb x on x.id = a join emb y on y.id = b)
       select a, b, count(*) as n, corr(p, q) as r from long group by all""")
def _(spark, d):
    edges = graph.symmetric_edges(knn(spark, d)).select("a", "b")
    return graph.edge_correlations(edges, table(spark, d, "embeddings"), "vec_id", "embedding")


@query("a18_spearman", "lang n:i rho:6",
       f"""with x as (select lang, n_chars::double as u, (quality + 2 * toxic)::double as v from documents join labels using (doc_id)),
       r as (select lang, {average_rank('u', 'lang')} as ru, {average_rank('v', 'lang')} as rv from x)
       select lang, count(*) as n, corr(ru, rv) as rho from r group by all""")
def _(spark, d):
    x = table(spark, d, "documents").select("doc_id", "lang", "n_chars").join(table(spark, d, "labels"), "doc_id").select(
        "lang", F.col("n_chars").cast("double").alias("u"), (F.col("quality") + 2 * F.col("toxic")).cast("double").alias("v"))
    return a.spearman(x, ["lang"], "u", "v")


RING = """nr as (select n_nationkey as a, coalesce(lead(n_nationkey) over (order by n_nationkey), min(n_nationkey) over ()) as b from nation),
ring as (select a, b from nr union select b, a from nr)"""


def nation_ring(spark, d):
    """Neighbouring keys in sort order, the last next to the first."""
    keys = nation_keys(spark, d)
    ring = spark.createDataFrame(list(zip(keys, keys[1:] + keys[:1])), "x int, y int")
    return graph.both_directions(ring, "x", "y")


PROFILE = """prof as (select a as channel, count(*) as n_neighbours, quantile_cont(r, 0.5) as median_neighbour_r, min(r) as minimum_neighbour_r, max(r) as maximum_neighbour_r,
  arg_max(b, r) as strongest_neighbour, any_value(g.m) as median_global_r
  from cc join ring using (a, b) join (select a, quantile_cont(r, 0.5) as m from cc group by a) g using (a) group by a)"""


@query("a19_neighbour_profile", "channel:i n_neighbours:i median_neighbour_r:6 minimum_neighbour_r:6 maximum_neighbour_r:6 strongest_neighbour:i median_global_r:6",
       ctes(ALLPAIRS, RING, PROFILE) + "select * from prof")
def _(spark, d):
    cc = graph.channel_correlations(nation_daily(spark, d), [], "channel", nation_keys(spark, d), "s", "x")
    return a.neighbour_profile(cc, nation_ring(spark, d)).withColumnRenamed("a", "channel")


def gate_record(spark, d):
    f = features(spark, d).withColumn("valid", F.coalesce("valid", F.lit(False)))
    cells = a.worst_cell(f, ["unit"], "trial_type", "valid")
    totals = f.groupBy("unit").agg(F.count(F.lit(1)).alias("n_trials"), F.sum(F.col("valid").cast("bigint")).alias("n_usable"), F.min("rt").alias("min_rt"))
    joined = totals.join(cells, "unit")
    return joined.select(
        "unit", "n_trials", "n_usable",
        (F.col("n_trials") >= 60).alias("coverage_gate"), (F.col("n_cells") == 5).alias("cells_gate"),
        (F.col("n_usable") / F.col("n_trials") >= 0.85).alias("overall_gate"), (F.col("minimum_rate") >= 0.7).alias("worst_cell_gate"),
        (F.col("min_rt") - 190.0 >= 15.0).alias("margin_gate"), (F.col("n_trials") - F.col("n_usable") <= 12).alias("loss_gate"),
    ).withColumn("passed", F.expr("coverage_gate and cells_gate and overall_gate and worst_cell_gate and margin_gate and loss_gate"))


GATE = """cells as (select unit, min(r) as minimum_rate, count(*) as n_cells from (select unit, trial_type, avg(coalesce(valid, false)::int) as r from ft group by all) group by unit),
tot as (select unit, count(*) as n_trials, sum(coalesce(valid, false)::int) as n_usable, min(rt) as min_rt from ft group by unit),
gate0 as (select unit, n_trials, n_usable, n_trials >= 60 as coverage_gate, n_cells = 5 as cells_gate, n_usable / n_trials::double >= 0.85 as overall_gate,
  minimum_rate >= 0.7 as worst_cell_gate, min_rt - 190.0 >= 15.0 as margin_gate, n_trials - n_usable <= 12 as loss_gate from tot join cells using (unit)),
gate as (select *, coverage_gate and cells_gate and overall_gate and worst_cell_gate and margin_gate and loss_gate as passed from gate0)"""


@query("a20_technical_gate", "unit:i n_trials:i n_usable:i coverage_gate cells_gate overall_gate worst_cell_gate margin_gate loss_gate passed", ctes(EV, FT, GATE) + "select * from gate")
def _(spark, d):
    return gate_record(spark, d)


@query("a21_region_contrast", "unit:i contrast_first:6 contrast_second:6 contrast:6",
       ctes(CM) + """, m as (select unit, avg(case when condition = 'A' and channel <= 3 then price end) as af, avg(case when condition = 'R' and channel <= 3 then price end) as rf,
         avg(case when condition = 'A' and channel > 3 then price end) as ab, avg(case when condition = 'R' and channel > 3 then price end) as rb from cm group by unit)
       select unit, af - rf as contrast_first, ab - rb as contrast_second, (af - rf) - (ab - rb) as contrast from m""")
def _(spark, d):
    m = channel_metrics(spark, d).withColumn("region", F.when(F.col("channel") <= 3, "front").otherwise("back"))
    return a.region_contrast(m, "unit", "condition", "region", "price", ("A", "R"), ("front", "back"))


LOSS = """loss as (select dataset, outcome, unit, model, case when outcome = 'accuracy' then 'log_loss' else 'absolute_error' end as metric,
  avg(case when outcome = 'accuracy' then -(observed * ln(predicted) + (1 - observed) * ln(1 - predicted)) else abs(observed - predicted) end) as loss from pr group by all)"""


def losses(spark, d):
    # the rows of a unit are added in the order of the table: signs and places depend on the last digit
    return a.held_out_loss(predictions(spark, d, ordered=True), ["dataset", "outcome", "unit", "model"], ["accuracy"], ordered=True)


@query("a22_held_out_loss", "dataset outcome unit:i model metric loss:6", ctes(PR, LOSS) + "select * from loss")
def _(spark, d):
    return losses(spark, d)


@query("a23_model_performance", "dataset model mae:6 rmse:6 rho:6",
       ctes(PR) + f""", x as (select dataset, model, observed, predicted, {average_rank('observed', 'dataset, model')} as ro, {average_rank('predicted', 'dataset, model')} as rp from pr where outcome = 'amount')
       select dataset, model, avg(abs(observed - predicted)) as mae, sqrt(avg((observed - predicted) * (observed - predicted))) as rmse, corr(ro, rp) as rho from x group by all""")
def _(spark, d):
    return a.model_performance(predictions(spark, d).filter("outcome = 'amount'"), ["dataset", "model"])


@query("a24_percent_of_baseline", "dataset outcome base:6 delta:6 delta_percent:6",
       ctes(PR, LOSS) + """, m as (select dataset, outcome, avg(case when model = 'base' then loss end) as base, avg(case when model = 'extended' then loss end) as extended from loss group by all)
       select dataset, outcome, base, extended - base as delta, 100.0 * (extended - base) / base as delta_percent from m""")
def _(spark, d):
    side = lambda m: F.avg(F.when(F.col("model") == m, F.col("loss")))
    m = losses(spark, d).groupBy("dataset", "outcome").agg(side("base").alias("base"), (side("extended") - side("base")).alias("delta"))
    return a.percent_of_baseline(m, "base", ["delta"])


@query("a25_cv_summary", "dataset outcome n:i mean_base:6 mean_extended:6 mean_delta:6 n_improved:i",
       ctes(PR, LOSS) + """, w as (select dataset, outcome, unit, max(case when model = 'base' then loss end) as b, max(case when model = 'extended' then loss end) as e from loss group by all)
       select dataset, outcome, count(*) as n, avg(b) as mean_base, avg(e) as mean_extended, avg(e - b) as mean_delta, sum((e - b < 0)::int) as n_improved from w group by all""")
def _(spark, d):
    return a.cv_summary(losses(spark, d).withColumnRenamed("loss", "score"), ["dataset", "outcome"], ["unit"])


@query("a26_degree_summary", "n_nodes:i n_edges:i min_degree:i max_degree:i",
       ctes(KNN) + """, deg as (select node, count(*) as d from (select a as node from edges union all select b from edges) group by node)
       select count(*) as n_nodes, sum(d) / 2 as n_edges, min(d) as min_degree, max(d) as max_degree from deg""")
def _(spark, d):
    return a.degree_summary(graph.symmetric_edges(knn(spark, d)), "a", "b")


# --- reshaping ---

@query("v1_pivot_one", "unit:i A:6 B:6",
       ctes(EV, TR, BEH) + "select unit, max(case when condition = 'A' then accuracy end) as A, max(case when condition = 'B' then accuracy end) as B from behaviour group by unit")
def _(spark, d):
    return reshape.pivot_one(behaviour(spark, d), ["unit"], "condition", ["A", "B"], "accuracy")


@query("v2_pivot_many", "unit:i A_price:6 R_price:6 A_n:i R_n:i",
       ctes(CM) + """, u as (select unit, condition, sum(price * n_trials) as price, sum(n_trials) as n from cm group by all)
       select unit, max(case when condition = 'A' then price end) as A_price, max(case when condition = 'R' then price end) as R_price,
         max(case when condition = 'A' then n end) as A_n, max(case when condition = 'R' then n end) as R_n from u group by unit""")
def _(spark, d):
    u = channel_metrics(spark, d).groupBy("unit", "condition").agg(F.sum(F.col("price") * F.col("n_trials")).alias("price"), F.sum("n_trials").alias("n"))
    return reshape.pivot_many(u, ["unit"], "condition", ["A", "R"], ["price", "n"])


@query("v3_condition_differences", "unit:i channel:i difference:6", ctes(CD) + "select unit, channel, difference from cd where metric = 'price'")
def _(spark, d):
    return reshape.condition_differences(channel_metrics(spark, d), ["unit", "channel"], "condition", ("A", "R"), "price")


@query("v4_unstack_means", "unit:i A_front:6 A_back:6 R_front:6 R_back:6",
       ctes(CM) + """select unit, avg(case when condition = 'A' and channel <= 3 then price end) as A_front, avg(case when condition = 'A' and channel > 3 then price end) as A_back,
         avg(case when condition = 'R' and channel <= 3 then price end) as R_front, avg(case when condition = 'R' and channel > 3 then price end) as R_back from cm group by unit""")
def _(spark, d):
    m = channel_metrics(spark, d).withColumn("region", F.when(F.col("channel") <= 3, "front").otherwise("back"))
    return reshape.unstack_means(m, ["unit"], ["condition", "region"], ["A_front", "A_back", "R_front", "R_back"], "price")


@query("v5_long_metrics", "unit:i condition metric value:6", ctes(EV, TR, BEH, BEHLONG) + "select * from behlong where value is not null")
def _(spark, d):
    return reshape.long_metrics(behaviour(spark, d), ["unit", "condition"], ["accuracy", "median_correct_rt_ms", "inverse_efficiency_ms"]).filter("value is not null")


@query("v6_list_round_trip", "unit:i channels n_channels:i",
       ctes(CM) + "select unit, string_agg(distinct cast(channel as varchar), ';' order by cast(channel as varchar)) as channels, count(distinct channel) as n_channels from cm where n_trials > (select avg(n_trials) from cm) group by unit")
def _(spark, d):
    m = channel_metrics(spark, d)
    average = m.agg(F.avg("n_trials").alias("average"))
    big = attach(m, average, []).filter("n_trials > average").select("unit", F.col("channel").cast("string").alias("channel")).distinct()
    listed = reshape.collapse_list(big, ["unit"], "channel", "channels")
    back = reshape.explode_list(listed, "channels", "channel")
    counts = back.groupBy("unit").agg(F.count(F.lit(1)).alias("n_channels"))
    return listed.join(counts, "unit")
