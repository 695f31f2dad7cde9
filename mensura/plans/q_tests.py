"""Resampling and tests (I rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from mensura.functions.scalar import spearman_brown
from mensura.operators import resampling as r
from mensura.operators.aggregates import correlation_p, pearson, region_contrast, spearman
from mensura.operators.graph import connected_components
from mensura.operators.models import partial_spearman
from mensura.operators.reshape import long_metrics
from mensura.operators.windows import benjamini_hochberg, odd_even_by_position
from mensura.plans.bindings import (
    BEH, BEHLONG, CD, CM, EV, FT, LE, PR, RUNS, TR, channel_differences, channel_metrics, events, features, line_edges, predictions, runs, trials,
)
from mensura.plans.q_aggregates import LOSS, behaviour, losses, subject_features
from mensura.plans.registry import query, table
from mensura.plans.sqltext import average_rank, ctes, draw_base, normal_p, position, sign_bits, signed, t_critical, t_p
from mensura.session import cut_lineage

METRICS = ["accuracy", "median_correct_rt_ms", "inverse_efficiency_ms"]


def behaviour_differences(spark, d):
    """A minus B per user and behaviour measure."""
    side = lambda m, c: F.max(F.when(F.col("condition") == c, F.col(m)))
    wide = behaviour(spark, d).groupBy("unit").agg(*[(side(m, "A") - side(m, "B")).alias(m) for m in METRICS])
    long = long_metrics(wide, ["unit"], METRICS).withColumnRenamed("value", "difference").filter("difference is not null")
    return cut_lineage(long)  # one row per user and measure


_ONE = f"""st as (select metric, count(difference) as n, avg(difference) as mean, stddev_samp(difference) as sd, avg((difference > 0)::int) as direction_fraction
  from behdiff where difference is not null group by metric), nus as (select n - 1 as nu from st)"""
_ONET = ", one as (select st.*, sd / sqrt(n) as sem, t975, t95, mean / (sd / sqrt(n)) as t, mean / sd as dz from st join crit on crit.nu = n - 1)"


def _one_sample_sql(body: str) -> str:
    return ctes(EV, TR, BEH, BEHLONG, _ONE, t_critical("nus", {"t975": 0.05, "t95": 0.1}), recursive=True) + _ONET + body


@query("i1_paired_t", "metric n:i mean:6 ci95_low:5 ci95_high:5 t:6 p_t:6 dz:6",
       _one_sample_sql(f" select metric, n, mean, mean - t975 * sem as ci95_low, mean + t975 * sem as ci95_high, t, {t_p('t', '(n - 1)')} as p_t, dz from one"))
def _(spark, d):
    return r.one_sample_t(behaviour_differences(spark, d), ["metric"], "difference")


@query("i2_equivalence", "metric ci90_low:5 ci90_high:5 equivalence_bound:5 equivalent",
       _one_sample_sql(" select metric, mean - t95 * sem as ci90_low, mean + t95 * sem as ci90_high, 0.3 * sd as equivalence_bound, mean - t95 * sem > -0.3 * sd and mean + t95 * sem < 0.3 * sd as equivalent from one"))
def _(spark, d):
    return r.equivalence(r.one_sample_t(behaviour_differences(spark, d), ["metric"], "difference"))


@query("i3_direction_fraction", "channel:i metric direction_fraction:6", ctes(CD) + "select channel, metric, avg((difference > 0)::int) as direction_fraction from cd group by all")
def _(spark, d):
    return r.one_sample_t(channel_differences(spark, d), ["metric", "channel"], "difference").select("channel", "metric", "direction_fraction")


_WSR = f"""nz as (select metric, difference as v, abs(difference) as a from behdiff where difference <> 0),
rk as (select *, {average_rank('a', 'metric')} as rnk from nz),
ti as (select metric, sum(c * c * c - c) as tt from (select metric, a, count(*)::double as c from nz group by all) group by metric),
ws as (select metric, count(*) as n_used, sum(case when v > 0 then rnk else 0 end) as w_plus, any_value(tt) as tt from rk join ti using (metric) group by metric),
wz as (select *, least(w_plus, n_used * (n_used + 1) / 2.0 - w_plus) as statistic,
  (least(w_plus, n_used * (n_used + 1) / 2.0 - w_plus) - n_used * (n_used + 1) / 4.0) / sqrt(n_used * (n_used + 1.0) * (2 * n_used + 1) / 24.0 - tt / 48.0) as z from ws)"""


@query("i4_signed_rank", "metric n_used:i w_plus:2 statistic:2 p_wilcoxon:6",
       ctes(EV, TR, BEH, BEHLONG, _WSR) + f"select metric, n_used, w_plus, statistic, {normal_p('z')} as p_wilcoxon from wz")
def _(spark, d):
    return r.signed_rank(behaviour_differences(spark, d), ["metric"], "difference")


@query("i4_signed_rank_exact", "channel:i n_used:i w_plus:2 p_wilcoxon:6 is_exact")
def _(spark, d):
    # region means as units give at most 25 differences per channel
    li = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    side = lambda c: F.avg(F.when(F.col("l_returnflag") == c, F.col("l_extendedprice")))
    diff = li.groupBy(F.col("l_linenumber").alias("channel"), "s_nationkey").agg((side("A") - side("R")).alias("difference"))
    return r.signed_rank(diff, ["channel"], "difference")


@query("i5_paired_effects", "metric n:i mean:6 ci95_low:5 ci95_high:5 dz:6 direction_fraction:6 p_t:6 p_wilcoxon:6 ci90_low:5 ci90_high:5 equivalence_bound:5 equivalent bootstrap_ci95_low:6 bootstrap_ci95_high:6")
def _(spark, d):
    diffs = behaviour_differences(spark, d)
    return r.paired_effects(diffs, ["metric"], "difference", "unit", 20260924, DRAWS)


#: bootstrap replicates as the protocol states them
DRAWS, CORRELATION_DRAWS = 20_000, 10_000


def _draws(source: str, key: str, seed, reps: int, columns: str) -> str:
    return f"""ix as (select {key}, {columns}, row_number() over (partition by {key} order by unit) as idx from {source}),
sz as (select {key}, count(*) as n from ix group by {key}),
rp as (select {key}, n, rep, {draw_base(str(seed), key, 'rep', '0')} as base from sz, range(0, {reps}) t(rep)),
dr as (select {key}, rep, {position('base', 'turn', 'n')} as idx from (select {key}, n, rep, base, unnest(range(1, n + 1)) as turn from rp)),
boot as (select dr.{key}, rep, {columns} from dr join ix on ix.{key} = dr.{key} and ix.idx = dr.idx)"""


@query("i6_bootstrap_mean", "metric ci_low:6 ci_high:6 n_replicates:i",
       ctes(EV, TR, BEH, BEHLONG, "src as (select metric, unit, difference from behdiff where difference is not null)", _draws("src", "metric", 20261106, DRAWS, "difference"))
       + """, m as (select metric, rep, avg(difference) as m from boot group by all)
       select metric, quantile_cont(m, 0.025) as ci_low, quantile_cont(m, 0.975) as ci_high, count(*) as n_replicates from m group by metric""")
def _(spark, d):
    return r.bootstrap_mean(behaviour_differences(spark, d), ["metric"], "unit", "difference", 20261106, DRAWS)


@query("i6_mean_interval_report", "dataset n:i mean:6 median:6 skewness:6 fraction_below_zero:6 ci_low:6 ci_high:6",
       ctes(PR, LOSS, """src as (select dataset, unit, max(case when model = 'extended' then loss end) - max(case when model = 'base' then loss end) as delta
         from loss where outcome = 'amount' group by dataset, unit)""", _draws("src", "dataset", 20261107, CORRELATION_DRAWS, "delta"))
       + """, m as (select dataset, rep, avg(delta) as m from boot group by all),
       q as (select dataset, quantile_cont(m, 0.025) as ci_low, quantile_cont(m, 0.975) as ci_high from m group by dataset)
       select dataset, count(*) as n, avg(delta) as mean, quantile_cont(delta, 0.5) as median, skewness(delta) as skewness, avg((delta < 0)::int) as fraction_below_zero,
         any_value(ci_low) as ci_low, any_value(ci_high) as ci_high from src join q using (dataset) group by dataset""")
def _(spark, d):
    wide = cut_lineage(r.loss_increments(losses(spark, d).filter("outcome = 'amount'"), ["dataset"], "unit"))
    return r.mean_interval_report(wide, ["dataset"], "unit", "delta", 20261107, CORRELATION_DRAWS)


def user_summary(spark, d):
    """Per user: coherence of a phase, accuracy, median time, one row per user."""
    f = features(spark, d)
    base = f.groupBy("unit").agg(
        F.hypot(F.avg(F.cos("m36")), F.avg(F.sin("m36"))).alias("itpc40"), F.hypot(F.avg(F.cos(F.col("m36") * 2)), F.avg(F.sin(F.col("m36") * 2))).alias("itpc36"),
        F.avg(F.col("correct").cast("double")).alias("accuracy"), F.avg("rt").alias("mean_rt"))
    return base.withColumn("cohort", F.lit("all"))


_US = """us as (select unit, 'all' as cohort, sqrt(power(avg(cos(m36)), 2) + power(avg(sin(m36)), 2)) as itpc40, sqrt(power(avg(cos(m36 * 2)), 2) + power(avg(sin(m36 * 2)), 2)) as itpc36,
  avg(correct) as accuracy, avg(rt) as mean_rt from ft group by unit)"""


@query("i7_bootstrap_spearman", "cohort n:i rho:6 n_finite:i ci_low:6 ci_high:6",
       ctes(EV, FT, _US, _draws("us", "cohort", 20260923, CORRELATION_DRAWS, "round(itpc40, 9) as x, round(accuracy, 9) as y").replace("rep, round(itpc40, 9) as x, round(accuracy, 9) as y from dr", "rep, x, y from dr"))
       + f""", rb as (select cohort, rep, {average_rank('x', 'cohort, rep')} as rx, {average_rank('y', 'cohort, rep')} as ry from boot),
       cb as (select cohort, rep, corr(rx, ry) as c from rb group by all),
       r0 as (select cohort, {average_rank('round(itpc40, 9)', 'cohort')} as rx, {average_rank('round(accuracy, 9)', 'cohort')} as ry from us)
       select cohort, (select count(*) from us) as n, (select corr(rx, ry) from r0) as rho, count(c) as n_finite, quantile_cont(c, 0.025) as ci_low, quantile_cont(c, 0.975) as ci_high from cb group by cohort""")
def _(spark, d):
    u = cut_lineage(user_summary(spark, d).withColumn("x", F.round("itpc40", 9)).withColumn("y", F.round("accuracy", 9)))
    return r.bootstrap_spearman(u, ["cohort"], "unit", "x", "y", 20260923, CORRELATION_DRAWS)


def half_values(spark, d):
    """Mean measure of odd and even trials per user and condition."""
    halves = odd_even_by_position(trials(spark, d), ["unit", "condition"], ["ts", "event_id"])
    side = lambda h: F.round(F.avg(F.when(F.col("half") == h, F.col("y"))), 9)
    return halves.groupBy("unit", "condition").agg(side("odd").alias("odd"), side("even").alias("even"))


_HV = """hv0 as (select unit, condition, y, row_number() over (partition by unit, condition order by ts, event_id) % 2 as h from tr),
hv as (select unit, condition, round(avg(case when h = 1 then y end), 9) as odd, round(avg(case when h = 0 then y end), 9) as even from hv0 group by all)"""


@query("i8_bootstrap_split_half", "condition n:i rho:6 spearman_brown:6 ci_low:6 ci_high:6",
       ctes(EV, TR, _HV, "src as (select * from hv where odd is not null and even is not null)", _draws("src", "condition", 20261206, DRAWS, "odd, even"))
       + f""", rb as (select condition, rep, {average_rank('odd', 'condition, rep')} as rx, {average_rank('even', 'condition, rep')} as ry from boot),
       cb as (select condition, rep, corr(rx, ry) as c from rb group by all),
       q as (select condition, quantile_cont(case when c > -1 then 2 * c / (1 + c) end, 0.025) as ci_low, quantile_cont(case when c > -1 then 2 * c / (1 + c) end, 0.975) as ci_high from cb group by condition),
       r0 as (select condition, {average_rank('odd', 'condition')} as rx, {average_rank('even', 'condition')} as ry from src),
       p as (select condition, count(*) as n, corr(rx, ry) as rho from r0 group by condition)
       select condition, n, rho, 2 * rho / (1 + rho) as spearman_brown, ci_low, ci_high from p join q using (condition)""")
def _(spark, d):
    return r.bootstrap_split_half(cut_lineage(half_values(spark, d)), ["condition"], "unit", "odd", "even", 20261206, DRAWS)


#: replicates as the protocol states them
FLIPS, REPS = 100_000, 10_000
_FLIP = f"""ob as (select metric, count(*) as n, avg(difference) as observed from src group by metric),
{sign_bits('20261105', 'src', FLIPS)},
nu0 as (select metric, b * 32 + j as rep, avg({signed('difference')}) as m from src join bits using (unit), range(0, 32) t(j) where b * 32 + j < {FLIPS} group by all)"""


@query("i9_sign_flip_test", "metric n:i observed:6 null_q025:6 null_q500:6 null_q975:6 p_value:6",
       ctes(EV, TR, BEH, BEHLONG, "src as (select metric, unit, difference from behdiff where difference is not null)", _FLIP)
       + f"""select metric, any_value(n) as n, any_value(observed) as observed, quantile_cont(m, 0.025) as null_q025, quantile_cont(m, 0.5) as null_q500, quantile_cont(m, 0.975) as null_q975,
       (1 + sum((abs(m) >= abs(observed))::int)) / {FLIPS + 1}.0 as p_value from nu0 join ob using (metric) group by metric""")
def _(spark, d):
    return r.sign_flip_test(behaviour_differences(spark, d), ["metric"], "unit", "difference", 20261105, FLIPS)


_SF = f"""{sign_bits('20261103', 'cd', REPS)},
flip as (select metric, channel, -1 as rep, unit, difference as v, difference as raw from cd
  union all select metric, channel, b * 32 + j, unit, {signed('difference')}, difference from cd join bits using (unit), range(0, 32) q(j) where b * 32 + j < {REPS}),
tv as (select metric, channel, rep, count(*) as n, avg(v) / (stddev_samp(v) / sqrt(count(*))) as t from flip group by all)"""


@query("i10_sign_flip_t", "metric channel:i rep:i n:i t:6", ctes(CD, _SF) + "select * from tv")
def _(spark, d):
    return r.sign_flip_t(channel_differences(spark, d), ["metric"], "channel", "unit", "difference", 20261103, REPS)


def _clusters_sql(body: str, alpha: float = 0.05) -> str:
    """Suprathreshold nodes, their components by recursion, and cluster masses."""
    return ctes(
        CD, LE, _SF, "nus as (select n - 1 as nu from tv)", t_critical("nus", {"lim": alpha}),
        "nd as (select metric, rep, sign(t)::int as sg, channel as node, t from tv join crit on crit.nu = n - 1 where abs(t) >= lim)",
        """reach as (select metric, rep, sg, node, node as other from nd
           union select r.metric, r.rep, r.sg, r.node, x.node from reach r join le on le.a = r.other join nd x on x.metric = r.metric and x.rep = r.rep and x.sg = r.sg and x.node = le.b)""",
        "comp as (select metric, rep, sg, node, min(other) as component from reach group by all)",
        "cl as (select metric, rep, sg, component, sum(abs(t)) as mass, count(*) as nch, string_agg(cast(node as varchar), ';' order by cast(node as varchar)) as channels from nd join comp using (metric, rep, sg, node) group by all)",
        recursive=True) + body


@query("i11_threshold_clusters", "metric rep:i sign:i component:i n_channels:i cluster_mass:6",
       _clusters_sql("select metric, rep, sg as sign, component, nch as n_channels, mass as cluster_mass from cl"))
def _(spark, d):
    t = r.sign_flip_t(channel_differences(spark, d), ["metric"], "channel", "unit", "difference", 20261103, REPS)
    members = r.threshold_clusters(t, line_edges(spark, d), ["metric", "rep"], "channel", 0.05)
    return members.groupBy("metric", "rep", "sign", "component").agg(F.count(F.lit(1)).alias("n_channels"), F.sum(F.abs("t")).alias("cluster_mass"))


_CG = """nodes as (select distinct l_suppkey as node from lineitem),
pairs as (select distinct l_orderkey, l_suppkey from lineitem),
ed as (select distinct p.l_suppkey as a, q.l_suppkey as b from pairs p join pairs q on p.l_orderkey = q.l_orderkey and p.l_suppkey <> q.l_suppkey)"""


@query("i12_connected_components", "node:i component:i",
       ctes(_CG, "reach as (select node, node as other from nodes union select r.node, ed.b from reach r join ed on ed.a = r.other)", recursive=True)
       + "select node, min(other) as component from reach group by node")
def _(spark, d):
    # an order links its suppliers in a chain by key order: same components, no pair per group
    from mensura.operators.ordering import running

    big = table(spark, d, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("node")).distinct()
    chain = running(big, ["l_orderkey"], ["node"], {"_prev": ("before", F.col("node"))}).filter("_prev is not null")
    one = chain.select(F.lit(0).alias("g"), F.col("_prev").alias("a"), F.col("node").alias("b"))
    edges = one.unionByName(one.select("g", F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    nodes = big.select(F.lit(0).alias("g"), "node").distinct()
    return connected_components(nodes, edges, ["g"], "node")


def clusters(spark, d, alpha: float = 0.6):
    return r.cluster_permutation(
        cut_lineage(channel_differences(spark, d)), line_edges(spark, d), ["metric"], "channel", "unit", "difference", 20261103, REPS, alpha)


CLUSTER_TABLE = f""", nm as (select metric, rep, max(mass) as mx from cl where rep >= 0 group by all),
pv as (select cl.metric, cl.sg as sign, cl.channels, cl.nch as n_channels, cl.mass as cluster_mass, (1 + sum(coalesce((mx >= cl.mass * (1 - 1e-12))::int, 0))) / {REPS + 1}.0 as p_value
  from cl left join nm on nm.metric = cl.metric where cl.rep = -1 group by all),
clusters as (select *, row_number() over (partition by metric order by cluster_mass desc, channels) as cluster_id from pv)"""


@query("i13_cluster_permutation", "metric cluster_id:i sign:i channels n_channels:i cluster_mass:6 p_value:6",
       _clusters_sql(CLUSTER_TABLE + " select * from clusters", 0.6))
def _(spark, d):
    return clusters(spark, d)


@query("i14_split_half_table", "condition n:i rho:6 spearman_brown:6 p_value:6",
       ctes(EV, TR, _HV, f"""rr as (select condition, {average_rank('odd', 'condition')} as rx, {average_rank('even', 'condition')} as ry from hv where odd is not null and even is not null),
         c as (select condition, count(*) as n, corr(rx, ry) as rho from rr group by condition)""") + f"select condition, n, rho, 2 * rho / (1 + rho) as spearman_brown, {t_p('rho * sqrt((n - 2) / (1 - rho * rho))', '(n - 2)')} as p_value from c")
def _(spark, d):
    return r.split_half_table(cut_lineage(half_values(spark, d)), ["condition"], "odd", "even")


_ASSOC = """al as (select unit, 'itpc40' as neural, itpc40 as x, 'accuracy' as outcome, accuracy as y from us union all select unit, 'itpc40', itpc40, 'mean_rt', mean_rt from us
  union all select unit, 'itpc36', itpc36, 'accuracy', accuracy from us union all select unit, 'itpc36', itpc36, 'mean_rt', mean_rt from us)"""


@query("i15_association_table", "neural outcome n:i rho:6 p_value:6 q_value:6",
       ctes(EV, FT, _US, _ASSOC, f"""rk as (select neural, outcome, {average_rank('round(x, 9)', 'neural, outcome')} as rx, {average_rank('round(y, 9)', 'neural, outcome')} as ry from al),
         c as (select neural, outcome, count(*) as n, corr(rx, ry) as rho from rk group by all), p as (select *, {t_p('rho * sqrt((n - 2) / (1 - rho * rho))', '(n - 2)')} as p_value from c),
         o as (select *, row_number() over (order by p_value) as i, count(*) over () as m from p)""")
       + "select *, least(1.0, min(p_value * m / i) over (order by i desc rows unbounded preceding)) as q_value from o")
def _(spark, d):
    u = cut_lineage(user_summary(spark, d))
    pair = lambda n, o: F.struct(F.lit(n).alias("neural"), F.lit(o).alias("outcome"), F.round(n, 9).alias("x"), F.round(o, 9).alias("y"))
    long = u.select("unit", F.explode(F.array(*[pair(n, o) for n in ("itpc40", "itpc36") for o in ("accuracy", "mean_rt")])).alias("p")).select("unit", "p.*")
    out = cut_lineage(spearman(long, ["neural", "outcome"], "x", "y").withColumn("p_value", correlation_p("rho")).withColumn("family", F.lit("all")))
    return benjamini_hochberg(out, ["family"], "p_value", "q_value")


@query("i16_subset_correlations", "subset outcome n:i pearson_r:6 pearson_p:6 spearman_rho:6 spearman_p:6 pearson_q:6 spearman_q:6",
       ctes(RUNS) + f""", u as (select unit, c_mktsegment as seg, round(avg(metric), 9) as x, round(sum(hits) / sum(n_valid)::double, 9) as a, round(sum(false_alarms) / sum(n_valid)::double, 9) as b from runs join customer on c_custkey = unit where freq = 40 group by all),
       s as (select 'all' as subset, * from u union all select 'BUILDING', * from u where seg = 'BUILDING'),
       l as (select subset, 'hit_rate' as outcome, x, a as y from s union all select subset, 'fa_rate', x, b from s),
       k as (select *, {average_rank('x', 'subset, outcome')} as rx, {average_rank('y', 'subset, outcome')} as ry from l where x is not null and y is not null),
       c as (select subset, outcome, count(*) as n, corr(x, y) as pearson_r, corr(rx, ry) as spearman_rho from k group by all),
       p as (select *, {t_p('pearson_r * sqrt((n - 2) / (1 - pearson_r * pearson_r))', '(n - 2)')} as pearson_p, {t_p('spearman_rho * sqrt((n - 2) / (1 - spearman_rho * spearman_rho))', '(n - 2)')} as spearman_p from c),
       o as (select *, row_number() over (order by pearson_p) as i, row_number() over (order by spearman_p) as j, count(*) over () as m from p)
       select *, least(1.0, min(pearson_p * m / i) over (order by i desc rows unbounded preceding)) as pearson_q, least(1.0, min(spearman_p * m / j) over (order by j desc rows unbounded preceding)) as spearman_q from o""")
def _(spark, d):
    rate = lambda c: F.round(F.sum(c) / F.sum("n_valid"), 9)
    people = table(spark, d, "customer").select(F.col("c_custkey").alias("unit"), F.col("c_mktsegment").alias("seg"))
    u = runs(spark, d).filter("freq = 40").groupBy("unit").agg(F.round(F.avg("metric"), 9).alias("x"), rate("hits").alias("hit_rate"), rate("false_alarms").alias("fa_rate")).join(people, "unit")
    from mensura.operators.guards import restricted_variants

    subsets = restricted_variants(u, {"all": F.lit(True), "BUILDING": F.col("seg") == "BUILDING"}).withColumnRenamed("variant", "subset")
    long = cut_lineage(subsets.unpivot(["subset", "unit", "x"], ["hit_rate", "fa_rate"], "outcome", "y"))
    keys = ["subset", "outcome"]
    linear = pearson(long, keys, "x", "y").withColumnRenamed("r", "pearson_r")
    rank = spearman(long, keys, "x", "y").withColumnRenamed("rho", "spearman_rho").drop("n")
    both = linear.join(rank, keys).withColumn("pearson_p", correlation_p("pearson_r")).withColumn("spearman_p", correlation_p("spearman_rho")).withColumn("family", F.lit("all"))
    both = cut_lineage(both)
    return benjamini_hochberg(cut_lineage(benjamini_hochberg(both, ["family"], "pearson_p", "pearson_q")), ["family"], "spearman_p", "spearman_q")


AUDIT = f"""inc as (select dataset, outcome, unit, max(case when model = 'base' then loss end) as base, max(case when model = 'extended' then loss end) as ext from loss group by all),
de as (select *, ext - base as delta from inc),
{sign_bits('20261105', 'de', REPS)},
nul as (select dataset, outcome, b * 32 + j as rep, avg({signed('delta')}) as m from de join bits using (unit), range(0, 32) q(j) where b * 32 + j < {REPS} group by all),
oo as (select dataset, outcome, count(*) as n, avg(base) as mean_base, avg(ext) as mean_extended, avg(delta) as observed, quantile_cont(delta, 0.5) as median_delta,
  quantile_cont(delta, 0.75) - quantile_cont(delta, 0.25) as iqr_delta, avg((delta < 0)::int) as fraction_improved,
  (sum(delta) - max(delta)) / (count(*) - 1) as loo_min, (sum(delta) - min(delta)) / (count(*) - 1) as loo_max from de group by all),
audit as (select oo.*, nn.* exclude (dataset, outcome) from oo join (select nul.dataset, nul.outcome, quantile_cont(m, 0.025) as null_q025, quantile_cont(m, 0.5) as null_q500, quantile_cont(m, 0.975) as null_q975,
  (1 + sum((abs(m) >= abs(observed))::int)) / {REPS + 1}.0 as p_value from nul join oo on oo.dataset = nul.dataset and oo.outcome = nul.outcome group by all) nn on nn.dataset = oo.dataset and nn.outcome = oo.outcome)"""


@query("i17_loss_audit", "dataset outcome n:i mean_base:6 mean_extended:6 observed:6 null_q025:6 null_q500:6 null_q975:6 p_value:6 median_delta:6 iqr_delta:6 fraction_improved:6 loo_min:6 loo_max:6",
       ctes(PR, LOSS, AUDIT) + "select * from audit")
def _(spark, d):
    return r.loss_audit(cut_lineage(losses(spark, d)), ["dataset", "outcome"], "unit", 20261105, REPS)


@query("i18_behaviour_reliability", "measure n:i rho:6 spearman_brown:6",
       ctes(EV, FT) + f""", h as (select unit, correct, rt, row_number() over (partition by unit, trial_type order by ts, event_id) % 2 as hf from ft),
       v as (select unit, round(avg(case when hf = 1 then correct end), 9) as a1, round(avg(case when hf = 0 then correct end), 9) as a2, round(avg(case when hf = 1 then rt end), 9) as r1, round(avg(case when hf = 0 then rt end), 9) as r2 from h group by unit),
       l as (select 'accuracy' as measure, a1 as x, a2 as y from v union all select 'rt', r1, r2 from v),
       k as (select measure, {average_rank('x', 'measure')} as rx, {average_rank('y', 'measure')} as ry from l)
       select measure, count(*) as n, corr(rx, ry) as rho, 2 * corr(rx, ry) / (1 + corr(rx, ry)) as spearman_brown from k group by measure""")
def _(spark, d):
    halves = odd_even_by_position(features(spark, d), ["unit", "trial_type"], ["ts", "event_id"])
    side = lambda c, h: F.round(F.avg(F.when(F.col("half") == h, F.col(c))), 9)
    v = halves.groupBy("unit").agg(side("correct", "odd").alias("a1"), side("correct", "even").alias("a2"), side("rt", "odd").alias("r1"), side("rt", "even").alias("r2"))
    pair = lambda m, x, y: F.struct(F.lit(m).alias("measure"), F.col(x).alias("x"), F.col(y).alias("y"))
    long = cut_lineage(v.select("unit", F.explode(F.array(pair("accuracy", "a1", "a2"), pair("rt", "r1", "r2"))).alias("p")).select("unit", "p.*"))
    return spearman(long, ["measure"], "x", "y").withColumn("spearman_brown", spearman_brown("rho"))


@query("i19_partial_spearman", "c_mktsegment n:i partial_rho:6",
       f"""with x as (select c_mktsegment, c_custkey, c_acctbal as z, round(sum(o_totalprice), 2) as a, round(max(o_totalprice), 2) as b from customer join orders on o_custkey = c_custkey group by all),
       k as (select c_mktsegment, {average_rank('z', 'c_mktsegment')} as rz, {average_rank('a', 'c_mktsegment')} as ra, {average_rank('b', 'c_mktsegment')} as rb from x)
       select c_mktsegment, count(*) as n, (corr(ra, rb) - corr(ra, rz) * corr(rb, rz)) / sqrt((1 - power(corr(ra, rz), 2)) * (1 - power(corr(rb, rz), 2))) as partial_rho from k group by all""")
def _(spark, d):
    x = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.round(F.sum("o_totalprice"), 2).alias("a"), F.round(F.max("o_totalprice"), 2).alias("b"))
    x = cut_lineage(x.join(table(spark, d, "customer"), "c_custkey").select("c_mktsegment", F.col("c_acctbal").alias("z"), "a", "b"))
    return partial_spearman(x, ["c_mktsegment"], "a", "b", ["z"])
