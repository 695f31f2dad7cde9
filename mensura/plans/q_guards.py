"""Projections, filters, predicates and guards (P rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from mensura.functions.scalar import normalise_trigger, one_of, safe_ratio
from mensura.operators import guards as g
from mensura.plans.bindings import CM, EV, FT, LE, LOG, PR, RUNS, TR, channel_metrics, event_log, events, features, line_edges, predictions, runs, trials
from mensura.plans.registry import query, table
from mensura.plans.sqltext import ctes


@query("p1_usable_trials", "unit:i event_id:i",
       ctes(EV, TR) + "select unit, event_id from tr where coalesce(usable, false) and coalesce(usable_strict, false)")
def _(spark, d):
    return g.usable_trials(trials(spark, d), "usable", "usable_strict")


@query("p2_membership_flag", "event_id:i target:i",
       ctes(EV) + "select event_id, (event_type in ('click', 'purchase'))::int as target from ev")
def _(spark, d):
    return events(spark, d).withColumn("target", g.membership("event_type", ["click", "purchase"]))


@query("p3_complete_cases", "unit:i event_id:i rt_ms:4",
       ctes(EV, TR) + "select * from tr where rt_ms is not null and usable is not null")
def _(spark, d):
    return g.complete_cases(trials(spark, d), ["rt_ms", "usable"])


@query("p4_correct_with_rt", "unit:i event_id:i rt_ms:4", ctes(EV, TR) + "select * from tr where correct and rt_ms > 0")
def _(spark, d):
    return trials(spark, d).filter(g.correct_with_rt("correct", "rt_ms"))


@query("p5_two_level_region", "channel:i region n:i",
       "select l_linenumber as channel, case when l_linenumber in (1, 2, 3) then 'front' else 'back' end as region, count(*) as n from lineitem group by all")
def _(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_linenumber").alias("channel"))
    return li.withColumn("region", g.two_level("channel", [1, 2, 3], "front", "back")).groupBy("channel", "region").agg(F.count(F.lit(1)).alias("n"))


@query("p6_label_recode", "model n:i",
       "select case o_orderstatus when 'F' then 'base' when 'O' then 'extended' else o_orderstatus end as model, count(*) as n from orders group by all")
def _(spark, d):
    recoded = one_of("o_orderstatus", {"F": "base", "O": "extended"}, F.col("o_orderstatus"))
    return table(spark, d, "orders").groupBy(recoded.alias("model")).agg(F.count(F.lit(1)).alias("n"))


@query("p7_common_schema", "dataset outcome unit model observed:6 predicted:6",
       "select 'orders' as dataset, 'price' as outcome, cast(o_custkey as varchar) as unit, 'base' as model, o_totalprice as observed, 250000.0 as predicted from orders")
def _(spark, d):
    return table(spark, d, "orders").select(
        F.lit("orders").alias("dataset"), F.lit("price").alias("outcome"), F.col("o_custkey").cast("string").alias("unit"),
        F.lit("base").alias("model"), F.col("o_totalprice").alias("observed"), F.lit(250000.0).alias("predicted"),
    )


@query("p8_suffixed_measures", "unit:i run n_valid_40:i metric_40:6",
       ctes(RUNS) + "select unit, run, n_valid as n_valid_40, metric as metric_40 from runs where freq = 40")
def _(spark, d):
    return g.suffix_columns(runs(spark, d).filter("freq = 40").select("unit", "run", "n_valid", "metric"), ["n_valid", "metric"], "40")


@query("p9_single_row", "n_name n_regionkey:i n_customers:i",
       "select n_name, n_regionkey, count(*) as n_customers from nation join customer on c_nationkey = n_nationkey where n_nationkey = 7 group by all")
def _(spark, d):
    counts = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("n_customers"))
    named = counts.join(table(spark, d, "nation"), "n_nationkey").withColumn("home", F.col("n_nationkey") == 7)
    return g.single_row(named, home=True)


@query("p10_cohort_mismatch", "unit:i in_observed in_expected",
       """select c_custkey as unit, false as in_observed, true as in_expected from customer
          where c_custkey not in (select o_custkey from orders where o_orderstatus = 'P')""")
def _(spark, d):
    segments = [r[0] for r in table(spark, d, "customer").select("c_mktsegment").distinct().collect()]
    g.is_locked("BUILDING", segments)  # the cohort must be one the table knows
    observed = table(spark, d, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("unit"))
    return g.id_mismatch(observed, table(spark, d, "customer").select(F.col("c_custkey").alias("unit")), "unit")


@query("p11_incomplete_pairs", "unit:i n_conditions:i",
       ctes(RUNS) + "select unit, count(distinct freq) as n_conditions from runs group by unit having count(distinct freq) <> 2")
def _(spark, d):
    return g.incomplete_pairs(runs(spark, d), "unit", "freq")


@query("p12_low_support", "unit:i freq:i n_items:i",
       ctes(RUNS) + "select unit, freq, count(distinct run) as n_items from runs group by all having count(distinct run) < 3")
def _(spark, d):
    return g.low_support(runs(spark, d), ["unit", "freq"], "run", 3)


@query("p13_wrong_counts", "unit:i model n_rows:i",
       ctes(PR) + "select unit, model, count(*) as n_rows from pr where outcome = 'amount' group by all having count(*) <> 10")
def _(spark, d):
    return g.wrong_counts(predictions(spark, d).filter("outcome = 'amount'"), ["unit", "model"], 10)


@query("p14_family_report", "n_rows:i n_keys:i n_duplicated:i",
       """select sum(c) as n_rows, count(*) as n_keys, sum((c > 1)::int) as n_duplicated
          from (select l_orderkey, l_linenumber, count(*) as c from lineitem group by all)""")
def _(spark, d):
    return g.family_report(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("p15_clean_schema", "unit:i channel:i n_trials:i", ctes(CM) + "select unit, channel, sum(n_trials) as n_trials from cm group by all")
def _(spark, d):
    out = channel_metrics(spark, d).groupBy("unit", "channel").agg(F.sum("n_trials").alias("n_trials"))
    return g.require_clean_schema(out, ["itpc", "snr", "accuracy", "p_value"], {"status": "development"})


@query("p16_sequence_mask", "event_type known:i n:i",
       ctes(EV) + """select event_type, (event_type in ('click', 'view') and nullif(k, 5) is not null)::int as known, count(*) as n from ev group by all""")
def _(spark, d):
    ev = events(spark, d).withColumn("mark", F.nullif(F.col("k"), F.lit(5)))
    return ev.groupBy("event_type", g.sequence_known(["click", "view"], "event_type", "mark").cast("int").alias("known")).agg(F.count(F.lit(1)).alias("n"))


@query("p17_low_byte_code", "code:i n:i", ctes(EV, LOG) + "select code & 255 as code, count(*) as n from elog group by all")
def _(spark, d):
    return event_log(spark, d).groupBy(normalise_trigger("code").alias("code")).agg(F.count(F.lit(1)).alias("n"))


@query("p18_snr_reading", "event_type reading n:i",
       ctes(EV) + """select event_type, case when value < 3.0 then 'descriptive_only_low_frequency_1f_boundary'
         when event_type = 'view' then 'same_analysis_frequency_readout_not_stimulus_frequency_specificity'
         else 'primary_frequency_specificity_check' end as reading, count(*) as n from ev group by all""")
def _(spark, d):
    ev = events(spark, d)
    return ev.groupBy("event_type", g.snr_reading("event_type", "value", "view").alias("reading")).agg(F.count(F.lit(1)).alias("n"))


@query("p19_target_frequency", "event_id:i target:6",
       ctes(EV) + """select event_id, case event_type when 'signup' then 2.0 when 'click' then 1.33 * k when 'view' then 1.33 * k
         when 'purchase' then k end as target from ev""")
def _(spark, d):
    ev = events(spark, d).withColumn("rate", F.col("k").cast("double"))
    return ev.withColumn("target", g.target_frequency("event_type", "rate", {"signup": 2.0}, {"click": 1.33, "view": 1.33, "purchase": 1.0}))


@query("p20_plausible_range", "unit:i event_id:i plausible",
       ctes(EV, TR) + "select unit, event_id, coalesce(rt_ms between 100 and 2000, false) as plausible from tr")
def _(spark, d):
    return trials(spark, d).withColumn("plausible", g.plausible_range("rt_ms"))


@query("p21_technical_usability", "unit:i usable reason",
       ctes(RUNS) + """, w as (select unit, sum(case when freq = 27 then n_valid end) as n27, sum(case when freq = 40 then n_valid end) as n40,
         max(case when freq = 27 then metric end) as m27 from runs group by unit)
       select unit, coalesce(n27 >= 3, false) and coalesce(n40 >= 3, false) and m27 is not null as usable,
         case when coalesce(n27 >= 3, false) and coalesce(n40 >= 3, false) and m27 is not null then '' else 'too_few_valid_trials_or_missing_metric' end as reason from w""")
def _(spark, d):
    level = lambda f, e: F.when(F.col("freq") == f, e)
    wide = runs(spark, d).groupBy("unit").agg(
        F.sum(level(27, F.col("n_valid"))).alias("n27"), F.sum(level(40, F.col("n_valid"))).alias("n40"), F.max(level(27, F.col("metric"))).alias("m27"))
    ok, reason = g.technical_usability(["n27", "n40"], ["m27"], 3)
    return wide.withColumn("usable", ok).withColumn("reason", reason)


@query("p22_safe_ratio", "unit:i rate:6",
       ctes(RUNS) + """select unit, sum(false_alarms) / nullif(sum(false_alarms) + sum(correct_rejections), 0)::double as rate from runs where freq = 40 group by unit""")
def _(spark, d):
    s = runs(spark, d).filter("freq = 40").groupBy("unit").agg(F.sum("false_alarms").alias("fa"), F.sum("correct_rejections").alias("cr"))
    return s.withColumn("rate", safe_ratio("fa", F.col("fa") + F.col("cr")))


@query("p23_edge_violations", "rule a b",
       """with e as (select l_linenumber as a, (l_orderkey % 7 + 1)::int as b from lineitem)
       select 'self_edge' as rule, cast(a as varchar) as a, cast(b as varchar) as b from e where a = b
       union all select 'not_canonical', cast(a as varchar), cast(b as varchar) from e where a > b
       union all select 'repeated', cast(a as varchar), cast(b as varchar) from e group by a, b having count(*) > 1
       union all select 'low_degree', cast(node as varchar), null from (select a as node, b as o from e union all select b, a from e) group by node having count(distinct o) < 7""")
def _(spark, d):
    edges = table(spark, d, "lineitem").select(F.col("l_linenumber").alias("x"), (F.col("l_orderkey") % 7 + 1).cast("int").alias("y"))
    return g.edge_violations(edges, "x", "y", 7)


@query("p24_restriction_variants", "variant n:i mean_balance:4",
       """with v as (select 'all' as variant, c_acctbal from customer union all
         select 'positive', c_acctbal from customer where c_acctbal > 0 union all
         select 'building', c_acctbal from customer where c_mktsegment = 'BUILDING' union all
         select 'both', c_acctbal from customer where c_acctbal > 0 and c_mktsegment = 'BUILDING')
       select variant, count(*) as n, avg(c_acctbal) as mean_balance from v group by all""")
def _(spark, d):
    positive, building = F.col("c_acctbal") > 0, F.col("c_mktsegment") == "BUILDING"
    spread = g.restricted_variants(table(spark, d, "customer"), {
        "all": F.lit(True), "positive": positive, "building": building, "both": positive & building})
    return spread.groupBy("variant").agg(F.count(F.lit(1)).alias("n"), F.avg("c_acctbal").alias("mean_balance"))
