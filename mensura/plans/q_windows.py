"""Window-type operators (W rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from mensura.operators import windows as w
from mensura.operators.ordering import attach, average_rank, row_index
from mensura.plans.bindings import (
    BEH, BEHLONG, EV, FT, LOG, LOG_CONDITIONS, LOG_CONGRUENT, LOG_RESPONSES, PR, TESTS, TR, TRI, event_log, events, features, indexed_trials,
    predictions, tests_table, trials,
)
from mensura.plans.q_aggregates import LOSS, losses
from mensura.plans.registry import query, table
from mensura.plans.sqltext import average_rank as rank_sql
from mensura.plans.sqltext import ctes


@query("w1_within_unit_zscore", "event_id:i m40_z:6 m36_z:6",
       ctes(EV, FT) + """select event_id, (m40 - avg(m40) over (partition by unit)) / nullif(stddev_samp(m40) over (partition by unit), 0) as m40_z,
       (m36 - avg(m36) over (partition by unit)) / nullif(stddev_samp(m36) over (partition by unit), 0) as m36_z from ft""")
def _(spark, d):
    return w.zscore(features(spark, d), ["unit"], {"m40": "m40_z", "m36": "m36_z"})


@query("w2_cell_centring", "event_id:i centred:6",
       ctes(EV, FT) + "select event_id, m40 - avg(m40) over (partition by unit, trial_type) as centred from ft")
def _(spark, d):
    return w.centre(features(spark, d), ["unit", "trial_type"], "m40", "centred")


@query("w3_trial_order_z", "unit:i event_id:i order_z:6",
       ctes(EV, TR, TRI) + "select unit, event_id, (trial_index - avg(trial_index) over (partition by unit)) / stddev_samp(trial_index) over (partition by unit) as order_z from tri")
def _(spark, d):
    return w.zscore(indexed_trials(spark, d), ["unit"], {"trial_index": "order_z"})


@query("w4_population_z", "c_custkey:i z:6", "select c_custkey, (c_acctbal - avg(c_acctbal) over ()) / stddev_pop(c_acctbal) over () as z from customer")
def _(spark, d):
    return w.zscore(table(spark, d, "customer").select("c_custkey", "c_acctbal"), [], {"c_acctbal": "z"}, population=True)


@query("w5_average_ranks", "l_orderkey:i l_linenumber:i l_partkey:i rank_in_flag:2",
       f"select l_orderkey, l_linenumber, l_partkey, {rank_sql('l_extendedprice', 'l_returnflag')} as rank_in_flag from lineitem")
def _(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_extendedprice")
    return average_rank(li, ["l_returnflag"], "l_extendedprice", "rank_in_flag")


@query("w6_benjamini_hochberg", "family term:i p_value:9 q_value:9",
       ctes(TESTS) + """, r as (select *, row_number() over (partition by family order by p_value) as i, count(p_value) over (partition by family) as n from tests where p_value is not null),
       q as (select family, term, p_value, least(1.0, min(p_value * n / i) over (partition by family order by i desc rows unbounded preceding)) as q_value from r)
       select t.family, t.term, t.p_value, q.q_value from tests t left join q using (family, term)""")
def _(spark, d):
    return w.benjamini_hochberg(tests_table(spark, d), ["family"], "p_value", "q_value")


@query("w7_holm", "family term:i p_value:9 p_holm:9",
       ctes(TESTS) + """, r as (select *, row_number() over (partition by family order by p_value) as i, count(p_value) over (partition by family) as n from tests where p_value is not null),
       q as (select family, term, least(1.0, max(p_value * (n - i + 1)) over (partition by family order by i rows unbounded preceding)) as p_holm from r)
       select t.family, t.term, t.p_value, q.p_holm from tests t left join q using (family, term)""")
def _(spark, d):
    return w.holm(tests_table(spark, d), ["family"], "p_value", "p_holm")


@query("w8_leave_one_out_mean", "c_custkey:i loo:6",
       "select c_custkey, (sum(c_acctbal) over (partition by c_mktsegment) - c_acctbal) / (count(*) over (partition by c_mktsegment) - 1) as loo from customer")
def _(spark, d):
    return w.leave_one_out_mean(table(spark, d, "customer"), ["c_mktsegment"], "c_acctbal", "loo")


@query("w9_leave_one_out_range", "c_mktsegment loo_min:6 loo_max:6",
       """with x as (select c_mktsegment, (sum(c_acctbal) over (partition by c_mktsegment) - c_acctbal) / (count(*) over (partition by c_mktsegment) - 1) as loo from customer)
       select c_mktsegment, min(loo) as loo_min, max(loo) as loo_max from x group by all""")
def _(spark, d):
    return w.leave_one_out_range(table(spark, d, "customer"), ["c_mktsegment"], "c_acctbal")


@query("w10_odd_even_split", "unit:i condition half index_half:i n:i mean_x:6",
       ctes(EV, TR, TRI) + """, s as (select *, case when row_number() over (partition by unit, condition order by ts, event_id) % 2 = 1 then 'odd' else 'even' end as half, trial_index % 2 as index_half from tri)
       select unit, condition, half, index_half, count(*) as n, avg(x) as mean_x from s group by all""")
def _(spark, d):
    s = w.odd_even_by_position(indexed_trials(spark, d), ["unit", "condition"], ["ts", "event_id"]).withColumn("index_half", w.odd_even_by_index("trial_index"))
    return s.groupBy("unit", "condition", "half", "index_half").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean_x"))


@query("w11_time_halves", "unit:i condition half n:i mean_x:6",
       ctes(EV, TR) + """, s as (select *, case when row_number() over (partition by unit, condition order by ts, event_id) <= count(*) over (partition by unit, condition) // 2 then 'first' else 'second' end as half from tr)
       select unit, condition, half, count(*) as n, avg(x) as mean_x from s group by all""")
def _(spark, d):
    s = w.time_halves(trials(spark, d), ["unit", "condition"], ["ts", "event_id"])
    return s.groupBy("unit", "condition", "half").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean_x"))


def reconstructed(spark, d):
    return w.reconstruct_trials(
        event_log(spark, d), "unit", ["sample", "event_id"], "sample", "code", 0.01, LOG_CONDITIONS, LOG_RESPONSES, LOG_CONGRUENT)


RECON = """lg as (select unit, event_id, sample, code & 255 as code, row_number() over (partition by unit order by sample, event_id) as pos from elog),
lg2 as (select *, sum((code in (20, 21, 22))::int) over (partition by unit order by pos rows between unbounded preceding and 1 preceding) as seg0,
  lead(code) over (partition by unit order by pos) as ncode, lead(sample) over (partition by unit order by pos) as nsample from lg),
lg3 as (select *, coalesce(seg0, 0) as seg from lg2),
lg4 as (select *, last_value(case when code in (8, 9) then pos end ignore nulls) over (partition by unit, seg order by pos rows unbounded preceding) as cpos from lg3),
rec0 as (select t.*, c.code as ccode, c.sample as csample,
  case when t.ncode = 43 then 'unsure' when t.ncode = 50 then 'skipped' when t.ncode = t.code + 20 then 'correct' when t.ncode in (40, 41, 42) then 'incorrect' end as label
  from lg4 t left join lg c on c.unit = t.unit and c.pos = t.cpos where t.code in (20, 21, 22)),
rec as (select unit, row_number() over (partition by unit order by pos) as trial_index, ccode as condition_code,
  case ccode when 8 then 'new' when 9 then 'returning' else 'missing' end as condition, csample as stimulation_sample, code as target_code, sample as target_sample,
  case when code in (20, 22) then 'congruent' else 'incongruent' end as congruency, case when label is not null then ncode end as response_code,
  coalesce(label, 'missing_or_unexpected') as response_class, code + 20 as expected_correct_code,
  (sample - csample) * 1000.0 / 0.01 as stimulation_to_target_ms,
  case when label in ('correct', 'incorrect') then (nsample - sample) * 1000.0 / 0.01 end as rt_ms, ccode is not null and label is not null as sequence_valid from rec0)"""


@query("w12_reconstruct_trials", "unit:i trial_index:i condition_code:i condition stimulation_sample:i target_code:i target_sample:i congruency response_code:i response_class expected_correct_code:i stimulation_to_target_ms:3 rt_ms:3 sequence_valid",
       ctes(EV, LOG, RECON) + "select * from rec")
def _(spark, d):
    return reconstructed(spark, d)


ALLOWED = [8, 9, 20, 21, 22, 41, 50]


@query("w13_collapse_overlaps", "unit:i sample:i code:i n:i",
       ctes(EV, LOG) + """, one as (select unit, sample, max(code & 255) as code from elog group by all),
       n0 as (select *, row_number() over (partition by unit order by sample) as pos, lead(sample) over (partition by unit order by sample) - sample as gap,
         lead(code) over (partition by unit order by sample) as ncode, sample - lag(sample) over (partition by unit order by sample) as back from one),
       n1 as (select *, coalesce(gap <= 20000 and ncode in (8, 9, 20, 21, 22, 41, 50), false) as link, coalesce(back <= 20000 and code in (8, 9, 20, 21, 22, 41, 50), false) as linked from n0),
       n2 as (select *, last_value(case when not linked then pos end ignore nulls) over (partition by unit order by pos rows unbounded preceding) as st from n1)
       select unit, sample, case when link then ncode else code end as code, 1 as n from n2 where (pos - st) % 2 = 0 and (link or code in (8, 9, 20, 21, 22, 41, 50))""")
def _(spark, d):
    one = event_log(spark, d).groupBy("unit", "sample").agg(F.max(F.col("code").bitwiseAND(255)).alias("code"))
    return w.collapse_overlaps(one, "unit", "sample", "code", ALLOWED, 20000).withColumn("n", F.lit(1))


@query("w14_robust_z", "event_id:i z:6",
       ctes(EV) + """, c as (select event_type, quantile_cont(value, 0.5) as m from ev group by all),
       s as (select event_type, quantile_cont(abs(value - m), 0.5) as mad from ev join c using (event_type) group by all)
       select event_id, case when mad = 0 then 0.0 else 0.67448975 * (value - m) / mad end as z from ev join c using (event_type) join s using (event_type)""")
def _(spark, d):
    return w.robust_z(events(spark, d), ["event_type"], {"value": "z"})


@query("w15_mass_numbering", "dataset unit:i cluster_id:i",
       ctes(PR, LOSS) + "select dataset, unit, row_number() over (partition by dataset order by -loss, unit) as cluster_id from loss where outcome = 'amount' and model = 'extended'")
def _(spark, d):
    x = losses(spark, d).filter("outcome = 'amount' and model = 'extended'").withColumn("minus", -F.col("loss"))
    return row_index(x, ["dataset"], ["minus", "unit"], "cluster_id")
