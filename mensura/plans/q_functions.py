"""Scalar functions (F rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from mensura.functions import scalar as s
from mensura.functions import special as sp
from mensura.operators.ordering import attach_few, quantile_table
from mensura.operators.windows import robust_z
from mensura.plans.bindings import CM, EV, TR, channel_metrics, events, trials
from mensura.plans.registry import query, table
from mensura.session import cut_lineage
from mensura.plans.sqltext import ctes, normal_p, normal_quantile, t_critical, t_p

_ZCTE = "z as (select c_custkey, c_acctbal / 3000.0 as z from customer)"


@query("f1_normal_tail", "c_custkey:i z:6 p:8", ctes(_ZCTE) + f"select c_custkey, z, {normal_p('z')} as p from z")
def _(spark, d):
    return table(spark, d, "customer").select("c_custkey", (F.col("c_acctbal") / 3000.0).alias("z")).withColumn("p", sp.normal_two_sided_p("z"))


@query("f2_normal_quantile", "p_partkey:i z:6",
       f"with u as (select p_partkey, (p_partkey * 7919 % 10007 + 0.5) / 10008.0 as u from part) select p_partkey, {normal_quantile('u')} as z from u")
def _(spark, d):
    u = (F.col("p_partkey") * 7919 % 10007 + 0.5) / 10008.0
    return table(spark, d, "part").select("p_partkey", sp.normal_quantile(u).alias("z"))


@query("f3_student_tail", "l_suppkey:i n:i t:6 p:8",
       f"""with g as (select l_suppkey, count(*) as n, (avg(l_quantity) - 25.5) / (stddev_samp(l_quantity) / sqrt(count(*))) as t from lineitem group by 1)
       select l_suppkey, n, t, {t_p('t', '(n - 1)')} as p from g""")
def _(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_suppkey").agg(
        F.count(F.lit(1)).alias("n"), ((F.avg("l_quantity") - 25.5) / (F.stddev_samp("l_quantity") / F.sqrt(F.count(F.lit(1))))).alias("t"))
    return g.withColumn("p", sp.t_two_sided_p("t", F.col("n") - 1))


@query("f4_student_quantile", "nu:i t975:6 t95:6",
       ctes("g as (select o_custkey, count(*) - 1 as nu from orders group by 1)", t_critical("g", {"t975": 0.05, "t95": 0.1}), recursive=True) + "select nu, t975, t95 from crit")
def _(spark, d):
    nu = table(spark, d, "orders").groupBy("o_custkey").agg((F.count(F.lit(1)) - 1).alias("nu")).filter("nu > 0").select("nu").distinct()
    return nu.select("nu", sp.t_quantile(0.975, "nu").alias("t975"), sp.t_quantile(0.95, "nu").alias("t95"))


@query("f5_chi_square_tail", "s_suppkey:i p:8", "select s_suppkey, exp(-abs(s_acctbal) / 2000.0) as p from supplier")
def _(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", sp.chi2_two_df_p(F.abs("s_acctbal") / 1000.0).alias("p"))


@query("f6_spearman_brown", "l_linenumber:i r:6 sb:6",
       "with r as (select l_linenumber, corr(l_quantity, l_extendedprice) as r from lineitem group by 1) select l_linenumber, r, case when r > -1 then 2 * r / (1 + r) end as sb from r")
def _(spark, d):
    return table(spark, d, "lineitem").groupBy("l_linenumber").agg(F.corr("l_quantity", "l_extendedprice").alias("r")).withColumn("sb", s.spearman_brown("r"))


@query("f7_log_and_decibel", "event_id:i log_value:6 db:6",
       ctes(EV) + "select event_id, ln(value) as log_value, 10 * log10((value + 1e-30) / (k + 1e-30)) as db from ev where k > 0")
def _(spark, d):
    return events(spark, d).filter("k > 0").select("event_id", s.natural_log("value").alias("log_value"), s.decibel_ratio("value", F.col("k").cast("double")).alias("db"))


@query("f8_clipped_logit", "event_id:i x:6",
       ctes(EV) + "select event_id, ln(q / (1 - q)) as x from (select event_id, greatest(1e-6, least(1 - 1e-6, k / 99.0)) as q from ev)")
def _(spark, d):
    return events(spark, d).select("event_id", s.logit(F.col("k") / 99.0).alias("x"))


@query("f9_angular_distance", "a:i b:i angle:6",
       """with e as (select vec_id, label, list_transform(embedding, lambda x: x::double) as v from embeddings),
       u as (select vec_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) as v from e)
       select p.vec_id as a, q.vec_id as b, acos(greatest(-1.0, least(1.0, list_dot_product(p.v, q.v)))) as angle from u p join u q on q.vec_id = p.vec_id + 1""")
def _(spark, d):
    u = table(spark, d, "embeddings").select("vec_id", s.normalise("embedding").alias("v"))
    right = u.select(F.col("vec_id").alias("b"), (F.col("vec_id") - 1).alias("a"), F.col("v").alias("w"))
    return u.withColumnRenamed("vec_id", "a").join(right, "a").select("a", "b", s.angular_distance("v", "w").alias("angle"))


@query("f10_unit_phase", "event_id:i u:6 v:6",
       ctes(EV) + """, c as (select event_id, value * cos(k) as re, value * sin(k) as im from ev)
       select event_id, re / greatest(sqrt(re * re + im * im), 1e-30) as u, im / greatest(sqrt(re * re + im * im), 1e-30) as v from c""")
def _(spark, d):
    k = F.col("k").cast("double")
    c = events(spark, d).select("event_id", (F.col("value") * F.cos(k)).alias("re"), (F.col("value") * F.sin(k)).alias("im"))
    u, v = s.unit_phase("re", "im")
    return c.select("event_id", u.alias("u"), v.alias("v"))


@query("f11_sample_time", "event_id:i ms:6 back:i",
       ctes(EV) + "select event_id, k * 1000.0 / 512.0 as ms, k as back from ev")
def _(spark, d):
    e = events(spark, d).withColumn("ms", s.samples_to_ms("k", 512.0))
    return e.withColumn("back", s.ms_to_samples("ms", 512.0))


@query("f12_text_functions", "p_partkey:i is_brand1 ends starts label lowered",
       """select p_partkey, regexp_matches(p_brand, '#1[0-9]') as is_brand1, ends_with(p_brand, '3') as ends, starts_with(p_type, 'S') as starts,
          printf('%s:%05.1f', p_brand, p_retailprice) as label, lower(p_type) as lowered from part""")
def _(spark, d):
    return table(spark, d, "part").select(
        "p_partkey", F.col("p_brand").rlike("#1[0-9]").alias("is_brand1"), F.col("p_brand").endswith("3").alias("ends"),
        F.col("p_type").startswith("S").alias("starts"), F.format_string("%s:%05.1f", "p_brand", "p_retailprice").alias("label"), F.lower("p_type").alias("lowered"))


@query("f13_nested_field", "event_id:i k:i", "select event_id, cast(json_extract_string(props, '$.k') as int) as k from events")
def _(spark, d):
    parsed = table(spark, d, "events").select("event_id", F.from_json("props", "k int").alias("p"))
    return parsed.select("event_id", "p.k")


@query("f14_winsorise", "l_orderkey:i l_linenumber:i l_partkey:i price:4",
       """with b as (select l_returnflag, quantile_cont(l_extendedprice, 0.025) as lo, quantile_cont(l_extendedprice, 0.975) as hi from lineitem group by 1)
       select l_orderkey, l_linenumber, l_partkey, greatest(lo, least(hi, l_extendedprice)) as price from lineitem join b using (l_returnflag)""")
def _(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_extendedprice")
    bounds = quantile_table(li, ["l_returnflag"], "l_extendedprice", {"lo": 0.025, "hi": 0.975})
    return attach_few(li, bounds, ["l_returnflag"]).withColumn("price", F.greatest("lo", F.least("hi", "l_extendedprice")))


def flag_channels(metrics, keys):
    """Robust z of four channel measures, then the joined reasons."""
    m = cut_lineage(metrics).withColumn("log_rms", F.log(F.greatest("rms", F.lit(1e-12)))).withColumn("low_r", -F.col("median_r"))
    m = robust_z(m, keys, {c: f"z_{c}" for c in ("log_rms", "line_db", "high_db", "low_r")})
    # Channel flag labels.
    reason = s.reasons(
        (F.col("finite_fraction") < 0.999, "nonfinite"),
        (F.col("rms") < 0.1, "flat"),
        (F.abs("z_log_rms") > 5, "rms_outlier"),
        ((F.col("z_line_db") > 5) & (F.col("line_db") > 3.0), "line_noise_outlier"),
        ((F.col("z_high_db") > 5) & (F.col("high_db") > -3.0), "high_frequency_outlier"),
        ((F.col("z_low_r") > 5) & (F.col("median_r") < 0.2), "low_correlation_outlier"),
    )
    return m.withColumn("reason", reason).withColumn("bad", F.col("reason") != "")


_FLAG = """m0 as (select user_id as channel, avg((value > 0.5)::int) as finite_fraction, sqrt(avg(value * value)) as rms,
  max(value) / 40.0 as line_db, stddev_samp(value) / 10.0 - 5.0 as high_db, avg(value) / 100.0 as median_r from events group by 1),
m1 as (select *, ln(greatest(rms, 1e-12)) as log_rms, -median_r as low_r from m0),
med as (select quantile_cont(log_rms, 0.5) as a, quantile_cont(line_db, 0.5) as b, quantile_cont(high_db, 0.5) as c, quantile_cont(low_r, 0.5) as e from m1),
mad as (select quantile_cont(abs(log_rms - a), 0.5) as ma, quantile_cont(abs(line_db - b), 0.5) as mb, quantile_cont(abs(high_db - c), 0.5) as mc, quantile_cont(abs(low_r - e), 0.5) as me from m1, med),
zz as (select m1.*, 0.67448975 * (log_rms - a) / ma as z1, 0.67448975 * (line_db - b) / mb as z2, 0.67448975 * (high_db - c) / mc as z3, 0.67448975 * (low_r - e) / me as z4 from m1, med, mad)"""


@query("f15_reason_text", "channel:i reason bad",
       ctes(_FLAG) + """, r as (select channel, concat_ws(';', case when finite_fraction < 0.999 then 'nonfinite' end, case when rms < 0.1 then 'flat' end,
         case when abs(z1) > 5 then 'rms_outlier' end, case when z2 > 5 and line_db > 3 then 'line_noise_outlier' end,
         case when z3 > 5 and high_db > -3 then 'high_frequency_outlier' end, case when z4 > 5 and median_r < 0.2 then 'low_correlation_outlier' end) as reason from zz)
       select channel, reason, reason <> '' as bad from r""")
def _(spark, d):
    v = F.col("value")
    m = table(spark, d, "events").groupBy(F.col("user_id").alias("channel")).agg(
        F.avg((v > 0.5).cast("double")).alias("finite_fraction"), F.sqrt(F.avg(v * v)).alias("rms"), (F.max(v) / 40.0).alias("line_db"),
        (F.stddev_samp(v) / 10.0 - 5.0).alias("high_db"), (F.avg(v) / 100.0).alias("median_r"))
    return flag_channels(m, [])
