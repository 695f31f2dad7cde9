"""Joins (J rows), set operations (U rows) and top-k (O rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from mensura.operators import graph, joins
from mensura.operators.graph import top_k
from mensura.plans.bindings import (
    CD, CM, EV, FT, LE, LOG, PR, RUNS, TR, channel_differences, channel_metrics, event_log, events, features, line_edges,
    predictions, runs, trials,
)
from mensura.plans.bindings import nation_keys
from mensura.plans.registry import query, table
from mensura.plans.sqltext import ctes


def _levels(spark, d, freq):
    part = runs(spark, d).filter(F.col("freq") == freq).groupBy("unit").agg(F.sum("n_valid").alias("n_valid"), F.avg("metric").alias("metric"))
    return part.withColumnsRenamed({"n_valid": f"n_valid_{freq}", "metric": f"metric_{freq}"})


_LV = RUNS + """, l27 as (select unit, sum(n_valid) as n_valid_27, avg(metric) as metric_27 from runs where freq = 27 group by unit),
l40 as (select unit, sum(n_valid) as n_valid_40, avg(metric) as metric_40 from runs where freq = 40 group by unit)"""


@query("j1_one_to_one", "unit:i n_valid_27:i segment",
       ctes(_LV) + "select unit, n_valid_27, c_mktsegment as segment from l27 join customer on unit = c_custkey")
def _(spark, d):
    people = table(spark, d, "customer").select(F.col("c_custkey").alias("unit"), F.col("c_mktsegment").alias("segment"))
    return joins.one_to_one(_levels(spark, d, 27), people, ["unit"])


@query("j2_outer_levels", "unit:i n_valid_27:i metric_27:6 n_valid_40:i metric_40:6",
       ctes(_LV) + "select coalesce(l27.unit, l40.unit) as unit, n_valid_27, metric_27, n_valid_40, metric_40 from l27 full join l40 on l27.unit = l40.unit")
def _(spark, d):
    return joins.outer_levels([_levels(spark, d, 27), _levels(spark, d, 40)], ["unit"])


@query("j3_look_up", "c_custkey:i total:4",
       "select c_custkey, total from customer left join (select o_custkey, sum(o_totalprice) as total from orders where o_orderstatus = 'P' group by 1) on c_custkey = o_custkey")
def _(spark, d):
    totals = table(spark, d, "orders").filter("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum("o_totalprice").alias("total"))
    return joins.look_up(table(spark, d, "customer").select("c_custkey"), totals, ["c_custkey"])


@query("j4_keep_members", "l_suppkey:i n:i",
       "select l_suppkey, count(*) as n from lineitem where l_suppkey in (select s_suppkey from supplier where s_acctbal > 0) group by all")
def _(spark, d):
    members = table(spark, d, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"))
    return joins.keep_members(table(spark, d, "lineitem"), members, ["l_suppkey"]).groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))


@query("j5_hold_out_split", "unit:i n_train:i mean_train:6 n_test:i mean_test:6",
       """with t as (select sum(l_extendedprice) as s, count(*) as c from lineitem)
       select l_suppkey as unit, any_value(t.c) - count(*) as n_train, (any_value(t.s) - sum(l_extendedprice)) / (any_value(t.c) - count(*)) as mean_train,
         count(*) as n_test, avg(l_extendedprice) as mean_test from lineitem, t group by l_suppkey""")
def _(spark, d):
    # the training side is total minus held-out unit, never a copy of the rows per fold
    from mensura.operators.ordering import attach

    price = F.col("l_extendedprice")
    units = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("unit")).agg(F.sum(price).alias("s"), F.count(F.lit(1)).alias("c"))
    total = units.agg(F.sum("s").alias("ts"), F.sum("c").alias("tc"))
    return attach(units, total, []).select(
        "unit", (F.col("tc") - F.col("c")).alias("n_train"), ((F.col("ts") - F.col("s")) / (F.col("tc") - F.col("c"))).alias("mean_train"),
        F.col("c").alias("n_test"), (F.col("s") / F.col("c")).alias("mean_test"))


@query("j6_aligned_columns", "event_id:i value:4 k:i",
       ctes(EV) + "select a.event_id, a.value, b.k from ev a join ev b on a.event_id = b.event_id")
def _(spark, d):
    ev = events(spark, d)
    return joins.one_to_one(ev.select("event_id", "value"), ev.select("event_id", "k"), ["event_id"])


@query("j7_keyed_selection", "source n:i",
       """with wanted as (select distinct o_orderkey + 7 as key from orders where o_orderstatus = 'P')
       select 'selected' as source, count(*) as n from orders where o_orderkey in (select key from wanted)
       union all select 'missing', count(*) from wanted where key not in (select o_orderkey from orders)
       union all select 'repeated', count(*) from (select o_orderkey from orders group by 1 having count(*) > 1)""")
def _(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), "o_orderstatus")
    wanted = orders.filter("o_orderstatus = 'P'").select((F.col("key") + 7).alias("key")).distinct()
    selected, repeated, missing = joins.select_by_key(orders, wanted, ["key"])
    count = lambda df, s: df.agg(F.lit(s).alias("source"), F.count(F.lit(1)).alias("n"))
    return count(selected, "selected").unionByName(count(missing, "missing")).unionByName(count(repeated, "repeated"))


KNN = """emb as (select vec_id as id, list_transform(embedding, lambda v: v::double) as v from embeddings),
unitv as (select id, list_transform(v, lambda e: e / sqrt(list_dot_product(v, v))) as v from emb),
pairs as (select x.id, y.id as other, round(acos(greatest(-1.0, least(1.0, list_dot_product(x.v, y.v)))), 9) as dist
  from unitv x join unitv y on x.id <> y.id),
knn as (select * from (select *, row_number() over (partition by id order by dist, other) as rank from pairs) where rank <= 4),
edges as (select least(id, other) as a, greatest(id, other) as b, min(dist) as dist from knn group by all)"""


def knn(spark, d):
    return graph.nearest_neighbours(table(spark, d, "embeddings"), "vec_id", "embedding", 4, digits=9)


@query("j8_nearest_neighbour_graph", "a:i b:i dist:6", ctes(KNN) + "select * from edges")
def _(spark, d):
    return graph.symmetric_edges(knn(spark, d))


@query("j9_neighbour_values", "channel:i neighbour:i unit:i own:6 other:6",
       ctes(CM, LE) + """, m as (select unit, channel, avg(price) as v from cm group by all)
       select x.channel, y.channel as neighbour, x.unit, x.v as own, y.v as other from m x join le on le.a = x.channel join m y on y.channel = le.b and y.unit = x.unit""")
def _(spark, d):
    m = channel_metrics(spark, d).groupBy("unit", "channel").agg(F.avg("price").alias("v"))
    own = m.select("unit", F.col("channel").alias("a"), F.col("v").alias("own"))
    other = m.select("unit", F.col("channel").alias("b"), F.col("v").alias("other"))
    return own.join(line_edges(spark, d), "a").join(other, ["unit", "b"]).select(
        F.col("a").alias("channel"), F.col("b").alias("neighbour"), "unit", "own", "other")


_NATION = """daily as (select c_nationkey as channel, cast(o_orderdate as date) as s, sum(o_totalprice) / 1000.0 as x
  from orders join customer on o_custkey = c_custkey group by all)"""


def nation_daily(spark, d):
    return table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy(
        F.col("c_nationkey").alias("channel"), F.to_date("o_orderdate").alias("s")).agg((F.sum("o_totalprice") / 1000.0).alias("x"))


ALLPAIRS = _NATION + """, cc as (select p.channel as a, q.channel as b, count(*) as n, case when count(*) >= 3 then corr(p.x, q.x) end as r
  from daily p join daily q on p.s = q.s and p.channel <> q.channel group by all)"""


@query("j10_all_pair_correlations", "a:i b:i n:i r:6", ctes(ALLPAIRS) + "select * from cc")
def _(spark, d):
    return graph.channel_correlations(nation_daily(spark, d), [], "channel", None, "s", "x")


_EPOCH = ctes(EV, LOG) + """, len as (select unit, max(sample) + 1 as n from elog group by unit),
onsets as (select e.unit, e.event_id, sample - 10800 as lo, sample + 14400 as hi, (sample - 10800 >= 0 and sample + 14400 <= n) as within_bounds
  from elog e join len using (unit) where code & 255 in (8, 9))"""


@query("j11_epoch_extraction", "unit:i event_id:i within_bounds n_samples:i first:i last:i",
       _EPOCH + """select o.unit, o.event_id, within_bounds, count(*) as n_samples, min(e.sample - o.lo) as first, max(e.sample - o.lo) as last
       from onsets o join elog e on e.unit = o.unit and e.sample >= o.lo and e.sample < o.hi group by all""")
def _(spark, d):
    log = event_log(spark, d)
    lengths = log.groupBy("unit").agg((F.max("sample") + 1).alias("n"))
    onsets = log.filter(F.col("code").bitwiseAND(255).isin(8, 9)).select("unit", "event_id", F.col("sample").alias("onset"))
    bounded = joins.epoch_bounds(onsets.join(lengths, "unit"), "onset", 10800, 14400, "n").drop("onset", "n")
    inside = joins.windows_join(log.select("unit", "sample"), bounded, ["unit"], "sample", "lo", "hi", 25200)
    return inside.groupBy("unit", "event_id", "within_bounds").agg(
        F.count(F.lit(1)).alias("n_samples"), F.min(F.col("sample") - F.col("lo")).alias("first"), F.max(F.col("sample") - F.col("lo")).alias("last"))


@query("j12_response_windows", "unit:i window_s:2 n_responses:i n_assigned:i n_unassigned:i n_stimuli_answered:i",
       ctes(EV, LOG) + """, r as (select *, last_value(case when code & 255 in (20, 21, 22) then sample end ignore nulls)
           over (partition by unit order by sample, event_id rows between unbounded preceding and 1 preceding) as st from elog),
       w as (select r.*, v.w, coalesce(sample - st <= v.w, false) as hit from r, (values (3600.0), (14400.0), (43200.0)) v(w) where code & 255 >= 40)
       select unit, w as window_s, count(*) as n_responses, sum(hit::int) as n_assigned, sum((not hit)::int) as n_unassigned,
         count(distinct case when hit then st end) as n_stimuli_answered from w group by all""")
def _(spark, d):
    log = event_log(spark, d).withColumn("code", F.col("code").bitwiseAND(255))
    assigned = joins.latest_stimulus(log, ["unit"], ["sample", "event_id"], "sample", F.col("code").isin(20, 21, 22), F.col("code") >= 40)
    return joins.response_windows(assigned, "sample", [3600.0, 14400.0, 43200.0], ["unit"])


@query("j13_compare_tables", "unit:i channel:i condition field",
       ctes(CM) + """select unit, channel, condition, 'price' as field from cm where unit % 5 = 0 and price * 1e-6 > 0
       union all select unit, channel, condition, 'n_trials' from cm where n_trials % 9 = 0""")
def _(spark, d):
    archived = channel_metrics(spark, d)
    reproduced = archived.select(
        "unit", "channel", "condition",
        F.when(F.col("unit") % 5 == 0, F.col("price") * 1.000001).otherwise(F.col("price") * (1 + 1e-12)).alias("price"), "quantity",
        F.when(F.col("n_trials") % 9 == 0, F.lit(None)).otherwise(F.col("n_trials")).cast("bigint").alias("n_trials"))
    return joins.compare_tables(archived, reproduced, ["unit", "channel", "condition"])


# --- set operations ---

@query("u1_union_parts", "unit:i metric:4",
       "select o_custkey as unit, o_totalprice as metric from orders union all select c_custkey, c_acctbal from customer")
def _(spark, d):
    return table(spark, d, "orders").select(F.col("o_custkey").alias("unit"), F.col("o_totalprice").alias("metric")).unionByName(
        table(spark, d, "customer").select(F.col("c_acctbal").alias("metric"), F.col("c_custkey").alias("unit")))


@query("u2_union_filled", "unit:i price:2 balance:2",
       "select o_custkey as unit, o_totalprice as price, null as balance from orders union all select c_custkey, null, c_acctbal from customer")
def _(spark, d):
    from mensura.operators.reshape import union_filled

    return union_filled([
        table(spark, d, "orders").select(F.col("o_custkey").alias("unit"), F.col("o_totalprice").alias("price")),
        table(spark, d, "customer").select(F.col("c_custkey").alias("unit"), F.col("c_acctbal").alias("balance"))])


@query("u3_unexpected_codes", "code:i", ctes(EV, LOG) + "select distinct code & 255 as code from elog where code & 255 not in (8, 9, 20, 41)")
def _(spark, d):
    seen = event_log(spark, d).select(F.col("code").bitwiseAND(255).alias("code")).distinct()
    allowed = spark.createDataFrame([(8,), (9,), (20,), (41,)], "code int")
    return seen.join(allowed, "code", "left_anti")


@query("u4_common_channels", "unit:i channel:i",
       ctes(CM) + "select unit, channel from cm where condition = 'A' intersect select unit, channel from cm where condition = 'R'")
def _(spark, d):
    m = channel_metrics(spark, d)
    return m.filter("condition = 'A'").select("unit", "channel").intersect(m.filter("condition = 'R'").select("unit", "channel"))


@query("u5_undirected_union", "a:i b:i dist:6",
       "select least(l_suppkey, l_partkey) as a, greatest(l_suppkey, l_partkey) as b, min(l_discount) as dist from lineitem group by all")
def _(spark, d):
    return graph.symmetric_edges(table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("id"), F.col("l_partkey").alias("other"), F.col("l_discount").alias("dist")))


# --- sorts and top-k ---

@query("o1_deterministic_order", "dataset outcome model position:i",
       ctes(PR) + "select dataset, outcome, model, row_number() over (order by dataset, outcome, model) as position from (select distinct dataset, outcome, model from pr)")
def _(spark, d):
    groups = predictions(spark, d).select("dataset", "outcome", "model").distinct().orderBy("dataset", "outcome", "model")
    # one row per reported group, numbered at the sink
    packed = groups.agg(F.sort_array(F.collect_list(F.struct("dataset", "outcome", "model"))).alias("g"))
    return packed.select(F.posexplode("g").alias("p", "g")).select("g.*", (F.col("p") + 1).alias("position"))


@query("o2_top_k_per_key", "l_suppkey:i l_orderkey:i l_linenumber:i rank:i",
       """select * from (select l_suppkey, l_orderkey, l_linenumber, row_number() over (partition by l_suppkey order by -l_extendedprice, l_orderkey * 10 + l_linenumber) as rank from lineitem) where rank <= 3""")
def _(spark, d):
    li = table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber",
        (-F.col("l_extendedprice")).alias("score"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("tie"))
    return graph.top_k_large(li, ["l_suppkey"], "score", "tie", 3)


@query("o3_arg_max", "o_custkey:i best_order:i",
       "select o_custkey, arg_max(o_orderkey, o_totalprice * 1000000 + o_orderkey % 1000) as best_order from orders group by all")
def _(spark, d):
    score = F.struct((F.col("o_totalprice") * 1000000 + F.col("o_orderkey") % 1000).alias("s"), F.col("o_orderkey"))
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", score).alias("best_order"))


@query("o4_arg_min_grid", "unit:i best_alpha:2 best_error:6",
       """with g as (select o_custkey as unit, a as alpha, round(avg(abs(o_totalprice / 100003.0 - a)), 9) as err from orders, (values (0.1), (1.0), (2.5), (5.0)) v(a) group by all)
       select unit, arg_min(alpha, struct_pack(e := err, a := alpha)) as best_alpha, min(err) as best_error from g group by unit""")
def _(spark, d):
    grid = [0.1, 1.0, 2.5, 5.0]
    errors = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("unit")).agg(*[
        F.avg(F.abs(F.col("o_totalprice") / 100003.0 - a)).alias(f"e{i}") for i, a in enumerate(grid)])
    long = errors.select("unit", F.explode(F.array(*[F.struct(F.round(F.col(f"e{i}"), 9).alias("err"), F.lit(a).alias("alpha")) for i, a in enumerate(grid)])).alias("g"))
    return long.groupBy("unit").agg(F.min_by("g.alpha", "g").alias("best_alpha"), F.min("g.err").alias("best_error"))
