"""The operators' input shapes, built from the driver's tables, and their SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from mensura.operators.ordering import attach, in_order, row_index
from mensura.plans.registry import table

#: origin of sample numbers; any instant serves
DAY_ZERO = "2024-01-01"
N_HOURS = 24


def event_types(spark: SparkSession, d: str) -> list[str]:
    """The channel list: all event types of the table, sorted."""
    return sorted(r[0] for r in table(spark, d, "events").select("event_type").distinct().collect())


def nation_keys(spark: SparkSession, d: str) -> list[int]:
    return sorted(r[0] for r in table(spark, d, "nation").select("n_nationkey").distinct().collect())


def events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(
        "event_id", "ts", F.col("user_id").alias("unit"), "event_type", "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


EV = """ev as (select event_id, ts, user_id as unit, event_type, value,
  cast(json_extract_string(props, '$.k') as int) as k from events)"""


def trials(spark: SparkSession, d: str) -> DataFrame:
    """Paired-condition trials: clicks (A) and views (B)."""
    return events(spark, d).filter(F.col("event_type").isin("click", "view")).select(
        "unit", "event_id", "ts",
        F.when(F.col("event_type") == "click", "A").otherwise("B").alias("condition"),
        F.when(F.col("event_id") % 3 == 0, "congruent").otherwise("incongruent").alias("congruency"),
        (F.col("k") >= 20).alias("correct"),
        F.when(F.col("value") >= 1, F.col("value") * 10.0).alias("rt_ms"),
        F.when(F.col("k") % 10 != 0, F.col("k") % 7 != 0).alias("usable"),
        F.when(F.col("k") % 11 != 0, F.col("k") % 5 != 0).alias("usable_strict"),
        F.col("value").alias("x"), F.col("k").cast("double").alias("y"),
    )


TR = """tr as (select unit, event_id, ts, case event_type when 'click' then 'A' else 'B' end as condition,
  case when event_id % 3 = 0 then 'congruent' else 'incongruent' end as congruency,
  k >= 20 as correct, case when value >= 1 then value * 10.0 end as rt_ms,
  case when k % 10 <> 0 then k % 7 <> 0 end as usable,
  case when k % 11 <> 0 then k % 5 <> 0 end as usable_strict,
  value as x, k::double as y
  from ev where event_type in ('click', 'view'))"""


def indexed_trials(spark: SparkSession, d: str) -> DataFrame:
    return row_index(trials(spark, d), ["unit"], ["ts", "event_id"], "trial_index")


TRI = "tri as (select *, row_number() over (partition by unit order by ts, event_id) as trial_index from tr)"

BEH = """beh as (select unit, condition, avg(correct::int) as accuracy,
  quantile_cont(case when correct then rt_ms end, 0.5) as median_correct_rt_ms from tr group by all),
behaviour as (select *, case when accuracy > 0 then median_correct_rt_ms / accuracy end as inverse_efficiency_ms from beh)"""

BEHLONG = """behlong as (select unit, condition, metric, value from (
    select unit, condition, 'accuracy' as metric, accuracy as value from behaviour
    union all select unit, condition, 'median_correct_rt_ms', median_correct_rt_ms from behaviour
    union all select unit, condition, 'inverse_efficiency_ms', inverse_efficiency_ms from behaviour)),
behdiff as (select metric, unit, max(case when condition = 'A' then value end) - max(case when condition = 'B' then value end) as difference
  from behlong group by all)"""


#: hourly values that one task holds
SERIES_ROWS = 2_000_000


def daily_series(spark: SparkSession, d: str) -> DataFrame:
    """Hourly series by day: unit = user, channel = event type, trial = day, ``values`` of its hours, zero filled.

    Types and days are those of the table; days count from its first.  Only the
    hours with events are shuffled: a unit's are brought together, and the
    series is filled up in place, at most types x days x 24 values.  The result
    stays partitioned by unit, so groups that hold the unit need no shuffle; the
    number of partitions follows the filled series.
    """
    ev = table(spark, d, "events")
    size = ev.agg(
        F.min(F.to_date("ts")).alias("first"), F.max(F.to_date("ts")).alias("last"), F.array_sort(F.collect_set("event_type")).alias("types"),
        F.approx_count_distinct("user_id").alias("units")).first()
    types = size["types"]
    days = (size["last"] - size["first"]).days + 1 if size["last"] else 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size["units"] * len(types) * days * N_HOURS // SERIES_ROWS))
    channels = F.array(*[F.lit(t) for t in types]).cast("array<string>")
    epoch = (F.array_position(channels, F.col("event_type")) - 1) * days + F.date_diff("ts", F.lit(size["first"]).cast("date"))
    cells = ev.groupBy(F.col("user_id").alias("unit"), F.when(F.col("user_id").isNotNull(), epoch).alias("epoch"), F.hour("ts").alias("s")).agg(
        F.sum("value").alias("x")).repartition(parts, "unit")
    hour = lambda h: F.coalesce(F.max(F.when(F.col("s") == h, F.col("x"))), F.lit(0.0))
    seen = cells.groupBy("unit", "epoch").agg(F.array(*[hour(h) for h in range(N_HOURS)]).alias("values"))
    seen = seen.groupBy("unit").agg(F.collect_list(F.when(F.col("epoch").isNotNull(), F.struct("epoch", "values"))).alias("seen"))
    every = F.sequence(F.lit(0).cast("bigint"), F.lit(len(types) * days - 1).cast("bigint")) if types else F.array().cast("array<bigint>")
    empty = F.array(*[F.lit(0.0)] * N_HOURS)
    unseen = F.transform(F.array_except(every, F.col("seen.epoch")), lambda e: F.struct(e.alias("epoch"), empty.alias("values")))
    return seen.select("unit", F.explode(F.concat("seen", unseen)).alias("e")).select(
        "unit", F.get(channels, (F.col("e.epoch") / max(1, days)).cast("int")).alias("channel"),
        (F.col("e.epoch") % max(1, days)).cast("int").alias("trial"), F.col("e.values").alias("values"))


def samples(spark: SparkSession, d: str) -> DataFrame:
    """``daily_series`` with a row per hour: unit, channel, trial, s = hour, x."""
    return daily_series(spark, d).select("unit", "channel", "trial", F.posexplode("values").alias("s", "x"))


SMP = """smp as (select g.unit, g.channel, g.trial, g.s, coalesce(c.x, 0.0) as x from
  (select u.unit, t.channel, dd.trial, h.s from (select distinct user_id as unit from events) u,
    (select distinct event_type as channel from events) t,
    (select unnest(range(0, (select datediff('day', min(cast(ts as date)), max(cast(ts as date))) + 1 from events))) as trial) dd, (select unnest(range(0, 24)) as s) h) g
  left join (select user_id as unit, event_type as channel, datediff('day', (select min(cast(ts as date)) from events), cast(ts as date)) as trial,
    hour(ts) as s, sum(value) as x from events group by all) c
  on g.unit = c.unit and g.channel = c.channel and g.trial = c.trial and g.s = c.s)"""


def pooled_samples(spark: SparkSession, d: str) -> DataFrame:
    """The hourly series summed over users: channel = event type."""
    ev = table(spark, d, "events")
    bounds = ev.agg(F.min(F.to_date("ts")).alias("first"), F.max(F.to_date("ts")).alias("last"))
    cells = attach(ev, bounds, []).groupBy(
        F.col("event_type").alias("channel"), F.date_diff("ts", "first").alias("trial"), F.hour("ts").alias("s")
    ).agg(F.sum("value").alias("x"))
    grid = (
        attach(ev.select(F.col("event_type").alias("channel")).distinct(), bounds, [])
        .withColumn("trial", F.explode(F.sequence(F.lit(0), F.date_diff("last", "first"))))
        .withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(N_HOURS - 1)))).drop("first", "last")
    )
    return grid.join(cells, ["channel", "trial", "s"], "left").withColumn("x", F.coalesce("x", F.lit(0.0)))


PSMP = SMP + """,
psmp as (select channel, trial, s, sum(x) as x from smp group by all)"""


def runs(spark: SparkSession, d: str) -> DataFrame:
    """Per-run counts and means: unit = customer, run = priority, frequency = status."""
    price = F.col("o_totalprice")
    inside = lambda lo, hi: F.sum(((price >= lo) & (price < hi)).cast("bigint"))
    return table(spark, d, "orders").filter(F.col("o_orderstatus").isin("F", "O")).groupBy(
        F.col("o_custkey").alias("unit"), F.col("o_orderpriority").alias("run"),
        F.when(F.col("o_orderstatus") == "F", 27).otherwise(40).alias("freq"),
    ).agg(
        F.count(F.lit(1)).alias("n_valid"),
        inside(300000, 1e9).alias("hits"), inside(200000, 300000).alias("misses"),
        inside(100000, 200000).alias("false_alarms"), inside(0, 100000).alias("correct_rejections"),
        F.sum(F.when(price > 450000, 1)).alias("n_bad"),
        (F.avg(F.when(F.col("o_orderpriority") != "5-LOW", price)) / 1009.0).alias("metric"),
    )


RUNS = """runs as (select o_custkey as unit, o_orderpriority as run, case when o_orderstatus = 'F' then 27 else 40 end as freq,
  count(*) as n_valid, sum((o_totalprice >= 300000)::int) as hits, sum((o_totalprice >= 200000 and o_totalprice < 300000)::int) as misses,
  sum((o_totalprice >= 100000 and o_totalprice < 200000)::int) as false_alarms,
  sum((o_totalprice >= 0 and o_totalprice < 100000)::int) as correct_rejections,
  sum(case when o_totalprice > 450000 then 1 end) as n_bad,
  avg(case when o_orderpriority <> '5-LOW' then o_totalprice end) / 1009.0 as metric
  from orders where o_orderstatus in ('F', 'O') group by all)"""


def channel_metrics(spark: SparkSession, d: str) -> DataFrame:
    """unit = supplier, channel = line number, conditions = return flags A and R, two metrics."""
    return table(spark, d, "lineitem").filter(F.col("l_returnflag").isin("A", "R")).groupBy(
        F.col("l_suppkey").alias("unit"), F.col("l_linenumber").alias("channel"), F.col("l_returnflag").alias("condition")
    ).agg(
        (F.avg("l_extendedprice") / 1009.0).alias("price"), (F.avg("l_quantity")).alias("quantity"),
        F.count(F.lit(1)).alias("n_trials"),
    )


CM = """cm as (select l_suppkey as unit, l_linenumber as channel, l_returnflag as condition,
  avg(l_extendedprice) / 1009.0 as price, avg(l_quantity) as quantity, count(*) as n_trials
  from lineitem where l_returnflag in ('A', 'R') group by all)"""


def channel_differences(spark: SparkSession, d: str) -> DataFrame:
    """A minus R per unit and channel, long over the two metrics."""
    side = lambda m, c: F.avg(F.when(F.col("condition") == c, F.col(m)))
    wide = channel_metrics(spark, d).groupBy("unit", "channel").agg(
        (side("price", "A") - side("price", "R")).alias("price"), (side("quantity", "A") - side("quantity", "R")).alias("quantity")
    )
    return wide.unpivot(["unit", "channel"], ["price", "quantity"], "metric", "difference").filter("difference is not null")


CD = CM + """,
cdw as (select unit, channel, max(case when condition = 'A' then price end) - max(case when condition = 'R' then price end) as price,
  max(case when condition = 'A' then quantity end) - max(case when condition = 'R' then quantity end) as quantity from cm group by all),
cd as (select unit, channel, metric, difference from (
  select unit, channel, 'price' as metric, price as difference from cdw union all
  select unit, channel, 'quantity', quantity from cdw) where difference is not null)"""


def line_edges(spark: SparkSession, d: str) -> DataFrame:
    """Consecutive line numbers are neighbours."""
    lines = table(spark, d, "lineitem").select(F.col("l_linenumber").alias("a")).distinct()
    other = lines.withColumnRenamed("a", "b")
    forward = lines.withColumn("b", F.col("a") + 1).join(other, "b").select("a", "b")
    return forward.unionByName(forward.select(F.col("b").alias("a"), F.col("a").alias("b")))


LE = """lines as (select distinct l_linenumber as a from lineitem),
le as (select x.a, y.a as b from lines x, lines y where abs(x.a - y.a) = 1)"""


def event_log(spark: SparkSession, d: str) -> DataFrame:
    """Status log per user: sample = event number in time order, code by event type."""
    # Codes: 8 and 9 start a condition, 20 to 22 are targets, 40 to 43 answer one, 50 and 51 do not.
    k = F.col("k")
    code = (
        F.when(F.col("event_type") == "signup", 8).when(F.col("event_type") == "view", 9)
        .when(F.col("event_type") == "click", k % 3 + 20).when(F.col("event_type") == "purchase", k % 4 + 40)
        .when(k < 50, 50).otherwise(51)
    )
    micros = F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'{DAY_ZERO} 00:00:00', ts)")
    return events(spark, d).select("unit", "event_id", F.floor(micros / 1000000).cast("bigint").alias("sample"), (code + 256).alias("code"))


LOG = """elog as (select unit, event_id, cast(floor(epoch_us(ts) / 1000000.0) as bigint) - 1704067200 as sample,
  256 + case when event_type = 'signup' then 8 when event_type = 'view' then 9
    when event_type = 'click' then k % 3 + 20 when event_type = 'purchase' then k % 4 + 40
    when k < 50 then 50 else 51 end as code from ev)"""

LOG_CONDITIONS = {8: "new", 9: "returning"}
LOG_RESPONSES = {
    target: {a: "unsure" if a == 43 else "skipped" if a == 50 else "correct" if a == target + 20 else "incorrect" for a in (40, 41, 42, 43, 50)}
    for target in (20, 21, 22)
}
LOG_CONGRUENT = [20, 22]


def features(spark: SparkSession, d: str) -> DataFrame:
    """Trial features: two measures, trial type, binary outcome, time, usability flags."""
    ev = events(spark, d)
    correct = ((F.col("k") + F.floor("value")) % 4 != 0).cast("int")
    return ev.select(
        "unit", "event_id", "ts", F.col("event_type").alias("trial_type"),
        F.col("value").alias("m40"), F.col("k").cast("double").alias("m36"),
        F.log(F.col("value") + 1.0).alias("e40"), F.sqrt(F.col("k").cast("double")).alias("e36"),
        correct.alias("correct"), (200.0 + F.col("value") * 10.0).alias("rt"),
        F.when(F.col("k") % 13 != 0, F.col("k") % 17 != 0).alias("valid"),
        F.when(F.col("k") % 19 != 0, F.col("k") % 3 != 0).alias("valid_strict"),
        F.col("event_type").isin("click", "purchase").cast("int").alias("auditory"),
    )


FT = """ft as (select unit, event_id, ts, event_type as trial_type, value as m40, k::double as m36,
  ln(value + 1.0) as e40, sqrt(k::double) as e36,
  ((k + floor(value)::int) % 4 <> 0)::int as correct, 200.0 + value * 10.0 as rt,
  case when k % 13 <> 0 then k % 17 <> 0 end as valid, case when k % 19 <> 0 then k % 3 <> 0 end as valid_strict,
  (event_type in ('click', 'purchase'))::int as auditory from ev)"""


def predictions(spark: SparkSession, d: str, ordered: bool = False) -> DataFrame:
    """Held-out prediction rows in the common schema, base and extended models, two outcomes; if ``ordered``, a unit's by order key, see ``in_order``."""
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("c_mktsegment").alias("dataset"), F.col("o_custkey").alias("unit"), "o_orderkey",
        (F.col("o_totalprice") / 100003.0).alias("amount"), (F.col("o_orderstatus") == "F").cast("double").alias("closed"),
        (F.col("c_acctbal") / 10000.0).alias("bal"), F.col("o_custkey").alias("ck"),
    )
    if ordered:
        rows = in_order(rows, "unit", "o_orderkey")
    cell = lambda outcome, model, obs, pred: F.struct(
        F.lit(outcome).alias("outcome"), F.lit(model).alias("model"), obs.alias("observed"), pred.alias("predicted")
    )
    amount, closed, bal = F.col("amount"), F.col("closed"), F.col("bal")
    wiggle = (F.col("ck") % 10) / 100.0
    place = ["dataset", "unit", "o_orderkey", *(["_part"] if ordered else [])]
    return rows.select(*place, F.explode(F.array(
        cell("amount", "base", amount, 2.5 + wiggle), cell("amount", "extended", amount, 2.4 + 0.3 * bal),
        cell("accuracy", "base", closed, 0.35 + wiggle), cell("accuracy", "extended", closed, 0.2 + 0.06 * amount + wiggle),
    )).alias("c")).select(*place, "c.*")


PR = """prb as (select c_mktsegment as dataset, o_custkey as unit, o_orderkey, o_totalprice / 100003.0 as amount,
  (o_orderstatus = 'F')::int::double as closed, c_acctbal / 10000.0 as bal, (o_custkey % 10) / 100.0 as wiggle
  from orders join customer on o_custkey = c_custkey),
pr as (select dataset, unit, o_orderkey, 'amount' as outcome, 'base' as model, amount as observed, 2.5 + wiggle as predicted from prb
  union all select dataset, unit, o_orderkey, 'amount', 'extended', amount, 2.4 + 0.3 * bal from prb
  union all select dataset, unit, o_orderkey, 'accuracy', 'base', closed, 0.35 + wiggle from prb
  union all select dataset, unit, o_orderkey, 'accuracy', 'extended', closed, 0.2 + 0.06 * amount + wiggle from prb)"""


def tests_table(spark: SparkSession, d: str) -> DataFrame:
    """A family of p-values per brand: one per part, some missing."""
    p = F.col("p_partkey")
    return table(spark, d, "part").select(
        F.col("p_brand").alias("family"), p.alias("term"),
        F.when(p % 11 != 0, F.pow((p * 7919 % 10007) / 10007.0, F.lit(3.0))).alias("p_value"),
    )


TESTS = """tests as (select p_brand as family, p_partkey as term,
  case when p_partkey % 11 <> 0 then power((p_partkey * 7919 % 10007) / 10007.0, 3.0) end as p_value from part)"""


def regression_rows(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.select(
        F.col("l_suppkey").alias("unit"), F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line"),
        F.log("l_extendedprice").alias("y"), (F.col("l_returnflag") == "R").cast("double").alias("returned"),
        F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"),
        F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"),
    )
