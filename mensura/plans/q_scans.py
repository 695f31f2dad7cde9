"""Scans and sinks (S rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from mensura.operators.joins import windows_join
from mensura.operators.ordering import attach
from mensura.plans.bindings import CM, EV, LOG, SMP, channel_metrics, daily_series, event_log
from mensura.plans.registry import query, table
from mensura.plans.sqltext import ctes
from mensura.session import cut_lineage, scratch
from mensura.sources import recordings, sheets, sinks, tables


@query("s1_csv_scan", "unit:i channel:i condition price:6 quantity:6 n_trials:i", ctes(CM) + "select * from cm")
def _(spark, d):
    # two exports with their columns in another order, one of them with a further column
    path = scratch(spark)
    columns = ["unit", "channel", "condition", "price", "quantity", "n_trials"]
    m = cut_lineage(channel_metrics(spark, d).select(*columns))
    sinks.write_table(m.filter("channel % 2 = 0"), f"{path}/even", columns, "csv")
    noted = m.filter("channel % 2 = 1").withColumn("note", F.lit("odd"))
    sinks.write_table(noted, f"{path}/odd", ["note", *reversed(columns)], "csv")
    schema = "unit bigint, channel int, condition string, price double, quantity double, n_trials bigint"
    return tables.read_csv(spark, [f"{path}/even", f"{path}/odd"], schema)


@query("s2_tsv_scan", "participant_id:i balance:2 segment",
       "select c_custkey as participant_id, c_acctbal as balance, c_mktsegment as segment from customer")
def _(spark, d):
    path = scratch(spark)
    table(spark, d, "customer").select(
        F.col("c_mktsegment").alias("segment"), F.col("c_custkey").alias("participant_id"), F.col("c_acctbal").alias("balance")
    ).write.option("header", True).option("sep", "\t").csv(path)
    return tables.read_tsv(spark, path, "participant_id bigint, balance double, segment string")


@query("s3_participants_in_cohort", "c_custkey:i c_acctbal:2 c_mktsegment",
       "select c_custkey, c_acctbal, c_mktsegment from customer where c_mktsegment in ('BUILDING', 'MACHINERY')")
def _(spark, d):
    return tables.read_participants(spark, f"{d}/customer.parquet", None, "c_mktsegment", ["BUILDING", "MACHINERY"])


@query("s3_sheet_participants", "c_custkey:i c_acctbal:2 c_mktsegment",
       "select c_custkey, c_acctbal, c_mktsegment from customer where c_mktsegment in ('BUILDING', 'MACHINERY')")
def _(spark, d):
    # a workbook per nation, as sites would send them
    path = scratch(spark)
    sheets.write_sheets(table(spark, d, "customer").select("c_nationkey", "c_mktsegment", "c_acctbal", "c_custkey"), "c_nationkey", path)
    people = sheets.read_sheet(spark, path, "c_custkey bigint, c_acctbal double, c_mktsegment string")
    return people.filter(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"))


@query("s5_unit_files_validated", "file_unit rule",
       ctes(CM) + """, per as (select cast(unit as varchar) as file_unit, count(distinct condition) as k from cm where n_trials >= (select avg(n_trials) from cm) group by all)
       select file_unit, 'condition_mismatch' as rule from per where k <> 2
       union all select cast(s_suppkey as varchar), 'missing' from supplier
         where cast(s_suppkey as varchar) not in (select file_unit from per)""")
def _(spark, d):
    # a folder per unit, as separate runs would leave them; cells need as many trials as the average cell
    path = scratch(spark)
    m = channel_metrics(spark, d)
    supported = attach(m, m.agg(F.avg("n_trials").alias("average")), []).filter("n_trials >= average").drop("average")
    sinks.write_unit_tables(supported, "unit", path)
    schema = "unit bigint, channel int, condition string, price double, quantity double, n_trials bigint"
    loaded = tables.read_unit_tables(spark, path, schema, r"folder=(\d+)")
    expected = table(spark, d, "supplier").select(F.col("s_suppkey").alias("unit"))
    return tables.unit_table_violations(loaded, "unit", "condition", ["A", "R"], expected)


@query("s6_undirected_edges", "a:i b:i",
       "select distinct a, b from (select l_linenumber as a, l_linenumber + 1 as b from lineitem union all select l_linenumber + 1, l_linenumber from lineitem)")
def _(spark, d):
    path = scratch(spark)
    lines = table(spark, d, "lineitem").select(F.col("l_linenumber").alias("channel_a"), (F.col("l_linenumber") + 1).alias("channel_b"), F.lit(1.0).alias("distance"))
    sinks.write_table(lines.distinct(), path, ["distance", "channel_b", "channel_a"], "csv")
    return tables.read_edges(spark, path)


@query("s7_missing_inputs", "c_custkey:i",
       "select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_orderstatus = 'P')")
def _(spark, d):
    present = table(spark, d, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return tables.missing_inputs(table(spark, d, "customer"), present, ["c_custkey"])


@query("s8_fixed_windows", "unit:i window_start:i n_events:i code_sum:i",
       ctes(EV, LOG) + """, len as (select unit, max(sample) + 1 as n from elog group by unit),
       starts as (select distinct unit, cast(floor(greatest(0, n - 86400) * i / 17) as bigint) as window_start from len, range(0, 18) t(i))
       select s.unit, s.window_start, count(*) as n_events, sum(code) as code_sum from starts s join elog e
         on e.unit = s.unit and e.sample >= s.window_start and e.sample < s.window_start + 86400 group by all""")
def _(spark, d):
    log = event_log(spark, d)
    length = log.groupBy("unit").agg((F.max("sample") + 1).alias("n"))
    starts = length.select("unit", F.explode(tables.even_windows("n", 86400, 18)).alias("window_start"))
    windows = starts.withColumn("stop", F.col("window_start") + 86400)
    inside = windows_join(log, windows, ["unit"], "sample", "window_start", "stop", 86400)
    return inside.groupBy("unit", "window_start").agg(F.count(F.lit(1)).alias("n_events"), F.sum("code").alias("code_sum"))


@query("s8_recording_windows", "unit:i channel window_start:i n:i total:i",
       ctes(SMP) + """, len as (select unit, max(trial) * 24 + 24 as n from smp group by unit),
       starts as (select distinct unit, cast(floor(greatest(0, n - 48) * i / 17) as bigint) as window_start from len, range(0, 18) t(i)),
       rec as (select unit, channel, trial * 24 + s as sample, cast(round(x * 100) as bigint) as value from smp where channel in ('click', 'view'))
       select r.unit, channel, window_start, count(*) as n, sum(value) as total from starts s join rec r
         on r.unit = s.unit and sample >= window_start and sample < window_start + 48 group by all""")
def _(spark, d):
    # the hourly series of every user as a recording of its own, a day a record; two channels in 18 windows are read
    path = scratch(spark)
    series = daily_series(spark, d).select(
        F.col("unit").cast("string").alias("file"), "channel", F.col("trial").cast("bigint").alias("record"),
        F.transform("values", lambda x: F.round(x * 100)).alias("values"))
    recordings.write_records(series, path, rate=24)
    lengths = series.groupBy("file").agg((F.max("record") * 24 + 24).alias("n"))
    windows = lengths.select("file", F.explode(tables.even_windows("n", 48, 18)).alias("window_start")).withColumn("stop", F.col("window_start") + 48)
    read = recordings.read_recordings(spark, path, ["click", "view"], windows)
    return read.groupBy(F.col("file").alias("unit"), "channel", "window_start").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


@query("s9_fixed_columns_sink", "unit:i channel:i condition price:6", ctes(CM) + "select * from cm")
def _(spark, d):
    path = scratch(spark)
    sinks.write_table(channel_metrics(spark, d), path, ["unit", "channel", "condition", "price"])
    return spark.read.schema("unit bigint, channel int, condition string, price double").parquet(path)


@query("s10_refuses_existing_output", "refused n_rows:i",
       "select true as refused, count(*) as n_rows from orders")
def _(spark, d):
    path = scratch(spark)
    orders = table(spark, d, "orders").select("o_orderkey")
    sinks.write_table(orders, path, ["o_orderkey"])
    refused = False
    try:
        sinks.write_table(orders, path, ["o_orderkey"])
    except Exception:
        refused = True
    return spark.read.parquet(path).agg(F.lit(refused).alias("refused"), F.count(F.lit(1)).alias("n_rows"))


@query("s11_run_manifest", "parameters n_rows:i n_inputs:i")
def _(spark, d):
    path = scratch(spark)
    n = table(spark, d, "orders").count()
    files = tables.fingerprints(spark, [f"{d}/orders.parquet", f"{d}/customer.parquet"])
    sinks.write_manifest(spark, path, {"seed": 20261105, "replicates": 100000}, files, n_rows=n)
    back = spark.read.schema("parameters string, n_rows bigint, inputs array<struct<path: string, sha256: string>>").json(path)
    return back.withColumn("n_inputs", F.size("inputs"))


@query("s12_file_fingerprints", "name length:i sha256")
def _(spark, d):
    files = tables.fingerprints(spark, f"{d}/*.parquet")
    return files.withColumn("name", F.element_at(F.split("path", "/"), -1))


@query("s12_range_fingerprints", "name length:i tree_sha256")
def _(spark, d):
    files = tables.range_fingerprints(spark, f"{d}/*.parquet")
    return files.withColumn("name", F.element_at(F.split("path", "/"), -1))


@query("s13_source_identity", "name")
def _(spark, d):
    current = tables.fingerprints(spark, f"{d}/*.parquet")
    # the stored manifest disagrees for one file on purpose
    manifest = current.select("path", F.when(F.col("path").endswith("/nation.parquet"), F.sha2(F.lit("old"), 256)).otherwise(F.col("sha256")).alias("sha256"))
    changed = tables.fingerprint_mismatches(current, manifest)
    return changed.select(F.element_at(F.split("path", "/"), -1).alias("name"))


@query("s4_frozen_protocol", "replicates:i segment n_units:i",
       "select 200 as replicates, c_mktsegment as segment, count(*) as n_units from customer where c_mktsegment in ('BUILDING', 'FURNITURE') group by all")
def _(spark, d):
    path = scratch(spark)
    spark.createDataFrame(
        [("p1", "frozen", 200, ["BUILDING", "FURNITURE"])], "protocol_id string, status string, replicates int, cohort array<string>"
    ).coalesce(1).write.json(path)
    protocol = tables.read_protocol(spark, path, "frozen")
    kept = table(spark, d, "customer").filter(F.col("c_mktsegment").isin(protocol["cohort"]))
    return kept.groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count(F.lit(1)).alias("n_units")).withColumn("replicates", F.lit(protocol["replicates"]))
