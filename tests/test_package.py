"""The package reaches the Python workers from any working folder."""

import os
import subprocess
import sys
import textwrap
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_grouped_model_runs_from_another_folder(tmp_path):
    script = textwrap.dedent(f"""
        import sys, tempfile
        sys.path.insert(0, {str(ROOT)!r})
        from mensura.session import build_session
        spark = build_session("elsewhere", "local[2]", spark__ui__enabled="false", spark__checkpoint__dir=tempfile.mkdtemp(prefix="spark-"))
        from mensura.plans import catalog
        print("rows", len(catalog.QUERIES["m2_ols_hc3"](spark, "/root/testdata/sf0.001").collect()))
    """)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-2000:]
    assert int(done.stdout.split("rows")[1]) > 0


def test_core_queries_without_the_corpus_libraries():
    script = textwrap.dedent(f"""
        import sys
        sys.path.insert(0, {str(ROOT)!r})
        sys.modules["zstandard"] = None  # importing it fails
        import __spark_entry__ as entry
        names = set(entry.queries())
        print("names", "a1_behaviour_summary" in names, any(n.startswith("op") or n == "pipeline" for n in names), set(entry.oracle_sql()) <= names)
    """)
    done = subprocess.run([sys.executable, "-W", "ignore", "-c", script], capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-2000:]
    assert done.stdout.split()[1:] == ["True", "False", "True"]


def test_filled_series_are_not_shuffled(spark, tmp_path):
    """Groups of a unit's filled series need no exchange above the filling (failed with a joined grid); odd rows keep their place."""
    from pyspark.sql import functions as F

    from mensura.plans.bindings import samples

    rows = [(0, "2024-01-01 03:10:00", 1, "a", 2.0), (1, "2024-01-01 03:50:00", 1, "a", 0.5), (2, "2024-01-03 23:00:00", 1, "b", 4.0),
            (3, "2024-01-02 05:00:00", 2, None, 7.0), (4, "2024-01-02 06:00:00", None, "a", 9.0), (5, "2024-01-02 00:00:00", 2, "a", None)]
    df = spark.createDataFrame(rows, "event_id bigint, ts string, user_id bigint, event_type string, value double")
    df.withColumn("ts", F.to_timestamp("ts")).write.parquet(f"{tmp_path}/events.parquet")
    series = samples(spark, str(tmp_path))
    grouped = series.groupBy("unit", "channel", "trial").agg(F.sum("x").alias("x"))
    plan = grouped._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.index("Generate")]
    got = series.collect()
    assert len(got) == 3 * 2 * 3 * 24 == len({(r.unit, r.channel, r.trial, r.s) for r in got})
    assert {(r.unit, r.channel, r.trial, r.s): r.x for r in got if r.x} == {(1, "a", 0, 3): 2.5, (1, "b", 2, 23): 4.0}


def test_unit_folders_hold_one_file_each(spark):
    """A unit's rows come from one task (failed with several files a folder)."""
    from mensura.plans import catalog

    # small tables would otherwise be joined into one task
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        loaded = catalog.QUERIES["s5_unit_files_validated"](spark, "/root/testdata/sf0.001")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = [f for f in loaded.inputFiles() if "folder=" in f]
    assert files and len(files) == len({f.rsplit("/", 1)[0] for f in files})
