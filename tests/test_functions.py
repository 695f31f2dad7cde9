import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from mensura.functions import scalar as s
from mensura.functions import special as sp


def tail(t, nu):
    theta = math.atan(abs(t) / math.sqrt(nu))
    x = np.linspace(theta, math.pi / 2, 400001)
    w = np.ones_like(x)
    w[1:-1:2], w[2:-1:2] = 4, 2
    c = 2 * math.exp(math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2)) / math.sqrt(math.pi)
    return c * (w * np.cos(x) ** (nu - 1)).sum() * (x[1] - x[0]) / 3


def test_normal_tail_and_quantile(spark):
    zs = [0.0, 0.4, 1.0, 2.2, 2.6, 3.7, 5.5, 9.0]
    df = spark.createDataFrame([(z,) for z in zs], "z double")
    for row in df.select("z", sp.normal_two_sided_p("z").alias("p"), sp.normal_quantile(sp.normal_sf("z")).alias("q")).collect():
        assert row.p == pytest.approx(math.erfc(row.z / math.sqrt(2)), rel=1e-11)
        if row.z < 6:
            assert row.q == pytest.approx(-row.z, abs=1e-8)


def test_student_tail_and_quantile(spark):
    cases = [(t, nu) for nu in (1, 2, 3, 7, 34, 150, 3000, 50000) for t in (0.2, 1.1, 2.0, 6.0)]
    df = spark.createDataFrame([(float(t), float(nu)) for t, nu in cases], "t double, nu double")
    for row in df.select("t", "nu", sp.t_two_sided_p("t", "nu").alias("p")).collect():
        assert row.p == pytest.approx(tail(row.t, row.nu), rel=1e-7)
    nus = spark.createDataFrame([(float(n),) for n in (1, 2, 3, 4, 10, 34, 1000)], "nu double")
    for row in nus.select("nu", sp.t_quantile(0.975, "nu").alias("q")).collect():
        assert tail(row.q, row.nu) == pytest.approx(0.05, abs=1e-8)


def test_tiny_p_keeps_relative_accuracy(spark):
    p = spark.range(1).select(sp.t_two_sided_p(F.lit(14.0), F.lit(33.0)).alias("p")).first().p
    assert 0 < p < 1e-13
    assert p == pytest.approx(tail(14.0, 33.0), rel=1e-3)


def test_uniform_depends_on_keys_only(spark):
    df = spark.range(2000).withColumn("u", s.uniform("seed", "id"))
    again = spark.range(2000).repartition(7).withColumn("u", s.uniform("seed", "id"))
    a = {r.id: r.u for r in df.collect()}
    assert a == {r.id: r.u for r in again.collect()}
    assert abs(np.mean(list(a.values())) - 0.5) < 0.03 and 0 <= min(a.values()) and max(a.values()) < 1


def test_spearman_brown_and_logit(spark):
    row = spark.createDataFrame([(0.5, -1.0, 0.0)], "r double, bad double, p double").select(
        s.spearman_brown("r").alias("a"), s.spearman_brown("bad").alias("b"), s.logit("p").alias("c")).first()
    assert row.a == pytest.approx(2 / 3) and row.b is None and row.c == pytest.approx(math.log(1e-6 / (1 - 1e-6)))


def test_reasons_and_trigger(spark):
    row = spark.createDataFrame([(1, None, 511)], "a int, b int, code int").select(
        s.reasons((F.col("a") == 1, "x"), (F.col("b") == 1, "y"), (F.col("a") < 5, "z")).alias("r"), s.normalise_trigger("code").alias("c")).first()
    assert row.r == "x;z" and row.c == 255


def test_logarithm_of_zero_is_minus_infinity(spark):
    from mensura.functions.scalar import natural_log

    got = spark.createDataFrame([(0, 0.0), (1, 1.0), (2, None)], "i int, x double").select("i", natural_log("x").alias("y")).orderBy("i").collect()
    assert [r.y for r in got] == [float("-inf"), 0.0, None]


def test_coherence_of_a_zero_coefficient_is_nan(spark):
    from mensura.operators.signal import coefficient_coherence

    df = spark.createDataFrame([("a", 0.0, 0.0), ("a", 1.0, 0.0), ("b", 3.0, 4.0), ("b", 0.0, 2.0)], "k string, re double, im double")
    got = {r.k: r for r in coefficient_coherence(df, ["k"], "re", "im").collect()}
    assert got["a"].itpc != got["a"].itpc and got["a"].n_trials == 2 and abs(got["b"].itpc - (0.3**2 + 0.9**2) ** 0.5) < 1e-12


def test_logarithms_below_zero_are_nan(spark, tmp_path):
    """As the SQL has it, also for the ratio (failed with null)."""
    from mensura.plans import catalog

    rows = [(0, -2.0, '{"k": 3}'), (1, 0.0, '{"k": 1}'), (2, float("nan"), '{"k": 1}'), (3, None, '{"k": 1}'), (4, -1e-30, '{"k": 1}'), (5, -0.0, '{"k": 1}')]
    df = spark.createDataFrame(rows, "event_id bigint, value double, props string").selectExpr("*", "timestamp'2024-01-01' as ts", "1L as user_id", "'a' as event_type")
    df.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = [(r.log_value, r.db) for r in catalog.QUERIES["f7_log_and_decibel"](spark, str(tmp_path)).orderBy("event_id").collect()]
    low = float("-inf")
    assert [str(g) for g in got] == [str(w) for w in [(float("nan"),) * 2, (low, -300.0), (float("nan"),) * 2, (None, None), (float("nan"), low), (low, -300.0)]]
