"""Sliced operators against plain recomputation, with one group holding most rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from mensura.operators import ordering as o
from mensura.operators import windows as w


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(5)
    n = 3000
    pdf = pd.DataFrame({
        "g": np.where(rng.random(n) < 0.6, 0, rng.integers(1, 30, n)),
        "x": np.round(rng.lognormal(size=n), 2), "id": np.arange(n),
    })
    return pdf, spark.createDataFrame(pdf)


@pytest.mark.parametrize("size", [37, None])
def test_row_index(skewed, size):
    pdf, df = skewed
    out = o.row_index(df, ["g"], ["x", "id"], "i", total="n", rows_per_slice=size).toPandas()
    want = pdf.sort_values(["g", "x", "id"])
    want["i"] = want.groupby("g").cumcount() + 1
    merged = out.merge(want, on="id", suffixes=("", "_w"))
    assert (merged.i == merged.i_w).all()
    assert (merged.n == merged.g.map(pdf.g.value_counts())).all()


def test_average_rank_and_quantiles(skewed):
    pdf, df = skewed
    ranks = o.average_rank(df, ["g"], "x", "r", rows_per_slice=29).toPandas().set_index("id").r
    assert np.allclose(ranks.sort_index(), pdf.groupby("g").x.rank())
    q = o.quantile_table(df, ["g"], "x", {"a": 0.5, "b": 0.025, "c": 1.0}, rows_per_slice=29).toPandas().set_index("g").sort_index()
    for name, p in (("a", 0.5), ("b", 0.025), ("c", 1.0)):
        assert np.allclose(q[name], pdf.groupby("g").x.quantile(p))


def test_running_kinds(spark):
    pdf = pd.DataFrame({"g": 0, "t": np.arange(50), "v": [i if i % 3 == 0 else None for i in range(50)]})
    df = spark.createDataFrame(pdf.astype({"v": "Int64"}).astype(object).where(pdf.notna(), None), "g bigint, t bigint, v bigint")
    v = F.col("v")
    out = o.running(df, ["g"], ["t"], {
        "s": ("sum", F.col("t")), "last": ("last", v), "before": ("before", v), "next": ("next", v), "m": ("suffix_min", -F.col("t"))},
        rows_per_slice=7).orderBy("t").toPandas()
    assert (out.s == pdf.t.cumsum()).all()
    assert np.allclose(out["last"].astype(float), pdf.v.ffill())
    assert np.allclose(out.before.astype(float)[1:], pdf.v.ffill().shift()[1:])
    assert np.allclose(out.next.astype(float)[:48], pdf.v.shift(-1).bfill()[:48])
    assert (out.m == -49).all()


def test_multiplicity_corrections(spark):
    p = [0.01, 0.04, 0.03, 0.03, None, 0.9, 0.2]
    df = spark.createDataFrame([("f", i, v) for i, v in enumerate(p)], "family string, i int, p double")
    out = w.holm(w.benjamini_hochberg(df, ["family"], "p", "bh", rows_per_slice=2), ["family"], "p", "holm", rows_per_slice=2).orderBy("i").toPandas()
    finite = np.array([v for v in p if v is not None])
    order = np.argsort(finite)
    n = len(finite)
    bh, holm, low, high = np.empty(n), np.empty(n), 1.0, 0.0
    for rank in range(n - 1, -1, -1):
        low = min(low, finite[order[rank]] * n / (rank + 1))
        bh[order[rank]] = low
    for rank in range(n):
        high = max(high, finite[order[rank]] * (n - rank))
        holm[order[rank]] = min(1, high)
    keep = out.p.notna()
    assert np.allclose(out.bh[keep], bh) and np.allclose(out.holm[keep], holm)
    assert out.bh[~keep].isna().all() and (out.bh[keep] >= out.p[keep]).all()


def test_zscore_zero_spread_and_robust_z(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", 5.0), ("b", 2.0), ("b", 2.0)], "u string, x double")
    z = w.zscore(df, ["u"], {"x": "z"}).toPandas()
    assert z[z.u == "a"].z.abs().sum() == pytest.approx(2.0) and z[z.u == "b"].z.isna().all()
    r = w.robust_z(df, ["u"], {"x": "z"}).toPandas()
    assert (r[r.u == "b"].z == 0).all() and r[r.u == "a"].z.max() == pytest.approx(0.67448975)


#: stretches of an event log with what must be left of them, worked out by hand for allowed codes 1-3 and a gap of 2
STRETCHES = [
    ([(0, 9), (1, 1)], [(0, 1)]),  # a transition state takes the code of the marker behind it
    ([(0, 1), (5, 2)], [(0, 1), (5, 2)]),  # too far apart
    ([(0, 1), (1, 2), (2, 3)], [(0, 2), (2, 3)]),  # the pair is consumed, the third stands alone
    ([(0, 1), (2, 2), (4, 3), (5, 1)], [(0, 2), (4, 1)]),  # two pairs
    ([(0, 9), (1, 8), (2, 7)], []),  # no marker at all
    ([(0, 1), (1, 9)], [(0, 1)]),  # a marker does not link to a state behind it
    ([(0, 9), (2, 3), (4, 9), (6, 2)], [(0, 3), (4, 2)]),
    ([(0, 2)], [(0, 2)]),
]


def test_overlap_collapse_of_worked_stretches(spark):
    rng = np.random.default_rng(3)
    rows, want = [], []
    for unit in range(12):
        start = 0
        for k in rng.integers(0, len(STRETCHES), 25):
            given, left = STRETCHES[k]
            rows += [(unit, start + t, c + 256) for t, c in given]
            want += [(unit, start + t, c) for t, c in left]
            start += 10 + int(rng.integers(0, 5))
    df = spark.createDataFrame(rows, "unit int, sample bigint, code int")
    got = w.collapse_overlaps(df, "unit", "sample", "code", [1, 2, 3], 2, rows_per_slice=9).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_trials_need_a_fresh_condition(spark):
    log = [(1, 10, 5), (1, 20, 20), (1, 30, 61), (1, 40, 24), (1, 50, 60), (1, 60, 6), (1, 70, 20), (1, 80, 62)]
    df = spark.createDataFrame(log, "unit int, sample bigint, code int")
    out = w.reconstruct_trials(
        df, "unit", ["sample"], "sample", "code", 1000.0, {5: "a", 6: "b"},
        {20: {60: "incorrect", 61: "correct", 69: "skipped"}, 24: {60: "incorrect", 62: "correct"}}, [20], rows_per_slice=3,
    ).orderBy("trial_index").toPandas()
    assert list(out.condition) == ["a", "missing", "b"]
    assert list(out.response_class) == ["correct", "incorrect", "missing_or_unexpected"]
    assert list(out.sequence_valid) == [True, False, False]
    assert out.rt_ms[0] == 10.0 and np.isnan(out.rt_ms[2])


def widest(df, keys, order, size):
    """Rows of the fullest slice."""
    return o.add_slices(df, keys, order, size).groupBy("_slice").count().agg(F.max("count")).first()[0]


@pytest.mark.parametrize("value", [
    "case when id = 0 then 1e9 else id end",  # an outlier
    "case when id = 0 then double('nan') else id end",  # one NaN
    "case when id % 3 = 0 then null else id end",  # many nulls
    "concat('Customer#', lpad(id, 9, '0'))",  # texts with a long common start
    "case when id % 10 > 0 then 7 else id end",  # one value with nine rows in ten
])
@pytest.mark.parametrize("keys", [["g"], []])
def test_no_slice_holds_twice_the_target(spark, value, keys):
    df = spark.range(20_000).selectExpr("id", "case when id % 100 = 0 then id end as g", f"{value} as x")
    assert widest(df, keys, ["x"], 500) <= 1000


def test_null_keys_and_null_order_follow_sort_order(spark):
    df = spark.createDataFrame(
        [(None, 1.0), (None, None), (None, 3.0), ("a", float("nan")), ("a", None), ("a", 2.0)], "g string, x double"
    )
    out = {(r.g, str(r.x)): (r.i, r.n) for r in o.row_index(df, ["g"], ["x"], "i", total="n", rows_per_slice=1).collect()}
    assert out == {(None, "None"): (1, 3), (None, "1.0"): (2, 3), (None, "3.0"): (3, 3), ("a", "None"): (1, 3), ("a", "2.0"): (2, 3), ("a", "nan"): (3, 3)}
    stats = o.with_group_stats(df, ["g"], m=F.count("x")).collect()
    assert len(stats) == 6 and {r.m for r in stats} == {2}
    ranks = o.average_rank(df, ["g"], "x", "r", rows_per_slice=1).collect()
    assert len(ranks) == 6 and sorted(r.r for r in ranks if r.g is None and r.x is not None) == [1.0, 2.0]


@pytest.mark.parametrize("most", [100_000, 64])
def test_ordered_mean_adds_one_by_one(spark, most):
    """To the last digit the sum of one loop; a unit over the limit is added by parts, the same on any cut of the rows."""
    rng = np.random.default_rng(8)
    n = 2000
    pdf = pd.DataFrame({"u": np.where(rng.random(n) < 0.3, 0, rng.integers(1, 90, n)), "k": np.arange(n), "x": rng.lognormal(size=n) / 3.0})
    pdf["x"] = pdf.x.mask(pdf.u == 5)
    df = spark.createDataFrame(pdf.sample(frac=1, random_state=1)).withColumn("x", F.nanvl("x", F.lit(None).cast("double")))
    got = {r.u: r.m for r in o.ordered_mean(o.in_order(df.repartition(16), "u", "k", most), ["u"], F.col("x"), "m").collect()}
    for u, g in pdf.groupby("u"):
        part = g.k // most if len(g) > most else g.k * 0
        sums = [_added(p.x.dropna()) for _, p in g.groupby(part)]
        want = _added(sums) / g.x.count() if g.x.count() else None
        assert got[u] == want


def _added(values):
    total = 0.0
    for v in values:  # sum() of Python 3.12 and later compensates
        total += float(v)
    return total


def test_losses_do_not_depend_on_the_cut_of_the_table(spark, tmp_path):
    """The orders of a unit lie in eight files, which tasks read (failed with sums per task)."""
    from mensura.plans.q_aggregates import losses

    rng = np.random.default_rng(9)
    n = 1600
    orders = pd.DataFrame({"o_orderkey": np.arange(n), "o_custkey": rng.integers(0, 40, n), "o_orderstatus": "F", "o_totalprice": np.round(rng.uniform(900, 500_000, n), 2)})
    people = pd.DataFrame({"c_custkey": np.arange(40), "c_acctbal": np.round(rng.uniform(-999, 9999, 40), 2), "c_mktsegment": "A"})
    spark.createDataFrame(people).write.parquet(f"{tmp_path}/customer.parquet")
    for low in range(0, n, n // 8):
        spark.createDataFrame(orders[low:low + n // 8]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/orders.parquet")
    got = {r.unit: r.loss for r in losses(spark, str(tmp_path)).filter("outcome = 'amount' and model = 'extended'").collect()}
    joined = orders.merge(people, left_on="o_custkey", right_on="c_custkey").sort_values("o_orderkey")
    joined["e"] = (joined.o_totalprice / 100003.0 - (2.4 + 0.3 * (joined.c_acctbal / 10000.0))).abs()
    assert got == {u: _added(g.e) / len(g) for u, g in joined.groupby("o_custkey")}


def test_equal_losses_are_numbered_by_unit(spark, tmp_path):
    """Three copies of the units, cut at other places by the files: equal losses stay equal (failed with sums per task)."""
    from mensura.plans import catalog

    rng = np.random.default_rng(10)
    n, m = 1000, 30
    orders = pd.DataFrame({"o_orderkey": np.arange(n), "o_custkey": rng.integers(0, m, n), "o_orderstatus": "F", "o_totalprice": np.round(rng.uniform(900, 500_000, n), 2)})
    people = pd.DataFrame({"c_custkey": np.arange(m), "c_acctbal": np.round(rng.uniform(-999, 9999, m), 2), "c_mktsegment": "A"})
    copied = lambda df, **shift: pd.concat([df.assign(**{c: df[c] + i * by for c, by in shift.items()}) for i in range(3)], ignore_index=True)
    spark.createDataFrame(copied(people, c_custkey=m)).write.parquet(f"{tmp_path}/customer.parquet")
    every = copied(orders, o_orderkey=n, o_custkey=m)
    for low in range(0, 3 * n, 430):
        spark.createDataFrame(every[low:low + 430]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/orders.parquet")
    got = [r.unit for r in catalog.QUERIES["w15_mass_numbering"](spark, str(tmp_path)).orderBy("cluster_id").collect()]
    assert len(got) == 3 * m and all(got[i:i + 3] == [got[i], got[i] + m, got[i] + 2 * m] for i in range(0, 3 * m, 3))
