import pytest
from pyspark.sql import functions as F

from mensura.operators import aggregates as a
from mensura.operators import guards, joins
from mensura.operators import signal as g
from mensura.sources import sinks, tables


def test_accuracy_keeps_omissions(spark):
    df = spark.createDataFrame([(1, "A", True, 400.0), (1, "A", False, 500.0), (1, "A", False, None)], "unit int, condition string, correct boolean, rt_ms double")
    row = a.behaviour_summary(df, ["unit", "condition"]).first()
    assert (row.accuracy, row.median_correct_rt_ms, row.inverse_efficiency_ms) == (pytest.approx(1 / 3), 400.0, pytest.approx(1200.0))


def test_dprime_stays_finite(spark):
    row = spark.createDataFrame([(30, 0, 0, 170)], "h int, m int, f int, c int").select(a.corrected_dprime("h", "m", "f", "c").alias("d")).first()
    assert 4 < row.d < 6


def test_weighted_mean_skips_missing(spark):
    df = spark.createDataFrame([(1, 2.0, 3), (1, None, 9), (1, 5.0, 0), (2, None, 4)], "u int, x double, n int")
    out = {r.u: r.w for r in df.groupBy("u").agg(a.weighted_mean("x", "n").alias("w")).collect()}
    assert out == {1: 2.0, 2: None}


def test_single_row_accepts_text_booleans(spark):
    df = spark.createDataFrame([("a", "True", 1), ("b", "False", 2)], "k string, flag string, v int")
    assert guards.single_row(df, flag=False).first().v == 2
    with pytest.raises(Exception, match="expected one row"):
        guards.single_row(df, k="zzz").collect()


def test_one_to_one_fails_on_repeats(spark):
    left = spark.createDataFrame([(1, "x"), (1, "y")], "k int, a string")
    with pytest.raises(Exception, match="repeated key"):
        joins.one_to_one(left, spark.createDataFrame([(1, 2.0)], "k int, b double"), ["k"]).collect()


def test_null_group_keys_are_kept_in_trial_summary(spark):
    df = spark.createDataFrame([("a", None, 1.0, True, True), ("a", "c", 3.0, False, True), ("a", None, None, True, False)],
                               "condition string, congruency string, rt double, ok boolean, valid boolean")
    out = {r.congruency: (r.n_trials, r.median_rt) for r in a.trial_summary(df, ["condition", "congruency"], "rt", "ok", "valid").collect()}
    assert out == {None: (2, 1.0), "c": (1, 3.0)}


def test_forbidden_labels_and_empty_band():
    assert guards.forbidden_labels(["mean_ITPC", "n"], ["itpc", "snr"]) == ["itpc"]
    with pytest.raises(ValueError, match="none of the frequencies"):
        g.band_mean("power", [0.0, 1.0], 5.0, 6.0)
    with pytest.raises(ValueError):
        g.trim(None, 5, 3)


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),)], "x double")
    assert guards.nan_to_null(df).filter("x > 0").count() == 1


def test_locked_phase_beats_random_phase(spark):
    import numpy as np

    rng = np.random.default_rng(6)
    rows = []
    for trial in range(30):
        shift = rng.uniform(0, 2 * np.pi)
        for s in range(128):
            noise = rng.normal(scale=0.2, size=2)
            rows.append((trial, "locked", s, float(np.sin(2 * np.pi * 8 * s / 128) + noise[0])))
            rows.append((trial, "random", s, float(np.sin(2 * np.pi * 8 * s / 128 + shift) + noise[1])))
    df = spark.createDataFrame(rows, "trial int, channel string, s int, x double")
    unit = g.demodulate(df, ["channel", "trial"], 8.0, 128.0, 16)
    itpc = {r.channel: r.itpc for r in g.mean_coherence(g.trim(unit, 32, 96), ["channel"]).collect()}
    assert itpc["locked"] > itpc["random"] + 0.3


def test_spectra_match_direct_transform(spark):
    import numpy as np

    rng = np.random.default_rng(9)
    n, fs, bins = 32, 32.0, list(range(17))
    x = rng.normal(size=(6, n)) + np.linspace(0, 3, n)
    df = spark.createDataFrame([(t, s, float(x[t, s])) for t in range(6) for s in range(n)], "trial int, s int, x double")

    def power(v):
        t = np.arange(n)
        w = 0.5 - 0.5 * np.cos(2 * np.pi * t / n)
        v = v - np.polyval(np.polyfit(t, v, 1), t)
        p = np.abs(np.fft.rfft(v * w)) ** 2 / (fs * (w**2).sum())
        p[1:-1] *= 2
        return p

    row = g.condition_spectra(g.coefficients(df, ["trial"], n, bins), [], n, fs, bins).first()
    assert np.allclose(row.evoked, power(x.mean(axis=0)))
    assert np.allclose(row.total, np.mean([power(v) for v in x], axis=0))
    assert np.allclose(row.induced, np.mean([power(v - x.mean(axis=0)) for v in x], axis=0))


def test_sources_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.5), (2, None)], "u int, x double")
    path = str(tmp_path / "t")
    sinks.write_table(df, path, ["u", "x"], "csv")
    assert tables.read_csv(spark, path, "u int, x double").orderBy("u").collect() == df.orderBy("u").collect()
    with pytest.raises(Exception):
        sinks.write_table(df, path, ["u", "x"], "csv")
    (tmp_path / "p.json").write_text('{"status": "draft",\n "replicates": 5}')
    with pytest.raises(ValueError, match="draft"):
        tables.read_protocol(spark, str(tmp_path / "p.json"), "frozen")
    assert tables.read_protocol(spark, str(tmp_path / "p.json"), "draft")["replicates"] == 5
    assert sinks.empty_table(spark, "a int, b string").columns == ["a", "b"]
    (tmp_path / "f.bin").write_bytes(b"abc")
    import hashlib

    assert tables.fingerprints(spark, str(tmp_path / "f.bin")).first().sha256 == hashlib.sha256(b"abc").hexdigest()


def test_windows_join_is_half_open(spark):
    samples = spark.createDataFrame([("r", i) for i in range(20)], "rec string, s bigint")
    windows = spark.createDataFrame([("r", 3, 7), ("r", 5, 18)], "rec string, lo bigint, hi bigint")
    out = joins.windows_join(samples, windows, ["rec"], "s", "lo", "hi", 5).groupBy("lo").agg(F.min("s").alias("a"), F.max("s").alias("b"), F.count("s").alias("n"))
    assert sorted(map(tuple, out.collect())) == [(3, 3, 6, 4), (5, 5, 17, 13)]


def test_compare_tables_reports_lone_rows_and_columns(spark):
    from mensura.operators import joins

    a = spark.createDataFrame([(1, None), (2, 2.0), (None, 3.0)], "k int, v double")
    b = spark.createDataFrame([(2, 2.5), (None, 3.0), (4, None)], "k int, v double")
    got = sorted(map(tuple, joins.compare_tables(a, b, ["k"]).collect()))
    assert got == [(1, "(row)", "present", None), (2, "v", "2.0", "2.5"), (4, "(row)", None, "present")]
    with pytest.raises(ValueError, match="one side only"):
        joins.compare_tables(a, b.withColumn("w", F.lit(1)), ["k"])


def test_null_keys_and_ids(spark):
    from mensura.operators import aggregates
    from mensura.sources import tables

    t = spark.createDataFrame([(1, 100.0, True, True), (None, 200.0, True, False), (None, 400.0, False, False)], "k int, rt double, p boolean, v boolean")
    assert {r.k: (r.n_trials, r.median_rt) for r in aggregates.trial_summary(t, ["k"], "rt", "p", "v").collect()} == {1: (1, 100.0), None: (2, 300.0)}
    files = spark.createDataFrame([("1", 1, "A"), ("1", 1, "B"), ("2", None, "A"), ("2", None, "B"), ("3", 3, "A"), ("3", 3, None)], "file_unit string, unit int, c string")
    want = spark.createDataFrame([(1,), (2,), (3,), (9,)], "unit int")
    found = sorted(map(tuple, tables.unit_table_violations(files, "unit", "c", ["A", "B"], want).collect()))
    assert found == [("2", "unit_mismatch"), ("3", "condition_mismatch"), ("9", "missing")]


def test_artifacts_with_nan_are_not_rejected(spark):
    from mensura.operators import signal

    rows = [(1, i, True, 10.0 + i % 3, 5.0 + i % 2) for i in range(12)] + [(1, 99, True, float("nan"), float("nan"))]
    epochs = spark.createDataFrame(rows, "unit int, trial int, within_bounds boolean, median_ptp double, roi_ptp double")
    out = {r.trial: r.rejection_reason for r in signal.epoch_artifacts(epochs, ["unit"]).collect()}
    assert out[99] == "" and set(out.values()) == {""}


def test_nearest_neighbours_of_named_nodes(spark):
    import numpy as np

    from mensura.operators import graph

    draw = np.random.default_rng(5)
    v = draw.normal(size=(60, 3))
    named = spark.createDataFrame([(f"ch{i}", x.tolist()) for i, x in enumerate(v)], "node string, v array<double>")
    numbered = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "node bigint, v array<double>")
    of = lambda df: sorted((str(r.id).removeprefix("ch"), str(r.other).removeprefix("ch"), round(r.dist, 9)) for r in graph.nearest_neighbours(df, "node", "v", 4, fan=5, block_rows=9).collect())
    assert of(named) == of(numbered) and len(of(named)) == 240
