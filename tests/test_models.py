"""Models against direct NumPy fits on a few hundred rows."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from mensura.operators import models as m


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(21)
    n, units = 400, 16
    unit = rng.integers(0, units, n)
    effect = rng.normal(size=units)[unit]
    a, b = rng.normal(size=n), rng.normal(size=n)
    g = rng.integers(0, 3, n)
    y = 1 + 0.5 * a - 0.3 * b + 0.2 * (g == 1) + effect + rng.normal(size=n) * (1 + 0.5 * np.abs(a))
    z = (rng.random(n) < 1 / (1 + np.exp(-(0.3 + 0.8 * a - 0.4 * b + 0.5 * effect)))).astype(float)
    pdf = pd.DataFrame({"row": np.arange(n), "unit": unit, "a": a, "b": b, "g1": (g == 1) * 1.0, "g2": (g == 2) * 1.0, "y": y, "z": z})
    return pdf, spark.createDataFrame(pdf).cache()


def design(pdf, cols):
    return np.column_stack([np.ones(len(pdf)), pdf[cols]])


def test_hc3(data):
    pdf, df = data
    cols = ["a", "b", "g1"]
    row = m.ols_hc3(df, [], cols, "y").first()
    x, y = design(pdf, cols), pdf.y.to_numpy()
    inv = np.linalg.inv(x.T @ x)
    beta = inv @ x.T @ y
    e, h = y - x @ beta, np.einsum("ij,jk,ik->i", x, inv, x)
    cov = inv @ (x.T * (e / (1 - h)) ** 2) @ x @ inv
    assert np.allclose(row.beta, beta) and np.allclose(row.cov, cov.ravel())
    assert row.r_squared == pytest.approx(1 - (e @ e) / ((y - y.mean()) ** 2).sum())


def test_few_models_leave_the_rows_in_place_and_equal_the_sums_in_sql(data, spark, monkeypatch):
    pdf, _ = data
    rows = pdf.assign(model=np.where(pdf.unit < 14, "x", None), a=pdf.a.where(pdf.row % 50 != 0))
    df = spark.createDataFrame(rows[["model", "a", "b", "y"]].astype({"a": object}).where(rows[["model", "a", "b", "y"]].notna(), None), "model string, a double, b double, y double")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = m.standardised(df, ["model"], ["a", "y"])._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning" not in plan
        monkeypatch.setattr(m, "MATRIX_TERMS", 0)
        few = {r.model: r for r in m.ols_hc3(df, ["model"], ["a", "b"], "y").collect()}
        monkeypatch.setattr(m, "SENT_ROWS", 0)
        many = {r.model: r for r in m.ols_hc3(df, ["model"], ["a", "b"], "y").collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert set(few) == set(many) == {"x", None}
    for k in few:
        assert few[k].n == many[k].n and np.allclose(few[k].beta, many[k].beta) and np.allclose(few[k].cov, many[k].cov)


def test_closed_form_calibration_equals_general_fit(data):
    pdf, df = data
    row = m.calibration_hc3(df, [], "y", "a").first()
    fit = m.ols_hc3(df, [], ["a"], "y").first()
    assert [row.intercept, row.slope] == pytest.approx(fit.beta)
    assert [row.intercept_se**2, row.slope_se**2] == pytest.approx([fit.cov[0], fit.cov[3]])


def dummies(pdf):
    return np.column_stack([(pdf.unit == u).astype(float) for u in sorted(pdf.unit.unique())])


def test_cluster_ols_with_unit_effects(data):
    pdf, df = data
    row = m.cluster_ols(df, [], "unit", ["a", "b"], "y").first()
    x = np.column_stack([pdf[["a", "b"]], dummies(pdf)])
    inv = np.linalg.inv(x.T @ x)
    beta = inv @ x.T @ pdf.y
    e = pdf.y.to_numpy() - x @ beta
    meat = sum(np.outer(s, s) for s in (x[pdf.unit == u].T @ e[pdf.unit == u] for u in pdf.unit.unique()))
    n, k, g = len(pdf), x.shape[1], pdf.unit.nunique()
    cov = (g / (g - 1)) * ((n - 1) / (n - k)) * inv @ meat @ inv
    assert np.allclose(row.beta, beta[:2]) and np.allclose(np.reshape(row.cov, (2, 2)), cov[:2, :2])


def newton_logit(x, y, penalty=None, steps=40):
    beta = np.zeros(x.shape[1])
    penalty = np.zeros(x.shape[1]) if penalty is None else penalty
    for _ in range(steps):
        p = 1 / (1 + np.exp(-x @ beta))
        beta = beta + np.linalg.solve((x.T * (p * (1 - p))) @ x + np.diag(penalty), x.T @ (y - p) - penalty * beta)
    return beta, 1 / (1 + np.exp(-x @ beta))


def test_cluster_logit_with_unit_effects(data):
    pdf, df = data
    row = m.cluster_logit(df, "unit", ["a", "b"], "z").first()
    x, y = np.column_stack([pdf[["a", "b"]], dummies(pdf)]), pdf.z.to_numpy()
    beta, p = newton_logit(x, y)
    inv = np.linalg.inv((x.T * (p * (1 - p))) @ x)
    meat = sum(np.outer(s, s) for s in (x[pdf.unit == u].T @ (y - p)[pdf.unit == u] for u in pdf.unit.unique()))
    n, k, g = len(pdf), x.shape[1], pdf.unit.nunique()
    cov = (g / (g - 1)) * ((n - 1) / (n - k)) * inv @ meat @ inv
    assert np.allclose(row.beta, beta[:2], atol=1e-6) and np.allclose(np.reshape(row.cov, (2, 2)), cov[:2, :2], rtol=1e-4)


@pytest.mark.parametrize("binomial,outcome", [(True, "z"), (False, "y")])
def test_gee_exchangeable(data, binomial, outcome):
    pdf, df = data
    row = m.gee_exchangeable(df, "unit", ["a", "b"], outcome, binomial).first()
    x, y = design(pdf, ["a", "b"]), pdf[outcome].to_numpy()
    groups = [np.flatnonzero(pdf.unit == u) for u in pdf.unit.unique()]
    beta, rho, p = np.zeros(3), 0.0, 3
    for _ in range(60):
        mu = 1 / (1 + np.exp(-x @ beta)) if binomial else x @ beta
        v = mu * (1 - mu) if binomial else np.ones(len(y))
        r = (y - mu) / np.sqrt(v)
        bread, score, meat = np.zeros((p, p)), np.zeros(p), np.zeros((p, p))
        for i in groups:
            k = len(i)
            inner = np.linalg.inv(np.sqrt(np.outer(v[i], v[i])) * ((1 - rho) * np.eye(k) + rho))
            d = x[i] * v[i][:, None]
            s = d.T @ inner @ (y[i] - mu[i])
            bread += d.T @ inner @ d
            score += s
            meat += np.outer(s, s)
        beta = beta + np.linalg.solve(bread, score)
        scale = (r @ r) / (len(y) - p)
        pairs = sum(len(i) * (len(i) - 1) / 2 for i in groups)
        rho = sum((r[i].sum() ** 2 - (r[i] ** 2).sum()) / 2 for i in groups) / scale / (pairs - p)
    inv = np.linalg.inv(bread)
    assert np.allclose(row.beta, beta, atol=1e-6) and row.working_correlation == pytest.approx(rho, abs=1e-6)
    assert np.allclose(row.cov, (inv @ meat @ inv).ravel(), rtol=1e-4)


def ridge_predict(train, test, numeric, flags, alpha, target):
    mean, sd = train[numeric].mean(), train[numeric].std(ddof=0)
    prep = lambda d: np.column_stack([(d[numeric] - mean) / sd, d[flags]])
    x, y = prep(train), train[target].to_numpy()
    xc = x - x.mean(axis=0)
    w = np.linalg.solve(xc.T @ xc + alpha * np.eye(x.shape[1]), xc.T @ (y - y.mean()))
    return y.mean() + (prep(test) - x.mean(axis=0)) @ w


def test_leave_unit_out_ridge(data):
    pdf, df = data
    sets = {"base": ["a", "g1"], "extended": ["a", "b", "g1", "g2"]}
    out = m.leave_unit_out_ridge(df, [], "unit", ["a", "b"], ["g1", "g2"], sets, "y").toPandas()
    for u in (0, 7):
        train, test = pdf[pdf.unit != u], pdf[pdf.unit == u]
        for name, numeric, flags in (("base", ["a"], ["g1"]), ("extended", ["a", "b"], ["g1", "g2"])):
            got = out[(out.unit == u) & (out.model == name)].sort_values("observed").predicted
            want = pd.Series(ridge_predict(train, test, numeric, flags, 1.0, "y"), index=test.index).loc[test.sort_values("y").index]
            assert np.allclose(got, want)


def test_leave_unit_out_logistic(data):
    pdf, df = data
    out = m.leave_unit_out_logistic(df, "unit", ["a", "b"], ["g1"], {"all": ["a", "b", "g1"]}, "z", folds_per_block=6, rows_per_block=90).toPandas()
    for u in (2, 11):
        train, test = pdf[pdf.unit != u], pdf[pdf.unit == u]
        mean, sd = train[["a", "b"]].mean(), train[["a", "b"]].std(ddof=0)
        prep = lambda d: np.column_stack([np.ones(len(d)), (d[["a", "b"]] - mean) / sd, d.g1])
        beta, _ = newton_logit(prep(train), train.z.to_numpy(), np.array([0.0, 1, 1, 1]))
        assert np.allclose(np.sort(out[out.unit == u].predicted), np.sort(1 / (1 + np.exp(-prep(test) @ beta))), atol=1e-6)


def test_held_out_logits_read_rows_once_per_step_unless_a_unit_is_large(spark, monkeypatch):
    rng = np.random.default_rng(5)
    n = 20_000
    pdf = pd.DataFrame({"unit": rng.integers(0, 400, n), "a": rng.normal(size=n), "b": rng.normal(size=n) + 3, "g1": rng.integers(0, 2, n) * 1.0})
    pdf.loc[:2500, "unit"] = 9999
    pdf["z"] = (rng.random(n) < 1 / (1 + np.exp(-(0.3 + 0.8 * pdf.a - 0.4 * pdf.b)))).astype(float)
    df, asked, product = spark.createDataFrame(pdf).cache(), [], m._block_product
    monkeypatch.setattr(m, "_block_product", lambda rows, fits, *rest: (asked.append(fits.count()), product(rows, fits, *rest))[1])
    sets, one = {"base": ["a"], "all": ["a", "b", "g1"]}, ["unit", "model", "predicted"]
    quick = m.leave_unit_out_logistic(df, "unit", ["a", "b"], ["g1"], sets, "z").toPandas().sort_values(one)
    assert max(asked) == 2, "only the large unit's fits meet all rows"
    exact = m.leave_unit_out_logistic(df, "unit", ["a", "b"], ["g1"], sets, "z", expand=False).toPandas().sort_values(one)
    assert len(quick) == 2 * n and np.allclose(quick.predicted, exact.predicted, atol=1e-9)


def test_repeated_folds_are_balanced_and_match_refit(data, spark):
    pdf, df = data
    out = m.repeated_fold_ridge(df, [], "row", ["a", "b"], ["g1"], {"all": ["a", "b", "g1"]}, "y", n_folds=7, repeats=2).toPandas()
    sizes = out.groupby(["repeat", "fold"]).size()
    assert len(sizes) == 14 and sizes.max() - sizes.min() <= 1 and (out.groupby("row").size() == 2).all()
    fold = out[(out["repeat"] == 1) & (out.fold == 3)].set_index("row")
    test = pdf[pdf.row.isin(fold.index)]
    want = ridge_predict(pdf[~pdf.row.isin(fold.index)], test, ["a", "b"], ["g1"], 1.0, "y")
    assert np.allclose(fold.predicted.loc[test.row], want)


def test_nested_ridge(data, spark):
    pdf, _ = data
    small = pdf.head(40)
    df = spark.createDataFrame(small)
    alphas = (0.1, 1.0, 10.0, 100.0)
    out = m.nested_ridge(df, "row", ["a", "b"], ["g1"], {"all": ["a", "b", "g1"]}, "y", outers_per_block=17, rows_per_block=15).toPandas().set_index("row")
    fold = m.assign_folds(df, [], "row", 5, 1, "inner").toPandas().set_index("row").fold
    for held in (0, 13, 39):
        train = small[small.row != held]
        errors = []
        for alpha in alphas:
            scores = []
            for k in range(5):
                inside = train.row.map(fold) == k
                p = ridge_predict(train[~inside], train[inside], ["a", "b"], ["g1"], alpha, "y")
                scores.append(np.abs(train[inside].y - p).mean())
            errors.append(np.mean(scores))
        best = alphas[int(np.argmin(errors))]
        assert out.loc[held].alpha == best
        assert out.loc[held].predicted == pytest.approx(ridge_predict(train, small[small.row == held], ["a", "b"], ["g1"], best, "y")[0])


def test_nested_ridge_meets_only_rows_whose_residual_may_turn(spark, monkeypatch):
    rng = np.random.default_rng(5)
    n, alphas = 90, (0.5, 1.0, 1.5, 2.0, 3.0, 5.0, 8.0, 13.0)
    pdf = pd.DataFrame({"row": np.arange(n), "a": rng.standard_t(2, n), "b": rng.normal(size=n)})
    pdf["y"] = 0.3 * pdf.a + 0.2 * pdf.b + rng.normal(size=n)
    pdf.loc[60:74, ["a", "b", "y"]] = pdf.loc[0:14, ["a", "b", "y"]].to_numpy()
    df = spark.createDataFrame(pdf)
    monkeypatch.setattr(m, "_block_product", None)  # all rows with all fits
    out = m.nested_ridge(df, "row", ["a", "b"], [], {"all": ["a", "b"]}, "y", alphas, outers_per_block=7, rows_per_block=4).toPandas().set_index("row")
    fold = m.assign_folds(df, [], "row", 5, 1, "inner").toPandas().set_index("row").fold
    for held in range(n):
        train = pdf[pdf.row != held]
        inside = [train.row.map(fold) == k for k in range(5)]
        errors = [np.mean([np.abs(train[i].y - ridge_predict(train[~i], train[i], ["a", "b"], [], alpha, "y")).mean() for i in inside]) for alpha in alphas]
        assert out.loc[held].alpha == alphas[int(np.argmin(errors))]
    # residuals of zero meet every fit
    exact = pdf.assign(y=2.0 * pdf.a)
    exact.loc[3, "y"] += 1.0
    line = m.nested_ridge(spark.createDataFrame(exact), "row", ["a"], [], {"all": ["a"]}, "y", (1e-9, 1.0), outers_per_block=7, rows_per_block=4).toPandas().set_index("row")
    assert (line.alpha == 1e-9).all() and np.allclose(line.predicted[3], 2.0 * pdf.a[3], atol=1e-6)


def test_influence_by_deletion(data):
    pdf, df = data
    out = m.influence(df, ["row"], ["a", "b"], "y", "a").toPandas().set_index("row")
    for i in (3, 250):
        rest = pdf[pdf.row != i]
        beta = np.linalg.lstsq(design(rest, ["a", "b"]), rest.y, rcond=None)[0]
        assert out.loc[i].loo_estimate == pytest.approx(beta[1])


def test_unit_slopes(data):
    pdf, df = data
    lin = m.unit_slopes_ols(df, "unit", ["a"], "y").toPandas().set_index("unit")
    log = m.unit_slopes_logit(df, "unit", ["a"], "z", iterations=20).toPandas().set_index("unit")
    for u in (1, 5):
        part = pdf[pdf.unit == u]
        assert lin.loc[u].slope_0 == pytest.approx(np.polyfit(part.a, part.y, 1)[0])
        if log.loc[u].largest_step < 1e-6:
            assert log.loc[u].slope_0 == pytest.approx(newton_logit(design(part, ["a"]), part.z.to_numpy())[0][1], abs=1e-5)


def test_variance_inflation_and_contrast(data):
    pdf, df = data
    vif = m.variance_inflation(df, ["a", "b", "g1"]).toPandas().set_index("term").vif
    want = np.diag(np.linalg.inv(np.corrcoef(pdf[["a", "b", "g1"]].T)))
    assert np.allclose(vif[["a", "b", "g1"]], want)
    fit = m.ols_hc3(df, [], ["a", "b"], "y")
    row, c = fit.first(), m.linear_contrasts(fit, [], {"mean": {"a": 1.0, "b": 0.5}}).first()
    w = np.array([0, 1, 0.5])
    assert c.estimate == pytest.approx(w @ row.beta) and c.std_error == pytest.approx(math.sqrt(w @ np.reshape(row.cov, (3, 3)) @ w))


def shifted_frames(spark, amount):
    rng = np.random.default_rng(12)
    pdf = pd.DataFrame({"g": np.repeat(["a", "b"], 60), "u": np.tile(np.arange(12), 10), "x": np.round(rng.normal(size=120), 3), "z": np.round(rng.normal(size=120), 3)})
    pdf["y"] = 1 + 2 * pdf.x - pdf.z + np.round(rng.normal(scale=0.5, size=120), 3)
    pdf["o"] = (pdf.x + rng.normal(size=120) > 0).astype(int)
    return spark.createDataFrame(pdf).withColumn("x", F.col("x") * 1024 + float(amount))


@pytest.mark.parametrize("kind", ["hc3", "cluster", "logit"])
def test_shifted_predictors_change_nothing(spark, kind):
    def fit(amount):
        df = shifted_frames(spark, amount)
        if kind == "hc3":
            models = m.ols_hc3(df, ["g"], ["x", "z"], "y")
        elif kind == "cluster":
            models = m.cluster_ols(df, ["g"], "u", ["x", "z"], "y")
        else:
            models = m.cluster_logit(df, "u", ["x", "z"], "o").withColumn("g", F.lit("all"))
        rows = m.coefficient_rows(models, ["g"]).filter("term <> 'Intercept'").orderBy("g", "term").collect()
        return np.array([(r.estimate, r.std_error) for r in rows])

    assert np.allclose(fit(0), fit(2**30), rtol=1e-6, atol=0)


def test_singular_groups_return_rows(spark):
    df = shifted_frames(spark, 0).withColumn("x", F.when(F.col("g") == "a", 7.0).otherwise(F.col("x")))
    df = df.withColumn("twice", 2 * F.col("z"))
    fits = {r.g: r for r in m.ols_hc3(df, ["g"], ["x", "z"], "y").collect()}
    assert (fits["a"]["rank"], fits["b"]["rank"]) == (2, 3) and all(np.isfinite(fits["a"].beta))
    both = m.ols_hc3(df, ["g"], ["z", "twice"], "y").collect()
    assert all(r["rank"] == 2 for r in both)
    alone = {r.g: r for r in m.ols_hc3(df, ["g"], ["z"], "y").collect()}
    for r in both:
        assert r.beta[1] + 2 * r.beta[2] == pytest.approx(alone[r.g].beta[1])
    one = m.cluster_ols(df.filter("u = 3"), ["g"], "u", ["x", "z"], "y").collect()
    assert len(one) == 2 and all(v is None for r in one for v in r["cov"])
    assert {r.vif for r in m.variance_inflation(df, ["z", "twice"]).collect()} == {float("inf")}


def test_held_out_models_take_text_units_and_shifted_columns(data, spark):
    pdf, _ = data
    named = pdf.assign(unit="s" + pdf.unit.astype(str), row="r" + pdf.row.astype(str), a=pdf.a + 1e9)
    df = spark.createDataFrame(named)
    plain = m.leave_unit_out_logistic(spark.createDataFrame(pdf), "unit", ["a", "b"], ["g1"], {"all": ["a", "b", "g1"]}, "z").toPandas()
    text = m.leave_unit_out_logistic(df, "unit", ["a", "b"], ["g1"], {"all": ["a", "b", "g1"]}, "z").toPandas()
    assert np.allclose(np.sort(plain.predicted), np.sort(text.predicted), atol=1e-5)
    ridge = m.leave_unit_out_ridge(df, [], "unit", ["a", "b"], ["g1"], {"all": ["a", "b", "g1"]}, "y").toPandas()
    want = m.leave_unit_out_ridge(spark.createDataFrame(pdf), [], "unit", ["a", "b"], ["g1"], {"all": ["a", "b", "g1"]}, "y").toPandas()
    assert np.allclose(np.sort(ridge.predicted), np.sort(want.predicted), atol=1e-5)
    nested = m.nested_ridge(df.limit(30), "row", ["a", "b"], ["g1"], {"all": ["a", "b", "g1"]}, "y").toPandas()
    assert len(nested) == 30 and nested.row.str.startswith("r").all()


def grouped_data(spark):
    """Three models with their own slopes and unit counts; one of them has only constant outcomes."""
    rng = np.random.default_rng(21)
    parts = []
    for g, units, slope in (("a", 9, 0.8), ("b", 14, -0.4), (None, 11, 0.1), ("constant", 4, 0.0)):
        n = 40 * units
        pdf = pd.DataFrame({"g": [g] * n, "u": np.repeat(np.arange(units), 40), "x": np.round(rng.normal(size=n), 3), "w": np.round(rng.normal(size=n), 3)})
        eta = slope * pdf.x + 0.3 * pdf.w + rng.normal(size=units)[pdf.u]
        pdf["o"] = (pdf.u % 2 if g == "constant" else rng.random(n) < 1 / (1 + np.exp(-eta))).astype(float)
        pdf["y"] = eta + rng.normal(size=n)
        parts.append(pdf)
    rows = [(r.g if isinstance(r.g, str) else None, int(r.u), r.x, r.w, r.o, r.y) for r in pd.concat(parts).itertuples()]
    return spark.createDataFrame(rows, "g string, u int, x double, w double, o double, y double")


def fitted(models):
    return {r.g: (*r.beta, *r.cov, r.n) for r in models.collect()}


def test_grouped_logits_equal_single_fits(spark):
    df = grouped_data(spark)
    got = fitted(m.cluster_logit(df, "u", ["x", "w"], "o", ["g"]))
    assert set(got) == {"a", "b", None}
    for g, found in got.items():
        single = m.cluster_logit(df.filter(F.col("g").eqNullSafe(g)), "u", ["x", "w"], "o").withColumn("g", F.lit(g)).first()
        assert np.allclose(found, (*single.beta, *single.cov, single.n), rtol=1e-7, atol=1e-10)


def test_steps_of_logits_meet_blocks_and_large_units_are_cut(spark, monkeypatch):
    df = grouped_data(spark).withColumn("u", F.when(F.col("u") > 0, F.col("u").cast("bigint") + 2**60))  # one unit is null
    met, attach = [], m.attach_few
    monkeypatch.setattr(m, "attach_few", lambda rows, table, *rest: (met.append(rows.count()) if "_beta" in table.columns else None, attach(rows, table, *rest))[1])
    whole = fitted(m.cluster_logit(df, "u", ["x", "w"], "o", ["g"]))
    assert len(met) > 3 and max(met) <= 100 < df.count()
    small = fitted(m.cluster_logit(df.filter("g = 'a'"), "u", ["x", "w"], "o", ["g"]))
    monkeypatch.setattr(m, "UNIT_ROWS", 15)
    cut = fitted(m.cluster_logit(df, "u", ["x", "w"], "o", ["g"]))
    assert set(whole) == set(cut) == {"a", "b", None}
    for g in whole:
        assert np.allclose(whole[g], cut[g], rtol=1e-7, atol=1e-10)
    assert np.allclose(whole["a"], small["a"], rtol=1e-7, atol=1e-10)


def test_grouped_equations_equal_single_fits(spark):
    df = grouped_data(spark).filter("g is null or g <> 'constant'")
    mixed = df.withColumn("value", F.when(F.col("g") == "b", F.col("y")).otherwise(F.col("o")))
    got = fitted(m.gee_exchangeable(mixed, "u", ["x", "w"], "value", ~F.col("g").eqNullSafe("b"), ["g"]))
    assert set(got) == {"a", "b", None}
    for g, found in got.items():
        own = df.filter(F.col("g").eqNullSafe(g))
        single = m.gee_exchangeable(own, "u", ["x", "w"], "y" if g == "b" else "o", g != "b").first()
        assert np.allclose(found, (*single.beta, *single.cov, single.n), rtol=1e-7, atol=1e-10)


def test_sweep_has_both_outcomes_of_every_specification(spark):
    from mensura.plans import q_reports
    from mensura.plans.catalog import QUERIES

    folder = "/root/testdata/sf0.001"
    got = {(r.specification, r.analysis, r.term): (r.estimate, r.std_error) for r in QUERIES["c7_specification_sweep"](spark, folder).collect()}
    assert {k[:2] for k in got} == {(s, a) for s in ("main", "strict", "without_first_unit", "envelope") for a in ("accuracy", "log_rt")}
    assert len(got) == 8 * (len(q_reports.SWEEP_TERMS) + len(q_reports.SWEEP_CONTRASTS))
    rows, columns = q_reports.sweep_rows(spark, folder)
    for specification in ("strict", "envelope"):
        single = m.cluster_logit(rows.filter(F.col("specification") == specification), "unit", columns, "correct").first()
        for i, term in enumerate(columns[:5]):
            want = single.beta[i], np.sqrt(single.cov[i * len(columns) + i])
            assert np.allclose(got[specification, "accuracy", term], want, atol=2e-6)
