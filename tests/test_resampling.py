import hashlib
import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from mensura.functions.scalar import dot
from mensura.operators import graph
from mensura.operators import resampling as r


@pytest.fixture(scope="module")
def values(spark):
    rng = np.random.default_rng(11)
    pdf = pd.DataFrame({"m": ["a"] * 20 + ["b"] * 12, "unit": list(range(20)) + list(range(12)), "d": np.r_[rng.normal(0.4, 1, 20), rng.normal(0, 1, 12)]})
    return pdf, spark.createDataFrame(pdf)


def test_constant_difference_has_full_direction(spark):
    df = spark.createDataFrame([("x", i, 2.0) for i in range(6)], "m string, unit int, d double")
    row = r.one_sample_t(df, ["m"], "d").first()
    assert row["mean"] == 2.0 and row["direction_fraction"] == 1.0 and row["t"] is None


def test_exact_signed_rank_by_enumeration(values):
    pdf, df = values
    out = r.signed_rank(df, ["m"], "d").toPandas().set_index("m")
    d = pdf[pdf.m == "b"].d.to_numpy()
    ranks = np.abs(d).argsort().argsort() + 1
    observed = min(ranks[d > 0].sum(), ranks[d < 0].sum())
    sums = np.array([np.dot(s, ranks) for s in itertools.product((0, 1), repeat=len(d))])
    assert out.loc["b"].is_exact and out.loc["b"].p_wilcoxon == pytest.approx(min(1, 2 * np.mean(sums <= observed)))


def test_sign_flips_repeat_and_match_direct_sums(values):
    pdf, df = values
    first = r.sign_flip_sums(df, ["m"], "unit", "d", "s", 40).toPandas().sort_values(["m", "rep"]).signed_sum.to_numpy()
    again = r.sign_flip_sums(df.repartition(5), ["m"], "unit", "d", "s", 40).toPandas().sort_values(["m", "rep"]).signed_sum.to_numpy()
    assert np.allclose(first, again) and len(first) == 80 and len(np.unique(np.round(first, 9))) > 40
    test = r.sign_flip_test(df, ["m"], "unit", "d", "s", 999).toPandas().set_index("m")
    assert 0.001 <= test.p_value.min() and test.loc["a"].observed == pytest.approx(pdf[pdf.m == "a"].d.mean())
    rng = np.random.default_rng(0)
    d = pdf[pdf.m == "a"].d.to_numpy()
    null = np.abs((rng.choice([-1, 1], (20000, 20)) * d).mean(axis=1))
    assert test.loc["a"].p_value == pytest.approx((null >= abs(d.mean())).mean(), abs=0.05)


@pytest.mark.parametrize("held", [1 << 23, 40])
def test_signs_are_hash_bits_of_any_unit_and_no_row_is_made_per_block(spark, monkeypatch, held):
    units = [None, "", "7", "u" * 80, "längerer Name", "x" * 43, *map(str, range(20))]
    rows = [(k, u, 0.1 + i) for k in ("a", None) for i, u in enumerate(units) if k or i % 3]
    df = spark.createDataFrame(rows, "k string, unit string, d double")
    monkeypatch.setattr(r, "FLIP_SUMS", held, raising=False)
    monkeypatch.setattr(r, "FLIP_HASHES", 1000, raising=False)
    sums = r.sign_flip_sums(df, ["k"], "unit", "d", "s", 400)
    got = {(s.k, s.rep): s.signed_sum for s in sums.collect()}
    assert len(got) == 800
    for (k, rep), total in got.items():
        bits = {u: int(hashlib.md5(f"s|{rep // 32}{'' if u is None else '|' + u}".encode()).hexdigest()[:8], 16) >> rep % 32 & 1 for u in units}
        assert total == pytest.approx(sum(d if bits[u] else -d for g, u, d in rows if g == k))
    before_shuffle = sums._jdf.queryExecution().optimizedPlan().toString().split("Aggregate")[-1]
    assert "Generate" not in before_shuffle and "md5" not in before_shuffle


def test_bootstrap_interval_matches_reference_within_noise(values):
    pdf, df = values
    out = r.bootstrap_mean(df, ["m"], "unit", "d", "b", 1500).toPandas().set_index("m")
    d = pdf[pdf.m == "a"].d.to_numpy()
    rng = np.random.default_rng(1)
    means = rng.choice(d, (20000, 20)).mean(axis=1)
    assert out.loc["a"].ci_low == pytest.approx(np.quantile(means, 0.025), abs=0.06)
    assert out.loc["a"].ci_high == pytest.approx(np.quantile(means, 0.975), abs=0.06)


def counted(n, key, replicates, block_rows):
    """How often each row of a group is drawn, block by block."""
    out = []
    for block, first in enumerate(range(0, n, block_rows)):
        rows = min(block_rows, n - first)
        out.append(np.concatenate([c for _, c in r.draw_counts(rows, n, block, key, replicates, block_rows)]))
    return np.concatenate(out, axis=1)


@pytest.mark.parametrize("n,block_rows", [(50, 8192), (50, 7), (400, 32)])
def test_counts_are_multinomial(n, block_rows):
    counts = counted(n, "k", 3000, block_rows)
    assert (counts.sum(axis=1) == n).all()
    assert abs(counts.mean(axis=0) - 1).max() < 0.12
    assert counts.var() == pytest.approx(1 - 1 / n, rel=0.02)  # Binomial(n, 1 / n)
    half = counts[:, : n // 2].sum(axis=1)
    assert half.var() == pytest.approx(n / 4, rel=0.12)
    assert abs(np.corrcoef(counts[:-1, 0], counts[1:, 0])[0, 1]) < 0.08


@pytest.mark.parametrize("block_rows", [8192, 6])
@pytest.mark.parametrize("cells", [1 << 20, 100])
def test_bootstraps_equal_drawn_rows(spark, monkeypatch, block_rows, cells):
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({"k": [None] * 23 + ["b"] * 9, "u": rng.permutation(32), "x": rng.integers(0, 9, 32).astype(float), "y": rng.normal(size=32).round(1)})
    df = spark.createDataFrame([(r.k if isinstance(r.k, str) else None, int(r.u), r.x, r.y) for r in pdf.itertuples()], "k string, u int, x double, y double")
    monkeypatch.setattr(r, "COUNT_CELLS", cells)
    sums = {(s.k, s.rep): (s.n, s.s0, s.s1) for s in r.bootstrap_sums(df, ["k"], "u", ["x", "y"], 3, 40, block_rows).collect()}
    ranks = {(s.k, s.rep): s.rho for s in r.bootstrap_rank_correlation(df, ["k"], "u", "x", "y", 3, 40, block_rows).collect()}
    assert len(sums) == len(ranks) == 80
    for k, key in ((None, "3"), ("b", "3|b")):
        own = pdf[pdf.k.isna() if k is None else pdf.k == k].sort_values("u")
        for rep, row in enumerate(counted(len(own), key, 40, block_rows)):
            drawn = own.iloc[np.repeat(np.arange(len(own)), row)]
            assert np.allclose(sums[k, rep], (len(drawn), drawn.x.sum(), drawn.y.sum()))
            assert ranks[k, rep] == pytest.approx(drawn.x.rank().corr(drawn.y.rank()))


@pytest.mark.parametrize("shares", [(1 << 24, 1 << 28), (16, 200)])
def test_groups_of_several_blocks_are_ranked_in_tasks(spark, monkeypatch, shares):
    rng = np.random.default_rng(9)
    pdf = pd.DataFrame({"k": [None] * 40 + ["b"] * 25, "u": rng.permutation(65), "x": rng.integers(0, 9, 65).astype(float), "y": rng.normal(size=65).round(1)})
    df = spark.createDataFrame([(r.k if isinstance(r.k, str) else None, int(r.u), r.x, r.y) for r in pdf.itertuples()], "k string, u int, x double, y double")
    run = lambda: {(s.k, s.rep): s.rho for s in r.bootstrap_rank_correlation(df, ["k"], "u", "x", "y", 3, 30, 6).collect()}
    monkeypatch.setattr(r, "RANKED_ROWS", 6, raising=False)
    ordered = run()
    monkeypatch.setattr(r, "RANKED_ROWS", 100)
    monkeypatch.setattr(r, "TASK_CELLS", shares, raising=False)

    def no_rows(*_, **__):
        raise AssertionError("drawn rows left the task")

    monkeypatch.setattr(r, "rank_table", no_rows)
    inside = run()
    assert len(ordered) == 60 and inside == {k: pytest.approx(v) for k, v in ordered.items()}


def test_undefined_replicates_are_null(spark):
    df = spark.createDataFrame([(u, 1.0, float(u)) for u in range(6)], "u int, x double, y double")
    for block_rows in (8192, 2):
        assert {s.rho for s in r.bootstrap_rank_correlation(df, [], "u", "x", "y", 1, 5, block_rows).collect()} == {None}


def test_perfect_rank_order_has_reliability_one(spark):
    df = spark.createDataFrame([("c", i, float(i), float(i * i)) for i in range(8)], "k string, unit int, x double, y double")
    row = r.bootstrap_split_half(df, ["k"], "unit", "x", "y", "q", 100).first()
    assert row["spearman_brown"] == pytest.approx(1.0) and row["ci_low"] == pytest.approx(1.0)


def test_loss_increment_direction(spark):
    rows = [("d", "o", u, m, v) for u, (b, e) in enumerate([(2.0, 1.0), (1.5, 1.0), (1.0, 1.2)]) for m, v in (("base", b), ("extended", e))]
    df = spark.createDataFrame(rows, "dataset string, outcome string, unit int, model string, loss double")
    row = r.loss_audit(df, ["dataset", "outcome"], "unit", "s", 99).first()
    assert row["observed"] == pytest.approx((-1.0 - 0.5 + 0.2) / 3) and row["fraction_improved"] == pytest.approx(2 / 3)
    assert row["loo_min"] == pytest.approx(-0.75) and row["loo_max"] == pytest.approx(-0.15)


def chain(spark, n):
    return spark.createDataFrame([(i, j) for i in range(n) for j in (i - 1, i + 1) if 0 <= j < n], "a int, b int")


def test_no_cluster_gives_empty_result_with_columns(spark):
    rng = np.random.default_rng(2)
    rows = [("m", u, c, float(v)) for c in range(4) for u, v in enumerate((lambda z: z - z.mean())(rng.normal(size=10)))]
    df = spark.createDataFrame(rows, "metric string, unit int, channel int, difference double")
    out = r.cluster_permutation(df, chain(spark, 4), ["metric"], "channel", "unit", "difference", 1, 50)
    assert out.columns == ["metric", "cluster_id", "sign", "channels", "n_channels", "cluster_mass", "p_value"] and out.count() == 0


def test_strong_neighbours_form_one_cluster(spark):
    rng = np.random.default_rng(2)
    rows = [("m", u, c, float(rng.normal(2.0 if c in (1, 2, 3) else 0.0))) for c in range(6) for u in range(15)]
    df = spark.createDataFrame(rows, "metric string, unit int, channel int, difference double")
    top = r.cluster_permutation(df, chain(spark, 6), ["metric"], "channel", "unit", "difference", 1, 200).orderBy("cluster_id").first()
    assert {"1", "2", "3"} <= set(top.channels.split(";")) and top.sign == 1 and top.p_value < 0.02


def test_components_on_long_chain_and_hub(spark):
    n = 40
    nodes = spark.createDataFrame([("g", i) for i in range(n)] + [("g", 100 + i) for i in range(30)], "k string, node int")
    links = [("g", i, i + 1) for i in range(n - 1)] + [("g", 100, 100 + i) for i in range(1, 30)]
    edges = spark.createDataFrame(links + [(k, b, a) for k, a, b in links], "k string, a int, b int")
    out = graph.connected_components(nodes, edges, ["k"], "node").toPandas()
    assert set(out[out.node < n].component) == {0} and set(out[out.node >= 100].component) == {100}


@pytest.mark.parametrize("fan,block", [(64, 1000), (6, 9)])
def test_nearest_neighbours_exact_with_pruning(spark, fan, block):
    rng = np.random.default_rng(8)
    # well separated clusters, so that cells are really pruned
    centres = rng.normal(size=(5, 3)) * 10
    v = np.vstack([c + rng.normal(scale=0.2, size=(24, 3)) for c in centres])
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id bigint, v array<double>")
    got = graph.nearest_neighbours(df, "id", "v", 4, fan=fan, block_rows=block).toPandas()
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    dist = np.arccos(np.clip(u @ u.T, -1, 1))
    np.fill_diagonal(dist, np.inf)
    want = {(i, j) for i in range(len(v)) for j in np.argsort(dist[i])[:4]}
    assert {(r.id, r.other) for r in got.itertuples()} == want
    placed, nodes = graph.neighbour_cells(df.select("id", F.transform("v", lambda x: x / F.sqrt(dot("v", "v"))).alias("v")), fan, block)
    sizes = {r.cell: r["size"] for r in nodes.filter("leaf").collect()}
    assert sum(sizes.values()) == len(v) == placed.join(nodes.filter("leaf"), "cell").count() and max(sizes.values()) <= block
    compared = sum(sizes[r.cell] * sizes[r.other_cell] for r in graph.cell_pairs(nodes, 4).collect())
    assert compared == len(v) ** 2 if block == 1000 else compared < 0.5 * len(v) ** 2


def test_equal_vectors_stay_in_one_cell(spark):
    rows = [(i, [1.0, 0.0]) for i in range(40)] + [(100 + i, [0.0, 1.0 + i]) for i in range(3)] + [(200, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "id bigint, v array<double>")
    got = graph.nearest_neighbours(df, "id", "v", 2, fan=3, block_rows=5).collect()
    nearest = {}
    for r in got:
        nearest.setdefault(r.id, []).append((r.rank, r.other, round(r.dist, 6)))
    assert len(got) == 2 * len(rows) and sorted(nearest[0]) == [(1, 1, 0.0), (2, 2, 0.0)] and sorted(nearest[39]) == [(1, 0, 0.0), (2, 1, 0.0)]
    assert sorted(nearest[101]) == [(1, 100, 0.0), (2, 102, 0.0)] and {o for _, o, _ in nearest[200]} <= {0, 1, 100, 101}


def test_channel_correlations_with_gaps(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 4))
    x[rng.random(x.shape) < 0.2] = np.nan
    df = spark.createDataFrame([(int(s), c, float(x[s, c])) for s in range(60) for c in range(4) if np.isfinite(x[s, c])], "s int, c int, x double")
    got = graph.channel_correlations(df, [], "c", [0, 1, 2, 3], "s", "x").toPandas().set_index(["a", "b"]).r
    want = pd.DataFrame(x).corr()
    assert all(got[(i, j)] == pytest.approx(want.loc[i, j]) for i in range(4) for j in range(4) if i != j)


def test_text_units(values):
    pdf, df = values
    named = df.selectExpr("m", "concat('sub-', lpad(cast(unit as string), 3, '0')) as unit", "d")
    out = r.bootstrap_mean(named, ["m"], "unit", "d", "b", 200).toPandas().set_index("m")
    assert out.loc["a"].ci_low < pdf[pdf.m == "a"].d.mean() < out.loc["a"].ci_high
    flips = r.sign_flip_test(named, ["m"], "unit", "d", "s", 99)
    assert flips.count() == 2


@pytest.mark.parametrize("block,slice_samples", [(64, 4096), (3, 7), (1, 1000)])
def test_channel_correlations_in_blocks(spark, block, slice_samples):
    rng = np.random.default_rng(6)
    frames = {}
    for g in ("p", None):
        x = rng.normal(size=(50, 8)) @ rng.normal(size=(8, 8)) + 50
        x[rng.random(x.shape) < 0.2] = np.nan
        x[:, 5] = 3.0  # no spread
        x[2:, 7] = np.nan  # fewer than three pairs
        frames[g] = x
    rows = [(g, f"c{c}", s, float(v)) for g, x in frames.items() for s, line in enumerate(x) for c, v in enumerate(line)]
    df = spark.createDataFrame(rows + [("p", None, 1, 1.0), ("p", "c1", 99, None)], "g string, c string, s int, x double")
    got = {(r.g, r.a, r.b): (r.n, r.r) for r in graph.channel_correlations(df, ["g"], "c", None, "s", "x", block, slice_samples).collect()}
    for g, x in frames.items():
        pdf = pd.DataFrame(x, columns=[f"c{c}" for c in range(8)])
        for a, b in itertools.permutations(pdf.columns, 2):
            n = int((pdf[a].notna() & pdf[b].notna()).sum())
            assert got.get((g, a, b), (0, None))[0] == n
            if n:
                want = pdf[a].corr(pdf[b]) if n >= 3 and "c5" not in (a, b) else None
                assert got[g, a, b][1] == (None if want is None else pytest.approx(want))
    only = graph.channel_correlations(df, ["g"], "c", ["c0", "c1"], "s", "x", block, slice_samples)
    assert {(r.a, r.b) for r in only.collect()} == {("c0", "c1"), ("c1", "c0")}


def test_nearest_neighbours_move_no_pairs(spark):
    """Rows shuffled and written grow with the nodes: no vector is repeated for each block it meets (failed with blocks joined by shuffle)."""
    rng = np.random.default_rng(9)
    v = rng.normal(size=(900, 6))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id bigint, v array<double>")
    found = graph.nearest_neighbours(df, "id", "v", 3, fan=8, block_rows=50, search_rows=200)
    plan = found._jdf.queryExecution().toString()
    assert "FlatMapGroups" not in plan and "v#" not in plan.split("== Physical Plan ==")[1]
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    dist = np.arccos(np.clip(u @ u.T, -1, 1))
    np.fill_diagonal(dist, np.inf)
    assert {(r.id, r.other, r.rank) for r in found.collect()} == {(i, int(j), p + 1) for i in range(len(v)) for p, j in enumerate(np.argsort(dist[i])[:3])}
