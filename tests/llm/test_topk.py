import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from mensura.llm import cover_tree, topk
from mensura.llm.queries import QUERIES


def by_hand(rows, k=5, every=50):
    ok = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            ok[i] = [math.floor(256 * x) for x in v]
    out = []
    for q in [i for i in ok if i % every == 0]:
        scores = sorted((-sum(a * b for a, b in zip(ok[q], v)), i) for i, v in ok.items() if i != q and len(v) == len(ok[q]))
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


def test_cover_tree_holds_its_invariants():
    draw = np.random.default_rng(1)
    points = np.concatenate([draw.normal(c, 3, (150, 6)) for c in draw.normal(0, 200, (8, 6))]).astype(np.int64)
    tree = cover_tree.CoverTree(points)
    assert sorted(tree.order.tolist()) == list(range(len(points)))
    for n in range(len(tree.radii)):
        own = tree.vectors[tree.first[n] : tree.last[n]]
        assert np.sqrt(((own - tree.centres[n]) ** 2).sum(axis=1)).max() <= tree.radii[n] + 1e-9
        a, b = tree.child[n]
        if a < b:
            assert tree.first[a] == tree.first[n] and tree.last[b - 1] == tree.last[n] and b - a <= cover_tree.FAN


@pytest.mark.parametrize("spread,limit", [(3, 0.5), (300, 1.0)])
def test_dual_search_is_exact_and_prunes_clusters(spread, limit):
    draw = np.random.default_rng(2)
    centres = draw.normal(0, 300, (30, 8))
    data = (centres[draw.integers(0, 30, 3000)] + draw.normal(0, spread, (3000, 8))).astype(np.int64)
    data[100:200] = data[7]
    queries = data[::40]
    search = cover_tree.Search(cover_tree.CoverTree(queries, cover_tree.QUERY_LEAF), 6)
    ids = draw.permutation(3000)
    for i in range(0, 3000, 700):
        search.add(cover_tree.CoverTree(data[i : i + 700]), ids[i : i + 700])
    for row, q in zip(range(len(queries)), search.q.order):
        scores = data @ queries[q]
        want = sorted(zip((-scores).tolist(), ids.tolist()))[:6]
        assert list(zip((-search.scores[row]).tolist(), search.ids[row].tolist())) == want
    assert search.pairs <= limit * len(queries) * 3000


def test_large_products_stay_exact():
    a = np.array([[2**28 + 1, 3]], dtype=np.int64)
    tree, larger = cover_tree.CoverTree(a), cover_tree.CoverTree(a << 10)
    assert cover_tree.products(tree, [0], tree, [0])[0, 0] == (2**28 + 1) ** 2 + 9
    vast = cover_tree.CoverTree(np.array([[2**62, -(2**40)], [-(2**62), 1], [3, 2**21]], dtype=np.int64))
    exact = [[max(-cover_tree.LIMIT, min(cover_tree.LIMIT, sum(x * y for x, y in zip(v, w)))) for w in vast.vectors.tolist()] for v in vast.vectors.tolist()]
    assert cover_tree.products(vast, [0, 1, 2], vast, [0, 1, 2]).tolist() == exact
    assert cover_tree.products(larger, [0], larger, [0])[0, 0] == cover_tree.LIMIT


def test_huge_components_end_no_query(spark):
    rows = [(0, [1e30, 0.0]), (50, [-1e30, 1.0]), (1, [2.0, 1.0]), (2, [-1.0, 1e30]), (3, [0.5, 0.5])]
    held = {i: [max(-(2**63), min(2**63 - 1, int(256 * float(np.float32(x)) // 1))) for x in v] for i, v in rows}
    score = lambda q, c: max(-cover_tree.LIMIT, min(cover_tree.LIMIT, sum(x * y for x, y in zip(held[q], held[c]))))
    want = []
    for q in (0, 50):
        best = sorted((-score(q, c), c) for c in held if c != q)[:3]
        want += [(q, r, c, -s) for r, (s, c) in enumerate(best, 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in topk.top_k(frame, k=3).collect()) == want


@pytest.mark.parametrize("block", [4096, 7])
def test_search_equals_brute_force(spark, block):
    draw = np.random.default_rng(3)
    base = draw.normal(0, 1, (60, 5)).round(2).tolist()
    rows = [(int(i), base[i % 60] if i % 3 else draw.normal(0, 1, 5).round(2).tolist()) for i in range(900)]
    rows += [(5000 + i, [0.5, -0.5]) for i in range(9)] + [(6000, []), (6050, [])]
    rows += [(None, base[0]), (7000, None), (7050, [None, 1.0, 1.0, 1.0, 1.0]), (7100, [float("nan")] * 5), (7150, [float("inf")] * 5)]
    frame = spark.createDataFrame(rows + rows[:50], "vec_id long, embedding array<float>").withColumn("score", F.lit("clash")).withColumn("v", F.lit(1))
    single = [(i, None if v is None else [x if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    got = sorted(tuple(r) for r in topk.top_k(frame, block=block).collect())
    assert got == by_hand(single)


def test_empty_table(spark):
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    assert sorted(tuple(r) for r in QUERIES["op6_topk"](spark, folder).collect()) == by_hand(rows)
