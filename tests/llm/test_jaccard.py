import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from mensura.llm import jaccard
from mensura.llm.queries import QUERIES

LOWER = {c: c + 32 for c in range(65, 91)}


def shingles(text, width=4):
    words = [w for w in re.split("[\x20\x09-\x0d]+", (text or "").translate(LOWER)) if w]
    if not words:
        return set()
    return {" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}


def by_hand(texts, percent=85):
    """Set sizes and the smallest index of each component, by all pairs of different sets."""
    sets = [frozenset(shingles(t)) for t in texts]
    label = list(range(len(sets)))
    find = lambda i: i if label[i] == i else find(label[i])
    first = {}
    for i, s in enumerate(sets):
        if s:
            label[i] = first.setdefault(s, i)
    ordered = sorted(first, key=len)
    for i, x in enumerate(ordered):
        for y in ordered[i + 1 :]:
            if 100 * len(x) < percent * len(y):
                break
            both = len(x & y)
            if 100 * both >= percent * (len(x) + len(y) - both):
                a, b = sorted((find(first[x]), find(first[y])))
                label[b] = a
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def family(draw, words, copies, rate):
    base = [draw.choice("abcdefghijklmnopqrstuvwxyz") + str(draw.randint(0, 99)) for _ in range(words)]
    for _ in range(copies):
        yield " ".join(w if draw.random() > rate else "x" + str(draw.randint(0, 10**6)) for w in base)


def corpus(seed):
    draw = random.Random(seed)
    texts = [t for words, copies, rate in [(6, 12, 0.05), (12, 30, 0.03), (40, 40, 0.01), (90, 40, 0.015), (300, 40, 0.015), (900, 12, 0.02)]
             for t in family(draw, words, copies, rate)]
    passage = next(family(draw, 60, 1, 0))
    texts += [f"{next(family(draw, draw.randint(0, 60), 1, 0))} {passage} {next(family(draw, draw.randint(0, 60), 1, 0))}" for _ in range(60)]
    draw.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed,near,cell", [(1, 2, 2048), (2, 0, 2048), (3, 1, 7)])
def test_classes_equal_all_pairs(spark, seed, near, cell):
    texts = corpus(seed)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.linked_texts(docs, near_rounds=near, cell=cell).collect()}
    want = by_hand(texts)
    assert [got[i] for i in range(len(texts))] == want
    assert 20 < len({c for _, c in want}) < len(texts) - 60


def test_query_on_the_smallest_tables(spark):
    folder = "/root/testdata/sf0.001"
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect())
    want = {d: (n, docs[c][0]) for (d, _), (n, c) in zip(docs, by_hand([t for _, t in docs]))}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op11_jaccard_join"](spark, folder).collect()}
    assert got == want and len({c for _, c in want.values()}) < len(want)


def test_edges(spark):
    long = "w1 w2 " * 70_000
    docs = [
        (5, None), (3, ""), (9, " \n"), (4, "a b c"), (4, "a b c"), (None, "q r s t u"), (7, "A b\tC"), (6, "a b c d"), (8, "a  b c D"),
        (20, long), (12, long + "w1"), (30, "É É É É"), (31, "é é é é"), (None, None),
    ]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    clash = frame.withColumn("key", F.lit("k")).withColumn("n", F.lit(1)).withColumn("component", F.lit(2)).withColumn("id", F.lit(3))
    rows = jaccard.linked_texts(clash).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in rows if r.doc_id is not None) == [
        (3, 0, 3), (4, 1, 4), (4, 1, 4), (5, 0, 5), (6, 1, 6), (7, 1, 4), (8, 1, 6), (9, 0, 9), (12, 2, 12), (20, 2, 12), (30, 1, 30), (31, 1, 31)]
    assert sorted((r.n_shingles, r.component_id) for r in rows if r.doc_id is None) == [(0, None), (2, None)]
    assert jaccard.linked_texts(frame.filter("false")).collect() == []


def test_allowed_sizes_share_a_band():
    for percent in (50, 80, 85, 95):
        bands = {n: {b for b, _, _ in jaccard.cuts(n, percent)} for n in range(1, 1200)}
        for n in range(1, 600):
            for m in range(n, min(1199, 100 * n // percent) + 1):
                if jaccard.differences(n, m, percent):
                    own = max(b for b, e in enumerate(jaccard.bands(percent)) if e <= m)
                    assert own in bands[n] & bands[m]


@pytest.mark.parametrize("size", [7, 8, 13, 40, 200])
@pytest.mark.parametrize("hot", [0.0, 0.3, 1.0])
def test_linked_sets_share_a_signature(size, hot):
    """Whatever share of the shingles is frequent, and however many differ."""
    draw = np.random.default_rng(size)
    frequent = np.zeros(1 << jaccard.SKETCH_BITS, dtype=bool)
    for _ in range(150):
        x = draw.integers(0, 1 << 63, size, dtype=np.uint64)
        frequent[:] = False
        frequent[jaccard.bucket(x[: int(hot * size)])] = True
        cut, added = draw.integers(0, size // 6 + 1, 2)
        y = np.concatenate([x[cut:], draw.integers(0, 1 << 63, added, dtype=np.uint64)])
        both, either = size - cut, size + added
        if 100 * both >= 85 * either and cut + added:
            x, y = np.unique(x), np.unique(y)
            found = [set(jaccard.signatures(s, 85, frequent).tolist()) for s in (x, y)]
            assert found[0] & found[1]


def test_bitmaps_bound_the_differences():
    draw = np.random.default_rng(2)
    for _ in range(50):
        x = np.unique(draw.integers(0, 1 << 63, 300, dtype=np.uint64))
        y = np.unique(np.concatenate([x[draw.random(len(x)) < 0.9], draw.integers(0, 1 << 63, 20, dtype=np.uint64)]))
        gap = (int.from_bytes(jaccard.bitmap(x)) ^ int.from_bytes(jaccard.bitmap(y))).bit_count()
        assert gap <= len(set(x.tolist()) ^ set(y.tolist()))


@pytest.mark.parametrize("run_rows", [100_000, 5])
@pytest.mark.parametrize("batch", [1, 3, 50])
def test_cells_of_sorted_rows(monkeypatch, run_rows, batch):
    import pyarrow as pa

    monkeypatch.setattr(jaccard, "RUN_ROWS", run_rows)
    draw = random.Random(batch)
    runs = [sorted(draw.choices(range(30), k=draw.choice([1, 1, 2, 3, 9, 25]))) for _ in range(40)] + [[4] * 20, [1, 2], [1, 2]]
    rows = [(s * 10, k) for s, run in enumerate(runs) for k in run]
    batches = [pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows[i : i + batch]], pa.int64()) for c in (0, 1)], names=["sig", "key"])
               for i in range(0, len(rows), batch)]
    cells = {}
    for out in jaccard._shared(iter(batches)):
        for cell, key in zip(out.column(0).to_pylist(), out.column(1).to_pylist()):
            cells.setdefault(cell, set()).add(key)
    want = {frozenset(r) for r in runs if len(set(r)) > 1}
    assert {frozenset(c) for c in cells.values()} == want
    if run_rows > 100:
        assert len(cells) == len(want)
