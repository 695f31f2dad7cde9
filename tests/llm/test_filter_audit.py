import random
from collections import Counter
from itertools import permutations
import re

import numpy as np
import pytest

from mensura.llm import filter_audit
from mensura.llm.queries import QUERIES

SPACE = "[\x20\x09-\x0d]+"


def by_hand(docs, labels):
    """Every order applied row by row."""
    least = {}
    for i, text, _ in docs:
        if i is not None:
            least[text or ""] = min(least.get(text or "", i), i)
    good, toxic = ({i for i, *v in labels if i is not None and v[k] == 1} for k in (0, 1))
    failing = []
    for i, text, part in docs:
        text = text or ""
        words = [w for w in re.split(SPACE, text) if w]
        fails = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
            "D": bool(re.search("[#$%&*|]", text)), "E": i is not None and i > least[text],
        }
        failing.append((part or "", i, {f for f, x in fails.items() if x}))
    rows, shapley = {}, Counter()
    for part in {p for p, _, _ in failing}:
        own = [(i, f) for p, i, f in failing if p == part]
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone, left = [x for x in left if f in x[1]], [x for x in left if f not in x[1]]
                shapley[part, f] += len(gone)
                rows[part, "".join(order), step] = (
                    len(left), len(gone), sum(f in x[1] for x in own) - len(gone), sum(x[1] == {f} for x in own),
                    sum(x[0] in good for x in gone), sum(x[0] in toxic for x in gone),
                )
    return {(p, o, s): (*v, shapley[p, o[s - 1]]) for (p, o, s), v in rows.items()}


def result(frame):
    return {tuple(r[:3]): tuple(r[3:]) for r in frame.collect()}


def test_query_on_the_smallest_tables(spark):
    folder = "/root/testdata/sf0.001"
    take = lambda name, *cols: [tuple(r) for r in spark.read.parquet(f"{folder}/{name}.parquet").select(*cols).collect()]
    want = by_hand(take("documents", "doc_id", "text", "source"), take("labels", "doc_id", "quality", "toxic"))
    got = QUERIES["op12_filter_audit"](spark, folder)
    assert result(got) == want and got.count() == len(want)


def test_edges(spark):
    draw = random.Random(3)
    many = " ".join(draw.choice("Ab c d É 中 x, \x1c \x0b e | #".split(" ")) for _ in range(300))
    docs = [
        (1, None, None), (2, "", ""), (3, "Ab", "x"), (3, "Ab", "x"), (None, "Ab", "x"), (4, "Ab", "y"), (None, None, "y"),
        (5, "w " * 90_000 + "É", "x"), (6, many, "y"), (7, many, None), (8, " ".join(map(str, range(250))), "x"),
        (9, " ".join(map(str, range(250))), "x"), (10, " ".join(map(str, range(250))) + " ABCDEFGHIJKLMNOPQRSTUVWXYZ$", "x"),
    ]
    labels = [(1, 1, 0), (3, 0, 1), (3, 1, 0), (4, None, 1), (None, 1, 1), (5, 1, None), (9, 1, 1)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string")
    from pyspark.sql import functions as F

    clash = frame.withColumn("mask", F.lit("m")).withColumn("part", F.lit(1)).withColumn("n", F.lit(2)).withColumn("digest", F.lit(3))
    marked = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("good", F.lit(7))
    assert result(filter_audit.audit(clash, marked)) == by_hand(docs, labels)
    assert filter_audit.audit(frame.filter("false"), marked).collect() == []
    unlabelled = filter_audit.audit(frame, marked.filter("false")).select("good_lost", "toxic_lost").distinct().collect()
    assert [tuple(r) for r in unlabelled] == [(0, 0)]


def test_many_parts_fill_several_batches(spark):
    docs = [(i, "Text " * (i % 3), f"s{i % 150}") for i in range(600)]
    got = result(filter_audit.audit(spark.createDataFrame(docs, "doc_id long, text string, source string"),
                                    spark.createDataFrame([], "doc_id long, quality int, toxic int")))
    assert got == by_hand(docs, [])


@pytest.mark.parametrize("seed", range(3))
def test_gray_states_count_the_rows_that_pass(seed):
    cells = np.random.default_rng(seed).integers(0, 9, (3, 32, 2))
    states = filter_audit.gray_states(cells)
    for subset in range(32):
        assert (states[:, subset] == cells[:, [m for m in range(32) if not m & subset]].sum(axis=1)).all()
