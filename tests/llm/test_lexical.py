import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from mensura.llm import lexical
from mensura.llm.queries import QUERIES

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def split(text):
    return TERM.findall((text or "").translate(LOWER))


def by_hand(docs, items, top=50):
    """Rows (item, rank, id, score) by scoring every document for every item."""
    held = [(i, Counter(split(text))) for i, text in docs]
    n_docs = sum(bool(c) for _, c in held)
    total = sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c in held:
            m = 50 + 50 * c.total() * n_docs // total if total else 50
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m))
                for t in set(split(text)) if c[t]
            )
            if score > 0:
                found.append((-score, i is None, i))
        out += [(item, rank, i, -score) for rank, (score, _, i) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:top], 1)]
    return out


def rows(frame):
    key = lambda r: tuple(-1 if x is None else x for x in r)
    return sorted((tuple(r) for r in frame.select("item_id", "rank", "doc_id", "score").collect()), key=key)


def in_order(wanted):
    return sorted(wanted, key=lambda r: tuple(-1 if x is None else x for x in r))


def test_query_on_the_smallest_tables(spark):
    folder = "/root/testdata/sf0.001"
    take = lambda name, key: [tuple(r) for r in spark.read.parquet(f"{folder}/{name}.parquet").select(key, "text").collect()]
    assert rows(QUERIES["op13_lexical_search"](spark, folder)) == in_order(by_hand(take("documents", "doc_id"), take("benchmark", "item_id")))


DOCS = [
    (3, "a b c"), (2, "A B c"), (2, "a b c"), (None, "a b c"), (9, None), (10, " ,.\x7f"), (11, "a " * 90_000 + "É5x"), (12, "É5X-a_b"),
    (13, "中 文a b"), (14, ""), (None, "b b b"), (15, "z"),
]
ITEMS = [(1, "a b, a"), (1, "c?"), (2, None), (None, "A b c É5x"), (5, "中"), (6, "nowhere"), (7, "--")]


@pytest.mark.parametrize("top,block", [(50, 1 << 20), (2, 1 << 20), (3, 1)])
def test_edges_and_blocks(spark, monkeypatch, top, block):
    monkeypatch.setattr(lexical, "BLOCK_BYTES", block)
    monkeypatch.setattr(lexical, "BATCH_DOCS", 3)
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").withColumn("score", F.lit("x")).withColumn("row", F.lit(1))
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("doc_id", F.lit(1)).withColumn("row", F.lit("r"))
    assert rows(lexical.search(docs.repartition(4), items, top)) == in_order(by_hand(DOCS, ITEMS, top))


def test_empty_tables(spark):
    docs, items = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert lexical.search(docs.filter("false"), items).collect() == []
    assert lexical.search(docs, items.filter("false")).collect() == []


@pytest.mark.parametrize("seed", range(6))
def test_shared_sums_are_the_items_terms(seed):
    draw = random.Random(seed)
    blocks = [[b"%d-%d" % (k, j) for j in range(draw.randint(1, 6))] for k in range(8)]
    items = [{t for b in draw.sample(blocks, draw.randint(0, 5)) for t in b if draw.random() < 0.9} for _ in range(25)]
    plan = lexical.share(items)
    terms = sorted(plan.codes, key=plan.codes.get)
    ends = [*plan.atoms[1:], len(terms)]
    nodes = [Counter(terms[a:b]) for a, b in zip(plan.atoms, ends)]
    for a, b in plan.pairs:
        nodes.append(nodes[a] + nodes[b])
    assert [sum((nodes[n] for n in held), Counter()) for held in plan.items] == [Counter(x) for x in items]
    plain = sum(max(0, len(x) - 1) for x in items)
    assert len(plan.pairs) + sum(max(0, len(x) - 1) for x in plan.items) < plain
    # nothing that two items share is left uncombined
    pairs = Counter(p for held in plan.items for p in __import__("itertools").combinations(held, 2))
    assert max(pairs.values(), default=0) < 2


def test_scores_along_the_dag(spark):
    draw = np.random.default_rng(5)
    terms = [b"t%d" % i for i in range(40)]
    items = [set(draw.choice(terms, 12, replace=False).tolist()) for _ in range(20)]
    plan = lexical.share(items)
    tf, m = draw.integers(0, 4, (30, len(plan.codes))), draw.integers(50, 200, 30)
    weights = draw.integers(1, 9000, len(plan.codes))
    want = [[sum(int(weights[c]) * (10**9 * int(t[c]) // (1000 * int(t[c]) + 20 * int(k))) for c in map(plan.codes.get, x)) for t, k in zip(tf, m)] for x in items]
    assert lexical.scores(plan, weights, tf, m).tolist() == want
