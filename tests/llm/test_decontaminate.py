import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from mensura.llm import decontaminate as dc


def words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def by_hand(text, items, window):
    have, hit, found = words(text), set(), set()
    for item, other in items:
        w = words(other)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            p = w[i : i + window]
            for j in range(len(have) - len(p) + 1):
                if have[j : j + len(p)] == p:
                    hit |= set(range(j, j + len(p)))
                    found.add(item)
    return len(have), len(hit), sorted(x for x in found if x is not None)


def draw_case(seed, n_words=9):
    draw = random.Random(seed)
    some = lambda n: " ".join(draw.choice(["a", "B", "é", "12", "x-y", "中", "zz", "the", "The"][:n_words]) for _ in range(n))
    items = [(f"i{k}", some(draw.choice([0, 1, 2, 3, 5, 8]))) for k in range(12)] + [(None, some(4)), ("n", None)]
    docs = [some(draw.choice([0, 1, 3, 20, 60])) for _ in range(30)] + [None, "", "!!!", some(5) + " " + "filler " * 30]
    return docs + docs[:3], items


@pytest.mark.parametrize("seed", range(12))
def test_shard_search_equals_brute_force(seed):
    docs, items = draw_case(seed, 4 + seed % 6)
    for window in (1, 3, 4):
        found = dc.search_shard([(t or "").encode() for t in docs], dc.phrases(items, window))
        for text, (n, spans, names) in zip(docs, found):
            assert (n, sum(s["last"] - s["first"] + 1 for s in spans), names) == by_hand(text, items, window)


def test_suffix_order_and_ranks():
    draw = np.random.default_rng(1)
    text = draw.integers(0, 5, 400)
    text[-1] = 0
    seps = np.cumsum(text == 0)
    key = lambda i: [(0, int(seps[k])) if text[k] == 0 else (1, int(text[k])) for k in range(i, min(400, i + 60))]
    assert dc.suffix_array(text).tolist() == sorted(range(400), key=key)
    matrix = dc.WaveletMatrix(text, 3)
    code, at = draw.integers(0, 5, 200), draw.integers(0, 401, 200)
    assert matrix.rank(code, at).tolist() == [int((text[:a] == c).sum()) for c, a in zip(code, at)]


def test_blocks_give_the_same_result(spark):
    docs, items = draw_case(99)
    frame = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(docs)] + [(None, docs[0], None)], "doc_id long, text string, spans string")
    bench = spark.createDataFrame(items, "item_id string, text string")
    want = {i: by_hand(t, items, 3) for i, t in [*enumerate(docs), (None, docs[0])]}
    for limit in (1 << 20, 20):
        blocks = list(dc.phrase_blocks(bench, window=3, limit=limit))
        assert len(blocks) == 1 if limit > 20 else len(blocks) > 2
        spans = {r.doc_id: r.spans for r in dc.contamination(frame, iter(blocks)).collect()}
        whole = spans if limit > 20 else whole
        assert spans == whole  # the same ranges, merged across blocks
        rows = dc.contamination(frame, blocks).collect()
        assert len(rows) == len(docs) + 1
        for r in rows:
            n, hit, names = want[r.doc_id]
            assert (r.n_words, r.n_hit, r.n_items) == (n, hit, len(names))
            assert r.items_sha256 == hashlib.sha256(",".join(names).encode()).hexdigest()
            assert r.contaminated == (hit > 0 and 20 * hit >= n)


def test_spans_are_cut_out(spark):
    bench = spark.createDataFrame([("q", "two three, FOUR")], "item_id string, text string")
    docs = spark.createDataFrame([(1, "One, two! Three four. Five é"), (2, None)], "doc_id long, text string")
    found = docs.withColumn("found", dc.hits(F.col("text"), next(dc.phrase_blocks(bench))))
    cut = {r.doc_id: r.left for r in found.select("doc_id", dc.without_spans(F.col("text"), F.col("found.spans")).alias("left")).collect()}
    assert cut == {1: "One, . Five é", 2: None}


def test_empty_tables(spark):
    bench = spark.createDataFrame([], "item_id string, text string")
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    row = dc.contamination(docs, dc.phrase_blocks(bench)).first()
    assert (row.n_words, row.n_hit, row.n_items, row.contaminated) == (3, 0, 0, False)
    assert dc.contamination(docs.filter("false"), dc.phrase_blocks(bench)).collect() == []
