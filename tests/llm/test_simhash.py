import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from mensura.llm import simhash
from mensura.llm.queries import QUERIES


def by_hand(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", lower) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(bits, radius=4):
    """Smallest index of each component, by all pairs."""
    bits = np.array(bits, dtype=np.uint64)
    near = np.bitwise_count(bits[:, None] ^ bits[None, :]) <= radius
    label = np.arange(len(bits))
    while True:
        lower = np.where(near, label[None, :], len(bits)).min(axis=1)
        if (lower == label).all():
            return label.tolist()
        label = lower


def clustered(seed, centres, copies, flips):
    draw = np.random.default_rng(seed)
    out = []
    for c in draw.integers(0, 1 << 63, centres, dtype=np.uint64):
        for _ in range(copies):
            for b in draw.integers(0, 64, draw.integers(0, flips + 1)):
                c = c ^ (np.uint64(1) << np.uint64(b))
            out.append(int(c))
    return out + [0, 1, (1 << 64) - 1, 31, 7]


def test_fingerprints_by_hand():
    draw = random.Random(4)
    texts = [" ".join(draw.choice("Ab c d É 中 x, \x1c \x0b e".split(" ")) for _ in range(draw.randint(0, 30))) for _ in range(200)]
    for text in [*texts, "", " \n", "One", "a b c d", "a b c d a b c d e", "w " * 70_000]:
        assert simhash.text_fingerprint(text.encode()) == by_hand(text)


@pytest.mark.parametrize("seed,centres,copies,flips", [(1, 40, 6, 3), (2, 3, 150, 2), (3, 400, 1, 0), (4, 2, 600, 5), (5, 12, 40, 6)])
def test_index_forest_spans_all_links(seed, centres, copies, flips):
    bits = sorted(set(clustered(seed, centres, copies, flips)))
    index = simhash.GrayIndex(np.zeros(len(bits), dtype=np.int64), np.array(bits, dtype=np.uint64))
    pairs = index.forest(4)
    assert len(pairs) < len(bits)
    label = list(range(len(bits)))
    find = lambda i: i if label[i] == i else find(label[i])
    for a, b in pairs.tolist():
        assert (bits[a] ^ bits[b]).bit_count() <= 4
        a, b = find(a), find(b)
        assert a != b
        label[max(a, b)] = min(a, b)
    assert [find(i) for i in range(len(bits))] == roots(bits)


def test_masks_leave_no_link_out():
    draw = np.random.default_rng(6)
    found = [m & ((1 << 64) - 1) for m in simhash.masks()]
    assert len(found) == 15
    for _ in range(500):
        flips = sum(1 << int(b) for b in set(draw.integers(0, 64, 4).tolist()))
        assert any(m & flips == 0 for m in found)


@pytest.mark.parametrize("cell", [4096, 8])
def test_classes_equal_all_pairs(spark, cell):
    bits = clustered(8, 25, 12, 4)
    signed = np.array(bits, dtype=np.uint64).astype(np.int64).tolist()
    frame = spark.createDataFrame([(i + 100, b) for i, b in enumerate(signed)], "id long, bits long")
    got = {r.bits: r.component_id for r in simhash.classes(frame, "id", "bits", cell=cell).collect()}
    assert [got[b] - 100 for b in signed] == roots(bits)


def test_edges(spark):
    docs = spark.createDataFrame(
        [(5, None, "x"), (3, "", "y"), (9, " \n", "z"), (4, "a b c", None), (4, "a b c", None), (None, "q r s t u", "x"), (7, "A b\tC", "x")],
        "doc_id long, text string, component_id string",
    ).withColumn("bits", F.lit("clash")).withColumn("fingerprint", F.lit(1))
    rows = simhash.near_duplicates(docs).collect()
    assert sorted((r.doc_id, r.component_id) for r in rows if r.doc_id) == [(3, 3), (4, 4), (4, 4), (5, 3), (7, 4), (9, 3)]
    assert {r.fingerprint for r in rows if r.doc_id in (3, 5, 9)} == {"0" * 16}
    assert [r.component_id for r in rows if r.doc_id is None] == [None]
    assert simhash.near_duplicates(docs.filter("false")).collect() == []


def test_query_on_the_smallest_tables(spark):
    folder = "/root/testdata/sf0.001"
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect())
    bits = [by_hand(t) for _, t in docs]
    want = {d: (f"{b:016x}", docs[k][0]) for (d, _), b, k in zip(docs, bits, roots(bits))}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op5_simhash"](spark, folder).collect()}
    assert got == want and len({c for _, c in want.values()}) < len(want)
