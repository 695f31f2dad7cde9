import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from mensura.llm import sharding
from mensura.llm.queries import QUERIES


def held_together(rows, texts, n_shards):
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        text = texts[r.doc_id]
        assert r.size == len((text or "").encode()) + 1 and r.text_crc32 == zlib.crc32((text or "").encode())
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < n_shards
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_packing_balances_all_dimensions():
    draw = np.random.default_rng(2)
    items = np.column_stack([draw.lognormal(8, 1.5, 5000), draw.lognormal(6, 1.2, 5000), draw.integers(1, 40, 5000)])
    place = sharding.pack(items, 16)
    loads = np.array([items[place == s].sum(axis=0) for s in range(16)]) / items.sum(axis=0) * 16
    assert np.abs(loads[:, 0] - 1).max() < 0.01 and np.abs(loads - 1).max() < 0.05


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = QUERIES["op8_sharding"](spark, folder).collect()
    assert Counter(r.doc_id for r in rows) == Counter(list(texts))
    held_together(rows, texts, 16)
    by_text = defaultdict(set)
    for r in rows:
        by_text[texts[r.doc_id]].add(r.shard)
    assert all(len(s) == 1 for s in by_text.values())
    sizes = np.array([sum(r.size for r in rows if r.shard == s) for s in range(16)])
    assert sizes.max() / sizes.mean() < 1.02 and sizes.min() / sizes.mean() > 0.98


def test_group_larger_than_a_shard_is_cut(spark):
    docs = spark.range(3000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") < 1000, "hot text " * 5).otherwise(F.concat(F.lit("t" * 40), F.col("id"))).alias("text")
    )
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = sharding.shard(docs, 8).collect()
    held_together(rows, texts, 8)
    sizes = np.array([sum(r.size for r in rows if r.shard == s) for s in range(8)])
    assert sizes.max() / sizes.mean() < 1.05


def test_edges(spark):
    docs = spark.createDataFrame(
        [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "x" * 100_000), (4, "é 中"), (5, "")], "doc_id long, text string"
    ).withColumn("shard", F.lit("clash")).withColumn("size", F.lit(None)).withColumn("block", F.lit(1))
    rows = sharding.shard(docs, 4).collect()
    held_together(rows, {1: None, 2: "", 3: "a b", None: "x" * 100_000, 4: "é 中", 5: ""}, 4)
    assert len(rows) == 7 and len({r.shard for r in rows if r.doc_id == 3}) == 1
    assert sharding.shard(docs.filter("false"), 4).collect() == []
    same = sharding.shard(spark.range(900).select(F.lit(7).alias("doc_id"), F.lit("same text").alias("text")), 4).collect()
    assert sorted(Counter(r.shard for r in same)) == [0, 1, 2, 3]
