import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from mensura.llm import lbl, lm_score
from mensura.llm.queries import QUERIES


def tokens(text):
    return [*(text or "").encode().lower().split(), b""]


def small_model(seed=0):
    draw = np.random.default_rng(seed)
    p = lbl.Parameters(9, draw.normal(0, 0.5, lbl.Parameters(9, width=4).flat.shape), width=4)
    return p, draw


def test_tables_are_normalised():
    p, _ = small_model()
    a1, a2, z = p.tables()
    for h1 in range(9):
        for h2 in range(9):
            predicted = p.R[h1] @ p.C1 + p.R[h2] @ p.C2
            scores = p.Q @ predicted + p.b
            assert np.exp(a1[h1] + a2[h2] - z[h1, h2]).sum() == pytest.approx(1, abs=1e-5)
            assert a1[h1] + a2[h2] == pytest.approx(scores, abs=1e-4)


def test_words_of_a_class_sum_to_one():
    words = {b"aa": 5, b"baa": 2, b"xyz": 1}
    vocab = lbl.Vocabulary([], None, None)
    vocab.class_counts, vocab.class_types = np.zeros(vocab.classes), np.zeros(vocab.classes)
    for w, c in words.items():
        vocab.class_counts[vocab.class_of(w)] += c
        vocab.class_types[vocab.class_of(w)] += 1
    for k in {vocab.class_of(w) for w in words}:
        seen = np.array([c for w, c in words.items() if vocab.class_of(w) == k] + [0])
        assert np.exp(vocab.within(np.full(len(seen), k), seen)).sum() == pytest.approx(1)


def test_gradient_equals_differences(monkeypatch):
    p, draw = small_model(3)
    monkeypatch.setattr(lbl, "WIDTH", 4)
    make = lambda classes, flat=None: small(classes, flat)
    small = lambda classes, flat=None, original=lbl.Parameters: original(classes, flat, width=4)
    h1, h2, w = draw.integers(0, 9, (3, 40))
    noise, lk = draw.integers(0, 9, 6), np.log(np.full(9, 6 / 9))
    monkeypatch.setattr(lbl, "Parameters", make)
    g = lbl.gradient(p, h1, h2, w, noise, lk)
    for i in draw.integers(0, len(p.flat), 60):
        kept, eps = p.flat[i], 1e-2
        p.flat[i] = kept + eps
        up = lbl.loss(p, h1, h2, w, noise, lk)
        p.flat[i] = kept - eps
        down = lbl.loss(p, h1, h2, w, noise, lk)
        p.flat[i] = kept
        assert (up - down) / (2 * eps) == pytest.approx(float(g.flat[i]), rel=0.05, abs=2e-3)


def test_contexts():
    h1, h2, w = lbl.contexts([np.array([5, 6, 0], np.int32), np.array([0], np.int32), np.array([7, 0], np.int32)])
    assert w.tolist() == [5, 6, 0, 0, 7, 0] and h1.tolist() == [0, 5, 6, 0, 0, 7] and h2.tolist() == [0, 0, 5, 0, 0, 0]


def test_query_against_counts(spark, monkeypatch):
    folder = "/root/testdata/sf0.01"
    monkeypatch.setattr(lm_score, "BLOCK_BYTES", 300_000)  # several blocks
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    fold = lambda i: zlib.crc32(str(i).encode()) % 5
    counts = Counter(t for i, x in texts.items() if fold(i) != 1 for t in tokens(x))
    total, types = sum(counts.values()), len(counts)
    base = lambda x: sum(math.log10((counts[t] + 0.5) / (total + 0.5 * (types + 1))) for t in tokens(x))
    rows = QUERIES["op4_lm_score"](spark, folder).collect()
    assert Counter(r.doc_id for r in rows) == Counter(list(texts))
    for r in rows:
        own = tokens(texts[r.doc_id])
        assert (r.held_out, r.n_tokens, r.train_tokens) == (fold(r.doc_id) == 1, len(own), total)
        assert r.n_known == sum(counts[t] > 0 for t in own)
        assert r.base_score == pytest.approx(base(texts[r.doc_id]), rel=1e-9)
    held = [r for r in rows if r.held_out]
    per_token = lambda c: sum(r[c] for r in held) / sum(r.n_tokens for r in held)
    assert per_token("score") > per_token("base_score") + 0.1


def test_scores_are_the_model_s_log_probabilities(spark, monkeypatch):
    """Every token by the definition: softmax over the classes, then the share inside the class."""
    monkeypatch.setattr(lm_score, "BLOCK_BYTES", 60_000)
    kept = {}

    def untrained(coded, vocab, rounds):
        draw = np.random.default_rng(4)
        kept["vocab"], kept["params"] = vocab, lbl.Parameters(vocab.classes, draw.normal(0, 0.4, lbl.Parameters(vocab.classes).flat.shape))
        return kept["params"]

    monkeypatch.setattr(lm_score, "train", untrained)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).cache()
    texts = {r.doc_id: r.text for r in docs.collect()}
    counts = Counter(t for i, x in texts.items() if zlib.crc32(str(i).encode()) % 5 != 1 for t in tokens(x))
    scores = {r.doc_id: r.score for r in lm_score.lm_scores(docs).collect()}
    vocab, p = kept["vocab"], kept["params"]
    for text_id in sorted(texts)[:12]:
        total, h1, h2 = 0.0, 0, 0
        for t in tokens(texts[text_id]):
            c = vocab.class_of(t)
            x = (p.R[h1].astype(float) @ p.C1 + p.R[h2].astype(float) @ p.C2) @ p.Q.T + p.b
            total += x[c] - (np.log(np.exp(x - x.max()).sum()) + x.max())
            if c >= vocab.first_ending:
                total += math.log((counts[t] + 0.5) / (vocab.class_counts[c] + 0.5 * (vocab.class_types[c] + 1)))
            h1, h2 = c, h1
        assert scores[text_id] == pytest.approx(total / math.log(10), rel=1e-4)


def test_blocks_end_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "BLOCK_BYTES", 1000)
    sizes = [10] * 50 + [900] * 20 + [5000] * 3 + [10] * 30
    docs = spark.createDataFrame([(i, "w" * n) for i, n in enumerate(sizes)], "doc_id long, text string").repartition(3)
    texts, words = lm_score._split(docs, "doc_id", "text", 5, 1)
    blocks = texts.groupBy("block").agg(F.sum(F.length("text")).alias("bytes"), F.count("*").alias("rows")).collect()
    assert sum(b.rows for b in blocks) == len(sizes) and all(b.bytes <= 1000 or b.rows == 1 for b in blocks)
    assert {b.block for b in blocks} == {r.block for r in words.select("block").distinct().collect()}


def test_edges(spark):
    docs = spark.createDataFrame(
        [(1, None), (2, ""), (3, "A b\x1cc  é"), (3, "A b\x1cc  é"), (None, "z " * 50_000), (4, " \n")], "doc_id long, text string"
    ).withColumn("score", F.lit("clash")).withColumn("block", F.lit(1)).withColumn("word", F.lit(None))
    rows = lm_score.lm_scores(docs).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in rows) == [(0, 50_001), (1, 1), (2, 1), (3, 4), (3, 4), (4, 1)]
    assert all(math.isfinite(r.score) and r.score <= 0 for r in rows)
    assert lm_score.lm_scores(docs.filter("false")).collect() == []
    only = docs.filter(F.expr("crc32(cast(doc_id as string)) % 5 = 1"))
    assert all(r.train_tokens == 0 and r.n_known == 0 for r in lm_score.lm_scores(only).collect())


def test_every_round_reads_every_training_token_of_a_large_corpus(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "a b c d") for i in range(400)], "doc_id long, text string")
    vocabulary, averaged, seen = lm_score.vocabulary, lbl.averaged, []

    def large(words):
        vocab, _, types = vocabulary(words)
        return vocab, 1 << 40, types

    def counting(parts):
        parts = list(parts)
        seen.append(sum(w for _, w in parts))
        return averaged(parts)

    monkeypatch.setattr(lm_score, "vocabulary", large)
    monkeypatch.setattr(lbl, "averaged", counting)
    lm_score.lm_scores(docs)
    trains = sum(zlib.crc32(str(i).encode()) % 5 != 1 for i in range(400))
    assert seen == [5 * trains] * lm_score.ROUNDS
