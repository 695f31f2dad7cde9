import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from mensura.llm import language, quality
from mensura.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def auc(scores, marks):
    order = np.argsort(np.argsort(scores))
    ones = marks.sum()
    return (order[marks == 1].sum() - ones * (ones - 1) / 2) / ones / (len(marks) - ones)


def test_quality_on_held_out_labels(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = QUERIES["op1_quality"](spark, SF).collect()
    assert len(rows) == 1000
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    kept = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    scores, marks = np.array(kept).T
    assert auc(scores, marks) > 0.9 and ((scores >= 0.3) == marks).mean() > 0.9


def test_quality_ignores_held_out_labels_and_other_columns(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    flipped = labels.withColumn("quality", F.when(F.expr("crc32(cast(doc_id as string)) % 5 = 0"), 1 - F.col("quality")).otherwise(F.col("quality")))
    a = quality.fit(docs, labels)
    b = quality.fit(docs.drop("lang", "source").withColumn("quality", F.lit(1)), flipped.repartition(5))
    assert (a.good, a.bad) == (b.good, b.bad) and np.allclose(a.weights, b.weights, rtol=1e-9)


def edge_docs(spark):
    return spark.createDataFrame(
        [(1, None, "en"), (2, "", "en"), (3, "12 34 %%", "de"), (4, "word " * 50_000, "en"), (4, "word " * 50_000, "en"),
         (None, "und die der", None), (5, "中文", None), (6, "a", "fr"), (7, "🙂 — !", None)],
        "doc_id long, text string, lang string",
    ).withColumn("score", F.lit("clash")).withColumn("id", F.lit("clash"))


def test_quality_edges(spark):
    docs = edge_docs(spark)
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (4, 1), (4, 0), (None, 1), (6, 1), (99, 0)], "doc_id long, quality int")
    rows = quality.classify(docs, quality.fit(docs, labels)).collect()
    assert len(rows) == 9 and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (1, 2)}) == 1 and len({r.score for r in rows if r.doc_id == 4}) == 1
    assert quality.classify(docs.filter("false"), quality.fit(docs.filter("false"), labels)).collect() == []
    none = quality.fit(docs, labels.filter("false"))
    assert {round(r.score, 6) for r in quality.classify(docs, none).collect()} == {0.5}
    ones = quality.fit(docs, labels.filter("quality = 1"))
    assert all(r.predicted == 1 for r in quality.classify(docs, ones).collect())


def test_language_on_held_out_documents(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op7_language"](spark, SF).collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    right = [r.lang_pred == lang[r.doc_id] for r in rows if r.held_out]
    assert np.mean(right) > 0.96


def test_language_edges(spark):
    docs = edge_docs(spark)
    net = language.Network.new(["de", "en"])
    found = {r.doc_id: (r.lang_pred, r.score) for r in language.languages(docs, net).collect()}
    assert {found[i] for i in (1, 2, 3, 7)} == {("und", 0.0)}
    assert found[4][0] in ("de", "en") and found[5][0] in ("de", "en") and found[None][0] in ("de", "en")
    assert {r.lang_pred for r in language.languages(docs, language.Network([])).collect()} == {"und"}
    assert language.fit(docs.filter("lang is null")).languages == []
    assert language.languages(docs.filter("false"), net).collect() == []
    assert set(language.fit(docs).languages) <= {"en", "fr"}


def test_backpropagation_through_time_equals_differences():
    net = language.Network.new(["a", "b", "c"], hidden=3)
    net.parts = {k: v.astype(np.float64) for k, v in net.parts.items()}
    codes, lengths = language._padded([b"hello", b"ab", b"xyzw", b"q"])
    target = np.array([0, 1, 2, 1])
    _, grads = language.gradients(net, codes, lengths, target)
    draw = np.random.default_rng(0)
    for name, value in net.parts.items():
        # bytes that occur carry the gradient of the tables
        rows = [104, 97, 122, 113] if name.endswith("x") else range(value.shape[0])
        for _ in range(6):
            at = (draw.choice(list(rows)), draw.integers(value.shape[1])) if value.ndim == 2 else (draw.integers(value.shape[0]),)
            kept, eps = value[at], 1e-2
            value[at] = kept + eps
            up, _ = language.gradients(net, codes, lengths, target)
            value[at] = kept - eps
            down, _ = language.gradients(net, codes, lengths, target)
            value[at] = kept
            assert (up - down) / (2 * eps) == pytest.approx(float(grads[name][at]), rel=0.05, abs=2e-4)


def test_runs_are_pooled_by_their_counts():
    net = language.Network.new(["de", "en"])
    one = language.Labeller(net)
    texts = [b"the und the the", b"und"]
    got = list(one.batch(texts))
    codes, lengths = language._padded([b"the", b"und", b"the", b"the"])
    logp, _ = language._labels(net, codes, lengths)
    pooled = logp.sum(axis=(0, 1))
    assert got[0][0] == net.languages[int(np.argmax(pooled))]
    assert got[0][1] == pytest.approx(float(np.exp(logp).sum(axis=(0, 1))[np.argmax(pooled)] / 12), rel=1e-4)
