"""Quality by compression: which dictionary makes a text smaller, good or bad?

Two zstandard dictionaries are trained, one on excerpts of texts labelled good,
one on excerpts of texts labelled bad.  A whole text is compressed in blocks
with each of them.  Two normalised differences of compressed sizes,

* ``log(bad size / good size)``: which dictionary fits better, and
* ``log(plain size / good size)``: how much the text repeats itself,

enter a logistic calibration fitted on other labelled texts than the
dictionaries, weighted to the label counts of the whole table.

Only labels train: at most ``SAMPLE`` rows of each label, chosen by a hash, the
one bound of this operator.  Every text is scored whole.  Null and empty texts
have both differences 0 and score like a text without evidence.  Repeated rows
get equal scores; extra columns are never read; a null label is no label, and
of several labels of one id the smallest counts.  With one label only the score
is that label's share, without labels 0.5.  An empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from mensura.llm.common import fold, raw_texts, sample_per

SAMPLE = 2000
BLOCK = 1024
EXCERPTS = 6
DICTIONARY_BYTES = 32 << 10
LEVEL = 3


@dataclass
class QualityModel:
    good: bytes
    bad: bytes
    weights: tuple[float, float, float]


def _excerpts(text: Column) -> Column:
    """Up to ``EXCERPTS`` blocks spread evenly over each text."""

    @F.arrow_udf("array<binary>")
    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            data, offsets = raw_texts(column)
            rows = []
            for a, b in zip(offsets[:-1], offsets[1:]):
                starts = np.unique(np.linspace(a, max(a, b - BLOCK), EXCERPTS).astype(np.int64)) if b > a else []
                rows.append([data[s : min(b, s + BLOCK)] for s in starts])
            yield pa.array(rows, type=pa.list_(pa.binary()))

    return cut(text)


def _dictionary(samples: list[bytes]) -> bytes:
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: the text itself serves
        return b"".join(samples)[-DICTIONARY_BYTES:]


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    data = zstandard.ZstdCompressionDict(dictionary)
    if dictionary:
        data.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_content_size=False, write_checksum=False)


class Sizes:
    """Both differences of a text."""

    def __init__(self, good: bytes, bad: bytes):
        self.good, self.bad = _compressor(good), _compressor(bad)

    def __call__(self, text: bytes) -> tuple[float, float]:
        if not text:
            return 0.0, 0.0
        g = b = 0
        for i in range(0, len(text), BLOCK):
            block = text[i : i + BLOCK]
            g += len(self.good.compress(block))
            b += len(self.bad.compress(block))
        return float(np.log(b / g)), float(np.log((len(text) + 8) / g))


def differences(text: Column, good: bytes, bad: bytes) -> Column:
    @F.arrow_udf("array<double>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        sizes = Sizes(good, bad)
        for column in batches:
            data, offsets = raw_texts(column)
            flat = np.array([sizes(data[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]).reshape(-1)
            ends = pa.array(np.arange(0, len(flat) + 1, 2), type=pa.int32())
            yield pa.ListArray.from_arrays(ends, pa.array(flat, type=pa.float64()))

    return run(text)


def score(text: Column, model: QualityModel) -> Column:
    """Calibrated probability of label 1, DOUBLE in [0, 1]."""

    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        sizes = Sizes(model.good, model.bad)
        bias, first, second = model.weights
        for column in batches:
            data, offsets = raw_texts(column)
            found = np.array([sizes(data[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]).reshape(-1, 2)
            yield pa.array(_logistic(bias + found @ np.array([first, second])))

    return run(text)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -500, 500)))


def _calibrate(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float, float]:
    """Weighted logistic regression by Newton steps; the ridge only keeps separable samples finite."""
    z = np.column_stack([np.ones(len(x)), x])
    beta, ridge = np.zeros(3), np.diag([1e-9, 1e-6, 1e-6]) * len(x)
    for _ in range(100):
        p = _logistic(z @ beta)
        step = np.linalg.solve(z.T @ (z * (w * p * (1 - p))[:, None]) + ridge, z.T @ (w * (y - p)) - ridge @ beta)
        beta = beta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return tuple(float(b) for b in beta)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality",
        held_out: int = 5) -> QualityModel:
    """Learn from labelled rows whose id does not fold to 0."""
    known = (
        labels.filter(F.col(id_col).isNotNull() & F.col(label).isNotNull() & (fold(F.col(id_col), held_out) != 0))
        .groupBy(F.col(id_col).alias("id")).agg(F.min(label).cast("int").alias("label"))
        .filter(F.col("label").isin(0, 1))
    )
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        share = next(iter(counts), 0.5)
        return QualityModel(b"", b"", (float(np.clip(np.log(max(share, 1e-9) / max(1 - share, 1e-9)), -20, 20)), 0.0, 0.0))
    # a draw below the label's share leaves about four times the sample for the exact choice
    draw = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1 << 30))
    share = F.create_map(*[F.lit(x) for q, n in sorted(counts.items()) for x in (q, int(min(1.0, 4 * SAMPLE / n) * (1 << 30)))])
    few = known.filter(draw < share[F.col("label")])
    chosen = F.broadcast(sample_per(few, "label", F.struct(draw, "id"), SAMPLE))  # two labels: 2 * SAMPLE rows at most
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(chosen, "id")
    texts = sample_per(texts, "label", F.struct(draw, "id", "text"), SAMPLE)
    teaches = F.pmod(F.xxhash64("id", F.lit(2)), F.lit(2)) == 0
    cut = texts.filter(teaches).select("label", _excerpts(F.col("text")).alias("cut")).collect()
    good, bad = (_dictionary([bytes(x) for r in cut if r["label"] == q for x in r["cut"]]) for q in (1, 0))
    rows = texts.filter(~teaches).select("label", differences(F.col("text"), good, bad).alias("x")).collect()
    x = np.array([r["x"] for r in rows]).reshape(-1, 2)
    y = np.array([r["label"] for r in rows], dtype=float)
    if not (0 < y.sum() < len(y)):
        return QualityModel(good, bad, (float(np.log(counts[1] / counts[0])), 10.0, 0.0))
    # the sample holds both labels in like numbers: weigh them as in the whole table
    w = np.where(y == 1, counts[1] / y.sum(), counts[0] / (len(y) - y.sum()))
    return QualityModel(good, bad, _calibrate(x, y, w * len(y) / w.sum()))


def classify(docs: DataFrame, model: QualityModel, threshold: float = 0.3, held_out: int = 5, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """Columns id, ``held_out``, ``score``, ``predicted``."""
    scored = docs.select(
        F.col(id_col), (fold(F.col(id_col), held_out) == 0).alias("held_out"),
        score(F.col(text_col), model).alias("score"),
    )
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
