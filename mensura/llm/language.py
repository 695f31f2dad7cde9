"""Language ID by a bidirectional gated recurrent network over bytes.

A text is read as runs of letter bytes (ASCII letters in lower case and all
bytes of multi-byte characters), a run longer than ``RUN`` bytes in pieces.
Over each run one gated unit reads forwards and one backwards; both states
together label every byte position with a distribution over the languages.  The
document's probabilities pool all positions of the whole text.  Since the state
starts anew with each run, equal runs have equal labels and are computed once
per worker and weighted by their counts.

The network is trained in NumPy by backpropagation through time on a bounded
sample: ``SAMPLE_DOCS`` rows of each language by hash, ``SAMPLE_RUNS`` runs
spread over each of their whole texts.

``lang_pred`` has the largest summed log probability and ``score`` is its mean
probability over positions.  Null texts and texts without any letter get
``und`` and 0; so do all texts if no row teaches a language.  Ties fall to the
language first in sort order.  Repeated rows get equal results; extra columns
are not read; an empty table stays empty.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from mensura.llm.common import byte_batches, fold, raw_texts, sample_per

RUN = 32
SAMPLE_DOCS, SAMPLE_RUNS = 200, 120
HIDDEN, STEPS, BATCH, RATE = 16, 320, 512, 0.02
BATCH_BYTES = 8 << 20
#: runs kept per worker; what is forgotten is computed again
MEMO_RUNS = 400_000

_RUNS = re.compile(rb"[a-z\x80-\xff]{1,%d}" % RUN)


@dataclass
class Network:
    """Per direction: byte table (256 x 3H, input weights and biases of update, reset and candidate), recurrent weights."""

    languages: list[str]
    parts: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def new(cls, languages: list[str], hidden: int = HIDDEN, seed: int = 5) -> "Network":
        draw = np.random.default_rng(seed)
        parts = {}
        for d in "fb":
            parts[d + "x"] = draw.normal(0, 0.4, (256, 3 * hidden)).astype(np.float32)
            parts[d + "x"][:, :hidden] -= 1.0  # start by keeping most of the state
            parts[d + "g"] = draw.normal(0, 0.25, (hidden, 2 * hidden)).astype(np.float32)
            parts[d + "c"] = draw.normal(0, 0.25, (hidden, hidden)).astype(np.float32)
        parts["v"] = draw.normal(0, 0.3, (2 * hidden, len(languages))).astype(np.float32)
        parts["o"] = np.zeros(len(languages), dtype=np.float32)
        return cls(languages, parts)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1.0)


def _padded(runs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(r) for r in runs])
    width = int(lengths.max())
    flat = np.frombuffer(b"".join(r.ljust(width, b"\0") for r in runs), dtype=np.uint8)
    return flat.reshape(len(runs), width), lengths


def _backwards(codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions read by the backward unit: reversed within each run, padding stays behind."""
    at = np.arange(codes.shape[1])
    return np.where(at < lengths[:, None], lengths[:, None] - 1 - at, at)


def _unit(net: Network, d: str, codes: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States (runs, positions, hidden) of one gated unit reading ``codes`` from the left."""
    x, g, c = (net.parts[d + k] for k in "xgc")
    n = g.shape[0]
    state = np.zeros((codes.shape[0], n), dtype=np.float32)
    states = np.empty((*codes.shape, n), dtype=np.float32)
    for t in range(codes.shape[1]):
        a = x[codes[:, t]]
        gates = _sigmoid(a[:, : 2 * n] + state @ g)
        z, r = gates[:, :n], gates[:, n:]
        candidate = np.tanh(a[:, 2 * n :] + (r * state) @ c)
        if keep is not None:
            keep.append((state, z, r, candidate))
        state = state + z * (candidate - state)
        states[:, t] = state
    return states


def _labels(net: Network, codes: np.ndarray, lengths: np.ndarray, keep: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Log probabilities (runs, positions, languages) and the joint states."""
    turn = _backwards(codes, lengths)
    rows = np.arange(len(codes))[:, None]
    kf, kb = ([], []) if keep is not None else (None, None)
    forward = _unit(net, "f", codes, kf)
    backward = _unit(net, "b", codes[rows, turn], kb)[rows, turn]
    both = np.concatenate([forward, backward], axis=2)
    logits = both @ net.parts["v"] + net.parts["o"]
    logits -= logits.max(axis=2, keepdims=True)
    logp = logits - np.log(np.exp(logits).sum(axis=2, keepdims=True))
    if keep is not None:
        keep.update(f=kf, b=kb, turn=turn)
    return logp, both


def _through_time(net: Network, d: str, codes: np.ndarray, kept: list, upper: np.ndarray, grads: dict) -> None:
    """Backpropagation through time of one unit; ``upper`` is the gradient at its states."""
    g, c = net.parts[d + "g"], net.parts[d + "c"]
    n = g.shape[0]
    dg, dc = np.zeros_like(g), np.zeros_like(c)
    inputs = np.empty((*codes.shape, 3 * n), dtype=np.float32)
    carried = np.zeros((codes.shape[0], n), dtype=np.float32)
    for t in range(codes.shape[1] - 1, -1, -1):
        state, z, r, candidate = kept[t]
        down = upper[:, t] + carried
        dcand = down * z * (1 - candidate * candidate)
        dreset = dcand @ c.T
        dgates = np.concatenate([down * (candidate - state) * z * (1 - z), dreset * state * r * (1 - r)], axis=1)
        carried = down * (1 - z) + dreset * r + dgates @ g.T
        dg += state.T @ dgates
        dc += (r * state).T @ dcand
        inputs[:, t] = np.concatenate([dgates, dcand], axis=1)
    hot = np.zeros((codes.size, 256), dtype=np.float32)
    hot[np.arange(codes.size), codes.reshape(-1)] = 1
    grads[d + "x"] = hot.T @ inputs.reshape(-1, 3 * n)
    grads[d + "g"], grads[d + "c"] = dg, dc


def gradients(net: Network, codes: np.ndarray, lengths: np.ndarray, target: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross entropy over positions and its gradients."""
    keep: dict = {}
    logp, both = _labels(net, codes, lengths, keep)
    mask = np.arange(codes.shape[1]) < lengths[:, None]
    rows = np.arange(len(codes))
    count = mask.sum()
    loss = -float((logp[rows, :, target] * mask).sum() / count)
    upper = np.exp(logp)
    upper[rows, :, target] -= 1
    upper *= (mask / count)[:, :, None].astype(np.float32)
    grads = {"v": np.tensordot(both, upper, axes=([0, 1], [0, 1])), "o": upper.sum(axis=(0, 1))}
    below = upper @ net.parts["v"].T
    n = below.shape[2] // 2
    turn, at = keep["turn"], rows[:, None]
    _through_time(net, "f", codes, keep["f"], below[:, :, :n], grads)
    _through_time(net, "b", codes[at, turn], keep["b"], below[:, :, n:][at, turn], grads)
    return loss, grads


def train(runs: list[list[bytes]], languages: list[str], steps: int = STEPS, seed: int = 11) -> Network:
    """Adam on batches that draw every language equally often."""
    net = Network.new(languages)
    draw = np.random.default_rng(seed)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.parts.items()}
    for step in range(1, steps + 1):
        target = draw.integers(0, len(languages), BATCH)
        chosen = [runs[k][draw.integers(0, len(runs[k]))] for k in target]
        codes, lengths = _padded(chosen)
        _, grads = gradients(net, codes, lengths, target)
        rate = RATE * min(1.0, 2.0 * (1 - step / (steps + 1)))
        for name, value in net.parts.items():
            m, v = moments[name]
            m += 0.1 * (grads[name] - m)
            v += 0.01 * (grads[name] ** 2 - v)
            value -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return net


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4,
        held_out: int = 2) -> Network:
    """Learn from rows with a language whose id does not fold to ``held_out``."""

    @F.arrow_udf("array<binary>")
    def spread(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            data, offsets = raw_texts(column)
            rows = []
            for a, b in zip(offsets[:-1], offsets[1:]):
                found = _RUNS.findall(data[a:b].lower())
                at = np.unique(np.linspace(0, len(found) - 1, SAMPLE_RUNS).astype(int)) if found else []
                rows.append([found[i] for i in at])
            yield pa.array(rows, type=pa.list_(pa.binary()))

    teaches = F.col(lang_col).isNotNull() & (fold(F.col(id_col), folds) != held_out)
    rows = docs.filter(teaches).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # one row per language
    if not counts:
        return Network([])
    # a draw below the language's share leaves about eight times the sample for the exact choice
    draw = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30))
    share = F.create_map(*[F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, int(min(1.0, 8 * SAMPLE_DOCS / n) * (1 << 30)))])
    few = rows.filter(F.col("text").isNotNull() & (draw < share[F.col("lang")]))
    chosen = sample_per(few, "lang", F.struct(draw, "id", "text"), SAMPLE_DOCS)
    runs: dict[str, list[bytes]] = {}
    for row in chosen.select("lang", spread(F.col("text")).alias("runs")).collect():
        runs.setdefault(row["lang"], []).extend(bytes(x) for x in row["runs"])
    languages = sorted(k for k, v in runs.items() if v)
    # rows arrive in no fixed order: sorting makes the training repeatable
    return train([sorted(runs[k]) for k in languages], languages) if languages else Network([])


class Labeller:
    """Sums of (log) probabilities per run, remembered between batches."""

    def __init__(self, net: Network):
        self.net, self.at = net, {}
        self.sums = np.zeros((0, 2 * len(net.languages)), dtype=np.float32)

    def learn(self, runs: set[bytes]) -> None:
        new = sorted(runs.difference(self.at), key=len)
        if len(self.at) + len(new) > MEMO_RUNS:
            self.at, self.sums = {}, self.sums[:0]
            new = sorted(runs, key=len)
        blocks = [self.sums]
        for i in range(0, len(new), 4096):
            codes, lengths = _padded(new[i : i + 4096])
            logp, _ = _labels(self.net, codes, lengths)
            mask = (np.arange(codes.shape[1]) < lengths[:, None])[:, :, None]
            blocks.append(np.concatenate([(logp * mask).sum(axis=1), (np.exp(logp) * mask).sum(axis=1)], axis=1))
        self.at.update(zip(new, range(len(self.at), len(self.at) + len(new))))
        self.sums = np.concatenate(blocks)

    def batch(self, texts: list[bytes]) -> Iterator[tuple[str, float]]:
        k = len(self.net.languages)
        found = [_RUNS.findall(t.lower()) if k and _has_letter(t) else [] for t in texts]
        self.learn(set().union(*found))
        for runs in found:
            if not runs:
                yield "und", 0.0
                continue
            at = np.fromiter(map(self.at.__getitem__, runs), dtype=np.int64, count=len(runs))
            pooled = self.sums[at].sum(axis=0, dtype=np.float64)
            best = int(np.argmax(pooled[:k]))
            yield self.net.languages[best], min(1.0, float(pooled[k + best] / pooled[k:].sum()))


def _has_letter(text: bytes) -> bool:
    return re.search(rb"[A-Za-z]", text) is not None or any(map(str.isalpha, text.decode("utf-8", "replace")))


def has_letter(text: Column) -> Column:
    """Whether each whole text has a letter; null has none."""

    @F.arrow_udf("boolean")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            data, offsets = raw_texts(column)
            yield pa.array([_has_letter(data[a:b]) for a, b in zip(offsets[:-1], offsets[1:])], type=pa.bool_())

    return run(text)


def identify(text: Column, net: Network) -> Column:
    """Struct of ``lang_pred`` and ``score`` for every whole text."""

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        labeller = Labeller(net)
        for column in batches:
            data, offsets = raw_texts(column)
            out: list[tuple[str, float]] = []
            for a, b in byte_batches(offsets, BATCH_BYTES):
                out += labeller.batch([data[offsets[i] : offsets[i + 1]] for i in range(a, b)])
            yield pa.StructArray.from_arrays(
                [pa.array([x for x, _ in out], type=pa.string()), pa.array([s for _, s in out], type=pa.float64())],
                names=["lang_pred", "score"],
            )

    return run(text)


def languages(docs: DataFrame, net: Network, folds: int = 4, held_out: int = 2, id_col: str = "doc_id",
              text_col: str = "text") -> DataFrame:
    """Columns id, ``held_out``, ``lang_pred``, ``score``."""
    found = docs.select(
        F.col(id_col), (fold(F.col(id_col), folds) == held_out).alias("held_out"),
        identify(F.col(text_col), net).alias("_found"),
    )
    return found.select(id_col, "held_out", "_found.*")
