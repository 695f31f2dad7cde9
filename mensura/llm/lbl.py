"""Log-bilinear language model over word classes, trained by noise-contrastive estimation.

The model predicts the next class from the two before it.  Every class has an
input and an output vector; a context predicts the vector
``R[h1] @ C1 + R[h2] @ C2``, and a class scores by its product with that
prediction plus a bias.  Classes are the most frequent words, one class per
word, and for all other words a class per hashed ending; inside a class words
follow their smoothed counts, so every word and every unseen word has a
probability and all of them sum to one.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np

SHORTLIST, ENDINGS, WIDTH = 640, 383, 16
#: noise classes shared by the tokens of a batch
NOISE, BATCH, RATE = 48, 2048, 0.05
END = b""  # no word is empty


def ending(word: bytes) -> int:
    """Class of a word outside the shortlist, from 0."""
    return zlib.crc32(word[-3:]) % ENDINGS


@dataclass
class Vocabulary:
    """Class 0 is the end of text and stands before its start; then the shortlist; then endings."""

    shortlist: list[bytes]
    class_counts: np.ndarray  # training tokens of each class
    class_types: np.ndarray  # distinct training words of each class

    def __post_init__(self):
        self.index = {w: i + 1 for i, w in enumerate(self.shortlist)}
        self.index[END] = 0
        self.first_ending = len(self.shortlist) + 1

    @property
    def classes(self) -> int:
        return self.first_ending + ENDINGS

    def class_of(self, word: bytes) -> int:
        found = self.index.get(word)
        return self.first_ending + ending(word) if found is None else found

    def within(self, classes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Natural log probability of words with ``counts`` inside their classes."""
        mass = self.class_counts[classes] + 0.5 * (self.class_types[classes] + 1)
        return np.where(classes < self.first_ending, 0.0, np.log((counts + 0.5) / mass))


class Parameters:
    """R (inputs), Q (outputs), C1 and C2 (one matrix per context position), b (biases)."""

    def __init__(self, classes: int, flat: np.ndarray | None = None, width: int = WIDTH):
        self.shapes = {"R": (classes, width), "Q": (classes, width), "C1": (width, width), "C2": (width, width), "b": (classes,)}
        size = sum(map(math.prod, self.shapes.values()))
        self.flat = np.zeros(size, dtype=np.float32) if flat is None else np.array(flat, dtype=np.float32)
        at = 0
        for name, shape in self.shapes.items():
            n = math.prod(shape)
            setattr(self, name, self.flat[at : at + n].reshape(shape))  # views: updates reach ``flat``
            at += n

    @classmethod
    def new(cls, noise: np.ndarray, seed: int = 17) -> "Parameters":
        made = cls(len(noise))
        draw = np.random.default_rng(seed)
        made.R[:] = draw.normal(0, 0.3, made.R.shape)
        made.Q[:] = draw.normal(0, 0.1, made.Q.shape)
        made.C1[:], made.C2[:] = np.eye(WIDTH), 0.7 * np.eye(WIDTH)
        made.b[:] = np.log(noise)
        return made

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Score parts of both positions, and the log normaliser of every context.

        The score of class w after (h1, h2) is ``A1[h1, w] + A2[h2, w]`` (biases in A1),
        so the normalisers of all contexts are one matrix product of their exponentials.
        """
        q = self.Q.astype(np.float64)
        a1 = self.R.astype(np.float64) @ self.C1 @ q.T + self.b
        a2 = self.R.astype(np.float64) @ self.C2 @ q.T
        m1, m2 = a1.max(axis=1, keepdims=True), a2.max(axis=1, keepdims=True)
        z = np.log(np.exp(a1 - m1) @ np.exp(a2 - m2).T + 1e-300) + m1 + m2.T
        return a1.astype(np.float32), a2.astype(np.float32), z.astype(np.float32)


def _sums(rows: int, at: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of ``values`` by row: sorted runs are much faster than scattered additions."""
    order = np.argsort(at, kind="stable")
    begin = np.flatnonzero(np.concatenate([[True], at[order][1:] != at[order][:-1]]))
    out = np.zeros((rows, *values.shape[1:]), dtype=np.float32)
    out[at[order][begin]] = np.add.reduceat(values[order], begin, axis=0)
    return out


def _sides(p: Parameters, predicted: np.ndarray, w: np.ndarray, noise: np.ndarray, log_k_noise: np.ndarray):
    true = np.einsum("ij,ij->i", predicted, p.Q[w]) + p.b[w] - log_k_noise[w]
    return true, predicted @ p.Q[noise].T + (p.b[noise] - log_k_noise[noise])


def loss(p: Parameters, h1: np.ndarray, h2: np.ndarray, w: np.ndarray, noise: np.ndarray, log_k_noise: np.ndarray) -> float:
    """NCE loss per token; ``log_k_noise`` is log(k * noise probability) by class."""
    true, false = _sides(p, p.R[h1] @ p.C1 + p.R[h2] @ p.C2, w, noise, log_k_noise)
    return float((np.logaddexp(0, -true).sum() + np.logaddexp(0, false).sum()) / len(w))


def gradient(p: Parameters, h1: np.ndarray, h2: np.ndarray, w: np.ndarray, noise: np.ndarray, log_k_noise: np.ndarray) -> Parameters:
    """Gradient of ``loss``."""
    r1, r2 = p.R[h1], p.R[h2]
    predicted = r1 @ p.C1 + r2 @ p.C2
    true, false = _sides(p, predicted, w, noise, log_k_noise)
    n = np.float32(1 / len(w))
    with np.errstate(over="ignore"):  # an infinite exponential gives the limit 0
        miss = -n / (1 + np.exp(true))  # (sigmoid(true) - 1) / tokens
        wrong = n / (1 + np.exp(-false))
    g = Parameters(len(p.b))
    down = miss[:, None] * p.Q[w] + wrong @ p.Q[noise]
    g.Q[:] = _sums(len(p.b), w, miss[:, None] * predicted)
    np.add.at(g.Q, noise, wrong.T @ predicted)
    g.b[:] = _sums(len(p.b), w, miss)
    np.add.at(g.b, noise, wrong.sum(axis=0))
    g.C1[:], g.C2[:] = r1.T @ down, r2.T @ down
    g.R[:] = _sums(len(p.b), np.concatenate([h1, h2]), np.concatenate([down @ p.C1.T, down @ p.C2.T]))
    return g


class Trainer:
    """Adagrad over batches of shuffled tokens."""

    def __init__(self, start: Parameters, noise: np.ndarray, seed: int):
        self.p = Parameters(len(noise), start.flat)
        self.noise = np.cumsum(noise)
        self.log_k_noise = np.log(NOISE * noise).astype(np.float32)
        self.squares = np.full_like(self.p.flat, 1e-6)
        self.draw = np.random.default_rng(seed)
        self.tokens = 0

    def learn(self, h1: np.ndarray, h2: np.ndarray, w: np.ndarray) -> None:
        order = self.draw.permutation(len(w))
        for i in range(0, len(w), BATCH):
            at = order[i : i + BATCH]
            noise = np.searchsorted(self.noise, self.draw.random(NOISE) * self.noise[-1], side="right")
            g = gradient(self.p, h1[at], h2[at], w[at], np.minimum(noise, len(self.noise) - 1), self.log_k_noise)
            self.squares += g.flat**2
            self.p.flat -= np.float32(RATE) * g.flat / np.sqrt(self.squares)
        self.tokens += len(w)


def contexts(classes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(one before, two before, class) of all tokens of texts whose last class is the end."""
    kind = classes[0].dtype  # sorting 16-bit codes is several times faster
    padded = np.concatenate([np.zeros(2, dtype=kind), *[x for c in classes for x in (c, np.zeros(1, dtype=kind))]])
    # the text's own end and one more zero stand between texts
    keep = np.ones(len(padded), dtype=bool)
    ends = np.cumsum([len(c) + 1 for c in classes]) + 1
    keep[:2] = False
    keep[ends] = False
    at = np.flatnonzero(keep)
    return padded[at - 1], padded[at - 2], padded[at]


def noise_distribution(vocabulary: Vocabulary) -> np.ndarray:
    mass = vocabulary.class_counts + 1.0
    return mass / mass.sum()


def averaged(parts: Iterable[tuple[np.ndarray, float]]) -> np.ndarray | None:
    total, weight = None, 0.0
    for flat, w in parts:
        total = flat * w if total is None else total + flat * w
        weight += w
    return None if not weight else total / weight
