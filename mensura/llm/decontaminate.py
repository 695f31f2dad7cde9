"""Benchmark decontamination with an FM-index per training shard.

A shard (the documents of about ``SHARD_BYTES``) is read as a sequence of word
codes.  Words that occur in no benchmark phrase break the sequence, and so do
document ends; stretches shorter than the shortest phrase cannot hold one and
are left out.  Over the rest stands an FM-index: suffix array by prefix
doubling, Burrows-Wheeler transform in a wavelet matrix, and text positions
sampled every ``SAMPLE_EVERY`` words.  All phrases are searched backwards at
once through wavelet ranks, every occurrence is located by walking to the next
sampled position, and the found word ranges merge into removal spans.

A phrase is a window of ``window`` words of an item; an item of fewer words,
but not none, is one phrase.  Benchmarks are searched in blocks of about
``BENCHMARK_BYTES`` text, one after the other, and rows with hits are written
between them, so what the driver and the tasks hold at once has a bound for a
benchmark of any size (a single longer item is a block by itself).

Null and empty texts have no words and are never contaminated.  Items without
words and null items have no phrase; an item whose id is null marks words but
is not listed; equal ids are one item.  Repeated rows get equal results; extra
columns are not read; an empty table stays empty, and an empty benchmark hits
nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from mensura.llm.common import byte_batches, fresh, raw_texts, shared_folder, written

WINDOW = 13
SHARD_BYTES = 16 << 20
SAMPLE_EVERY = 8
BENCHMARK_BYTES = 4 << 20

#: ASCII digits and small letters, and every character beyond ASCII
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
SPANS = "array<struct<first:int,last:int,from_byte:bigint,to_byte:bigint>>"
FOUND = f"struct<n_words:bigint,spans:{SPANS},items:array<string>>"


@dataclass
class Phrases:
    """Word codes from 1, and per length the phrases with the items they come from."""

    codes: dict[bytes, int]
    tables: list[tuple[np.ndarray, list[list[str]]]]

    @property
    def shortest(self) -> int:
        return min(t.shape[1] for t, _ in self.tables)


def phrases(items: list[tuple[str | None, str | None]], window: int = WINDOW) -> Phrases:
    codes: dict[bytes, int] = {}
    found: dict[tuple[int, ...], set[str]] = {}
    for item, text in items:
        words = [codes.setdefault(w, len(codes) + 1) for w in WORD.findall((text or "").encode().lower())]
        for i in range(max(1, len(words) - window + 1) if words else 0):
            found.setdefault(tuple(words[i : i + window]), set()).update([] if item is None else [item])
    tables = []
    for length in sorted({len(p) for p in found}):
        chosen = [p for p in found if len(p) == length]
        tables.append((np.array(chosen, dtype=np.int64), [sorted(found[p]) for p in chosen]))
    return Phrases(codes, tables)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix order of codes whose zeros are separators, each smaller than the next and than all words."""
    n, zero = len(text), text == 0
    rank = np.where(zero, np.cumsum(zero) - 1, text + zero.sum() - 1).astype(np.int64)
    step = 1
    while True:
        following = np.zeros(n, dtype=np.int64)
        following[:-step] = rank[step:] + 1
        key = rank * (int(rank.max()) + 2) + following
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        if rank[order[-1]] == n - 1:
            return order
        step *= 2


class WaveletMatrix:
    """Ranks of codes in a sequence, one bit vector with running counts per code bit."""

    def __init__(self, sequence: np.ndarray, bits: int):
        self.bits, self.ones, self.zeros = bits, [], []
        for bit in range(bits - 1, -1, -1):
            digit = (sequence >> bit & 1).astype(bool)
            self.ones.append(np.concatenate([[0], np.cumsum(digit, dtype=np.int32)]))
            self.zeros.append(len(sequence) - int(self.ones[-1][-1]))
            sequence = np.concatenate([sequence[~digit], sequence[digit]])

    def rank(self, code: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often ``code`` occurs before position ``at``."""
        start, end = np.zeros_like(at), at
        for level, (ones, zeros) in enumerate(zip(self.ones, self.zeros)):
            digit = (code >> (self.bits - 1 - level) & 1).astype(bool)
            start = np.where(digit, zeros + ones[start], start - ones[start])
            end = np.where(digit, zeros + ones[end], end - ones[end])
        return end - start


class FMIndex:
    """Backward search and location over stretches of codes, each ended by a zero."""

    def __init__(self, text: np.ndarray, n_codes: int, every: int = SAMPLE_EVERY):
        order = suffix_array(text)
        self.n = len(text)
        self.last = text[order - 1]  # of row 0 of the text: the final zero
        self.wavelet = WaveletMatrix(self.last, max(1, int(n_codes).bit_length()))
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=n_codes + 1))])
        begins = np.concatenate([[True], text[:-1] == 0])  # walks never cross a separator
        sampled = begins[order] | (order % every == 0)
        self.sampled, self.place = sampled, np.cumsum(sampled) - 1
        self.positions = order[sampled]

    def search(self, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(phrase, first row, end row) of the phrases that occur."""
        alive = np.arange(len(table))
        lo, hi = np.zeros(len(table), dtype=np.int64), np.full(len(table), self.n, dtype=np.int64)
        for j in range(table.shape[1] - 1, -1, -1):
            code = table[alive, j]
            lo = self.before[code] + self.wavelet.rank(code, lo)
            hi = self.before[code] + self.wavelet.rank(code, hi)
            some = lo < hi
            alive, lo, hi = alive[some], lo[some], hi[some]
        return alive, lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text position of each row's suffix."""
        out, walked = np.empty(len(rows), dtype=np.int64), 0
        open_ = np.arange(len(rows))
        while len(open_):
            done = self.sampled[rows]
            out[open_[done]] = self.positions[self.place[rows[done]]] + walked
            open_, rows = open_[~done], rows[~done]
            code = self.last[rows]
            rows = self.before[code] + self.wavelet.rank(code, rows)
            walked += 1
        return out


def _stretches(codes: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """Known stretches of at least ``shortest`` codes, a zero after each, and their positions."""
    known = np.concatenate([[False], codes > 0, [False]])
    edges = np.flatnonzero(known[1:] != known[:-1])
    begin, end = edges[::2], edges[1::2]
    long = end - begin >= shortest
    begin, end = begin[long], end[long]
    sizes = end - begin + 1  # the position after a stretch is not known: its zero
    place = np.repeat(begin - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
    return codes[place], place


def search_shard(texts: list[bytes], wanted: Phrases) -> list[tuple[int, list[dict], list[str]]]:
    """(words, merged spans, items) of every document of one shard."""
    get = wanted.codes.get
    parts, counts = [], []
    for text in texts:
        words = WORD.findall(text.lower())
        counts.append(len(words))
        parts.append(np.fromiter((get(w, 0) for w in words), dtype=np.int32, count=len(words)))
        parts.append(np.zeros(1, dtype=np.int32))  # phrases end with their document
    codes = np.concatenate(parts)
    starts = np.concatenate([[0], np.cumsum(np.array(counts) + 1)])
    found = [(n, [], []) for n in counts]
    text, place = _stretches(codes, wanted.shortest) if wanted.tables else (codes[:0], codes[:0])
    if not len(text):
        return found
    index = FMIndex(text.astype(np.int64), len(wanted.codes))
    change = np.zeros(len(codes) + 1, dtype=np.int64)
    items: dict[int, set[str]] = {}
    for table, owners in wanted.tables:
        phrase, lo, hi = index.search(table)
        sizes = hi - lo
        rows = np.repeat(lo - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
        at = place[index.locate(rows)]
        np.add.at(change, at, 1)
        np.add.at(change, at + table.shape[1], -1)
        doc = np.searchsorted(starts, at, side="right") - 1
        for d, p in np.unique(np.column_stack([doc, np.repeat(phrase, sizes)]), axis=0).tolist():
            items.setdefault(d, set()).update(owners[p])
    hit = np.concatenate([[False], np.cumsum(change)[:-1] > 0, [False]])
    edges = np.flatnonzero(hit[1:] != hit[:-1])
    spans: dict[int, list[tuple[int, int]]] = {}
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
        d = int(np.searchsorted(starts, a, side="right")) - 1
        spans.setdefault(d, []).append((a - int(starts[d]), b - int(starts[d])))
    for d, ranges in spans.items():
        found[d] = (counts[d], _with_bytes(texts[d], ranges), sorted(items.get(d, ())))
    return found


def _with_bytes(text: bytes, ranges: list[tuple[int, int]]) -> list[dict]:
    words = [m.span() for m in WORD.finditer(text.lower())]
    return [{"first": a, "last": b - 1, "from_byte": words[a][0], "to_byte": words[b - 1][1]} for a, b in ranges]


def _merged(spans: list[dict]) -> list[dict]:
    """Ranges of several searches of one text as one; neighbours and overlaps join."""
    out: list[dict] = []
    for span in sorted(spans, key=lambda s: (s["first"], s["last"])):
        if out and span["first"] <= out[-1]["last"] + 1:
            if span["last"] > out[-1]["last"]:
                out[-1] = {**out[-1], "last": span["last"], "to_byte": span["to_byte"]}
        else:
            out.append(span)
    return out


def _searched(wanted: Phrases):
    def shards(column: pa.Array) -> Iterator[tuple[int, list[dict], list[str]]]:
        data, offsets = raw_texts(column)
        for a, b in byte_batches(offsets, SHARD_BYTES):
            yield from search_shard([data[offsets[i] : offsets[i + 1]] for i in range(a, b)], wanted)

    return shards


def _packed(rows: list[tuple[int, list[dict], list[str]]]) -> pa.Array:
    fields = [("first", pa.int32()), ("last", pa.int32()), ("from_byte", pa.int64()), ("to_byte", pa.int64())]
    return pa.StructArray.from_arrays(
        [
            pa.array([n for n, _, _ in rows], type=pa.int64()),
            pa.array([s for _, s, _ in rows], type=pa.list_(pa.struct(fields))),
            pa.array([i for _, _, i in rows], type=pa.list_(pa.string())),
        ],
        names=["n_words", "spans", "items"],
    )


def hits(text: Column, wanted: Phrases) -> Column:
    """Struct of ``n_words``, merged ``spans`` (words first to last, bytes from and to) and sorted ``items``."""

    @F.arrow_udf(FOUND)
    def search(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        shards = _searched(wanted)
        for column in batches:
            yield _packed(list(shards(column)))

    return search(text)


def _joined(spans: Column) -> Column:
    @F.arrow_udf(SPANS)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        fields = [("first", pa.int32()), ("last", pa.int32()), ("from_byte", pa.int64()), ("to_byte", pa.int64())]
        for column in batches:
            yield pa.array([_merged(held) for held in column.to_pylist()], pa.list_(pa.struct(fields)))

    return run(spans)


def phrase_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW,
                  limit: int = BENCHMARK_BYTES) -> Iterator[Phrases]:
    """The benchmark's phrases in blocks of about ``limit`` bytes of text, fetched one at a time."""
    items = benchmark.filter(F.col(text_col).isNotNull()).select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-total // limit))
    block = F.pmod(F.xxhash64("item", "text"), F.lit(parts))
    for k in range(parts):
        yield phrases(sorted(map(tuple, items.filter(block == k).collect()), key=str), window)


def with_hits(docs: DataFrame, blocks: Iterable[Phrases], name: str, text_col: str = "text") -> DataFrame:
    """``docs`` with the struct of ``hits`` for all ``blocks`` in the column ``name``.

    A benchmark of one block is one pass.  More are searched one after the other:
    each block's rows with hits are written before the next block is fetched,
    so neither the driver nor a task ever holds two, and rows meet by shuffle.
    """
    blocks = iter(blocks)
    first = next(blocks, Phrases({}, []))
    second = next(blocks, None)
    if second is None:
        return docs.withColumn(name, hits(F.col(text_col), first))
    at = fresh(docs, "at")
    held = written(docs.withColumn(at, F.monotonically_increasing_id()), "documents", compression="zstd")
    folder = shared_folder(docs.sparkSession, "hits")
    for k, block in enumerate(chain([first, second], blocks)):
        found = held.select(F.col(at).alias("at"), hits(F.col(text_col), block).alias("f")).select("at", "f.*")
        (found if k == 0 else found.filter(F.size("spans") > 0)).write.parquet(f"{folder}/block={k}")
    every = docs.sparkSession.read.parquet(folder)
    met = every.groupBy("at").agg(
        F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    ).select(F.col("at").alias(at), F.struct("n_words", _joined(F.col("spans")).alias("spans"), "items").alias(name))
    return held.join(met, at).select(*docs.columns, name)


def contamination(docs: DataFrame, blocks: Iterable[Phrases], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, ``n_words``, ``n_hit``, ``n_items``, ``items_sha256``, ``contaminated``, ``spans`` of every row."""
    found = with_hits(docs.select(F.col(id_col), F.col(text_col)), blocks, "_found", text_col)
    out = found.select(
        id_col, F.col("_found.n_words").alias("n_words"), n_hit(F.col("_found")).alias("n_hit"),
        F.size("_found.items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "_found.items").cast("binary"), 256).alias("items_sha256"),
        is_contaminated(F.col("_found")).alias("contaminated"), F.col("_found.spans").alias("spans"),
    )
    return out


def n_hit(found: Column) -> Column:
    return F.aggregate(found["spans"], F.lit(0).cast("bigint"), lambda s, x: s + x["last"] - x["first"] + 1)


def is_contaminated(found: Column) -> Column:
    """At least one word in twenty is hit."""
    return (n_hit(found) > 0) & (20 * n_hit(found) >= found["n_words"])


def without_spans(text: Column, spans: Column) -> Column:
    """The text with its removal spans cut out; null stays null."""

    @F.arrow_udf("string")
    def cut(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, ranges in batches:
            out = []
            for whole, spans in zip(texts.to_pylist(), ranges.to_pylist()):
                if whole is not None and spans:
                    data = whole.encode()
                    edges = [0, *[e for s in spans for e in (s["from_byte"], s["to_byte"])], len(data)]
                    whole = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2])).decode("utf-8", "replace")
                out.append(whole)
            yield pa.array(out, type=pa.string())

    return cut(text, spans)
