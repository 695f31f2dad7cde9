"""N-gram Jaccard self join by vertical partitioning, exact, as classes of linked texts.

A text's set holds the 64-bit hashes of its distinct word shingles.  Two texts
link when ``100 * intersection >= percent * union``; classes are the connected
components of all links.

1. A pass writes each text's set size, set digest and a bitmap of the parity of
   its shingles by hash, and counts the shingles in a sketch of fixed size, from
   which frequent ones are known later.  Equal sets collapse.
2. The global order of the shingles (by hash, so that fragments are equally
   heavy) is cut into fragments, more of them than two linked sets of a size
   band can differ in.  Linked sets hence have equal segments in more than
   ``slack`` fragments and meet under such a segment.  A set leaves out its
   weak segments (empty or of frequent shingles only) as long as they are at
   most ``slack``; if more than ``slack`` are empty, it is cut once more in another order.
3. Sets that share a segment form a cell; cells of the same members are one.
   Cells propose pairs whose sizes and bitmaps allow a link: small cells all of
   them, larger ones in the first rounds the nearest and the leading partner of
   each member in another class, in the last all that are still in different
   classes.  A group of near copies thus costs a few pairs per member, and no
   link between classes is lost.  Cells above ``CELL`` rows are dealt to pairs of parts.
4. Pairs are verified vertically: the sets of cells are cut into ``FRAGMENTS``
   segments, the overlap of a pair is counted in every fragment by itself, and
   the partial overlaps are summed per pair.  Links join the classes.

Null texts and texts without words have no shingles and link with nothing; with
fewer words than a shingle the whole sequence is one.  Repeated rows share set
and class.  Null ids are in a class but never name it; a class without any id
is named null.  Two different sets with one 64-bit digest raise an error.  Only
the id and text columns are read.  An empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from mensura.llm.common import byte_batches, raw_texts, written
from mensura.llm.token_counts import sections
from mensura.operators.graph import connected_components

SHINGLE, PERCENT = 4, 85
#: log2 of the buckets of the frequency sketch; a bucket is frequent this many standard deviations above the mean, plus FLOOR
SKETCH_BITS, DEVIATIONS, FLOOR = 18, 4, 16
BITMAP_BITS = 512
FRAGMENTS = 8
#: rounds that propose nearest and leading partners only
NEAR_ROUNDS = 2
CELL, CHUNK_ROWS, BLOCK = 2048, 100_000, 256
#: cells up to this size are compared side by side and whole in the first round; runs up to RUN_ROWS are named by their members
SMALL, RUN_ROWS = 6, 100_000
BATCH_BYTES, OUT_ROWS = 4 << 20, 200_000
#: log2 of the bits of the filter of the texts whose sets are needed; where it is full, more are cut than needed
FILTER_BITS = 23
PARTIALS = 8
#: memory bounds per worker
MEMO_WORDS, MEMO_KEYS = 300_000, 500_000

_MULTIPLIER = np.uint64(0xD6E8FEB86659FD93)
_STEP = 0x9E3779B97F4A7C15


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A permutation of the 64-bit numbers in which every bit depends on all."""
    x = x + np.uint64(salt * _STEP & (1 << 64) - 1)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sorted distinct shingle hashes of texts; word hashes are kept between texts."""

    def __init__(self, width: int = SHINGLE):
        self.width = width
        self.words: dict[bytes, int] = {}

    def _hashes(self, section: bytes) -> np.ndarray:
        words = section.lower().split()
        try:
            return np.fromiter(map(self.words.__getitem__, words), dtype=np.uint64, count=len(words))
        except KeyError:
            if len(self.words) > MEMO_WORDS:
                self.words.clear()
            for word in set(words).difference(self.words):
                self.words[word] = xxhash.xxh3_64_intdigest(word)
            return np.fromiter(map(self.words.__getitem__, words), dtype=np.uint64, count=len(words))

    def of(self, text: bytes) -> np.ndarray:
        h = np.concatenate([self._hashes(s) for s in sections(text)])
        if not len(h):
            return h
        width = min(self.width, len(h))
        sums = np.full(len(h) - width + 1, width if width < self.width else 0, dtype=np.uint64)
        for i in range(width):
            sums = sums * _MULTIPLIER + h[i : len(h) - width + 1 + i]
        return np.unique(mixed(sums))


def differences(size: int, other: int, percent: int) -> int:
    """Largest symmetric difference of linked sets of these sizes."""
    return (100 - percent) * (size + other) // (100 + percent)


@lru_cache(maxsize=None)
def bands(percent: int, largest: int = 1 << 40) -> tuple[int, ...]:
    """Lower edges of the size bands."""
    edges = [1]
    while edges[-1] <= largest:
        edges.append(max(edges[-1] + 1, edges[-1] * 10_000 // percent**2))
    return tuple(edges)


@lru_cache(maxsize=1 << 16)
def cuts(size: int, percent: int) -> tuple[tuple[int, int, int], ...]:
    """(band, fragments, slack) of each band in which a set of ``size`` may have a larger or equal partner."""
    edges = bands(percent)
    band = int(np.searchsorted(edges, size, side="right")) - 1
    out = []
    while edges[band] * percent <= 100 * size:
        most = differences(edges[band + 1] - 1, edges[band + 1] - 1, percent)
        if most:
            slack = 1 + most // 8
            out.append((band, most + 1 + slack, slack))
        band += 1
    return tuple(out)


def signatures(shingles: np.ndarray, percent: int, frequent: np.ndarray) -> np.ndarray:
    """Hashes of the segments under which a set meets others; see the module text."""
    out = []
    rare = ~frequent[bucket(shingles)]
    for band, fragments, slack in cuts(len(shingles), percent):
        turn = 0
        while True:
            order, own = shingles, rare
            if turn:
                order = mixed(shingles, turn)
                place = np.argsort(order)
                order, own = order[place], rare[place]
            edges = np.searchsorted((order >> np.uint64(32)) * np.uint64(fragments) >> np.uint64(32), np.arange(fragments + 1, dtype=np.uint64))
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(order, 1), dtype=np.uint64)])
            filled = edges[1:] > edges[:-1]
            strong = np.diff(np.concatenate([[0], np.cumsum(own)])[edges]) > 0
            segments = (sums[edges[1:]] - sums[edges[:-1]]) + np.arange(fragments, dtype=np.uint64) * _MULTIPLIER
            chosen = strong if fragments - strong.sum() <= slack else filled
            out.append(mixed(segments[chosen], (band << 8) + turn + 2))
            if fragments - filled.sum() <= slack:
                break
            turn += 1
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)


def bucket(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(9)) & np.uint64((1 << SKETCH_BITS) - 1)


def bitmap(shingles: np.ndarray) -> bytes:
    """Parities by hash: two of them differ in at most as many bits as their sets have differences."""
    return np.packbits(np.bincount(shingles & np.uint64(BITMAP_BITS - 1), minlength=BITMAP_BITS) & 1).tobytes()


def _key(shingles: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(shingles.tobytes())


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, dtype=np.uint64).astype(np.int64))


def _texts(column: pa.Array) -> Iterator[tuple[int, int, list[bytes]]]:
    data, offsets = raw_texts(column)
    for a, b in byte_batches(offsets, BATCH_BYTES):
        yield a, b, [data[offsets[i] : offsets[i + 1]] for i in range(a, b)]


def marked_sets(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """``id``, ``n``, ``key``, ``second`` (another digest), ``bits`` of every row, and per task a row with its ``sketch``."""
    kind = docs.schema[id_col].dataType.simpleString()

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, sketch, rows = Shingler(width), np.zeros(1 << SKETCH_BITS, dtype=np.int64), 0
        for batch in batches:
            for a, b, texts in _texts(batch.column(1)):
                found = [shingler.of(t) for t in texts]
                sketch += np.bincount(bucket(np.concatenate(found)), minlength=len(sketch))
                rows += len(found)
                digests = [xxhash.xxh3_128_intdigest(s.tobytes()) for s in found]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(a, b - a), pa.array([len(s) for s in found], pa.int64()), _signed([_key(s) for s in found]),
                    _signed([d >> 64 for d in digests]), pa.array([bitmap(s) for s in found], pa.binary()), pa.nulls(len(found), pa.binary()),
                ], names=names)
        if rows:
            yield pa.RecordBatch.from_arrays(
                [*(pa.nulls(1, t) for t in (batch.column(0).type, pa.int64(), pa.int64(), pa.int64(), pa.binary())), pa.array([sketch.tobytes()], pa.binary())],
                names=names,
            )

    names = ["id", "n", "key", "second", "bits", "sketch"]
    return docs.select(id_col, text_col).mapInArrow(mark, f"id {kind}, n bigint, key bigint, second bigint, bits binary, sketch binary")


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for value in batch.column(0).to_pylist():
            own = np.frombuffer(value, dtype=np.int64)
            total = own if total is None else total + own
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sketch"])


def frequent_buckets(marked: DataFrame) -> np.ndarray:
    parts = marked.filter("sketch is not null").select("sketch").mapInArrow(_summed, "sketch binary")
    held = parts.repartition(PARTIALS).mapInArrow(_summed, "sketch binary").collect()
    counts = sum((np.frombuffer(r["sketch"], dtype=np.int64) for r in held), np.zeros(1 << SKETCH_BITS, dtype=np.int64))
    mean = counts.mean()
    return counts > mean + DEVIATIONS * np.sqrt(mean) + FLOOR


def cells(docs: DataFrame, text_col: str, width: int, percent: int, frequent: np.ndarray) -> DataFrame:
    """``sig``, ``key``: the different sets that share a segment with another set."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, seen = Shingler(width), set()
        for batch in batches:
            for _, _, texts in _texts(batch.column(0)):
                keys, found = [], []
                for text in texts:
                    shingles = shingler.of(text)
                    key = _key(shingles)
                    if key not in seen:
                        seen.add(key)
                        keys.append(key)
                        found.append(signatures(shingles, percent, frequent))
                if len(seen) > MEMO_KEYS:
                    seen = set()
                sizes = [len(s) for s in found]
                if sum(sizes):
                    own = np.repeat(np.array(keys, dtype=np.uint64), sizes)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(found).view(np.int64)), pa.array(own.view(np.int64))], names=["sig", "key"]
                    )

    signed = docs.select(text_col).mapInArrow(sign, "sig bigint, key bigint")
    met = signed.repartition("sig").sortWithinPartitions("sig", "key").mapInArrow(_shared, "cell bigint, key bigint")
    return met.distinct()


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of one signature with several keys, named by their members, so that equal cells fall together.

    At most ``RUN_ROWS`` and a batch are held; a longer run goes out row by row under its signature.
    """
    sig, key = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    long = None  # the signature of a run that is going out row by row
    cells = lambda cell, members: pa.RecordBatch.from_arrays([pa.array(cell), pa.array(members)], names=["cell", "key"])
    for batch in batches:
        sig, key = (np.concatenate([held, batch.column(i).to_numpy()]) for i, held in enumerate((sig, key)))
        if not len(sig):
            continue
        if long is not None:
            going = int(np.searchsorted(sig, long, side="right"))
            if going:
                yield cells(sig[:going], key[:going])
            sig, key = sig[going:], key[going:]
            if not len(sig):
                continue
            long = None
        last = int(np.searchsorted(sig, sig[-1], side="left"))
        yield cells(*_named(sig[:last], key[:last]))
        sig, key = sig[last:], key[last:]
        if len(sig) > RUN_ROWS and key[0] != key[-1]:
            long = sig[-1]
            yield cells(sig, key)
            sig, key = sig[:0], key[:0]
        elif len(sig) > RUN_ROWS:  # one key alone so far
            sig, key = sig[:1], key[:1]
    yield cells(*_named(sig, key))


def _named(sig: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cell and key of each different row whose signature has several keys."""
    if not len(sig):
        return sig, key
    other = np.concatenate([[True], (sig[1:] != sig[:-1]) | (key[1:] != key[:-1])])
    sig, key = sig[other], key[other]
    starts = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
    sizes = np.diff(np.append(starts, len(sig)))
    members = np.add.reduceat(mixed(key.view(np.uint64), 3), starts)
    return np.repeat(mixed(members).view(np.int64), sizes)[np.repeat(sizes > 1, sizes)], key[np.repeat(sizes > 1, sizes)]


def proposals(members: DataFrame, percent: int, every: bool, cell: int = CELL) -> DataFrame:
    """Pairs ``a`` < ``b`` of ``members`` (``cell``, ``key``, ``n``, ``bits``, ``component``) that may link across classes.

    Of cells up to ``SMALL`` rows these are all; of larger ones all only if ``every``.
    """
    open_ = members.groupBy("cell").agg(
        F.count(F.lit(1)).alias("rows"), F.min("component").alias("low"), F.max("component").alias("high")
    ).filter("low < high").select("cell", F.ceil(F.col("rows") / cell).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("key"), F.col("parts")).cast("int")
    with_each = F.transform(
        F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.struct(F.least(part, j).alias("u"), F.greatest(part, j).alias("v"))
    )
    dealt = members.join(open_, "cell").select("cell", "key", "n", "component", "bits", F.explode(with_each).alias("c"))
    met = dealt.select("cell", "c.u", "c.v", "key", "n", "component", "bits").repartition("cell", "u", "v").sortWithinPartitions("cell", "u", "v", "key")

    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= CHUNK_ROWS:
                whole = pa.Table.from_batches(held).combine_chunks()
                start = int(_starts(whole)[-1])
                yield from _pairs(whole.slice(0, start), percent, every)
                held = whole.slice(start).to_batches()
                rows -= start
        if held:
            yield from _pairs(pa.Table.from_batches(held).combine_chunks(), percent, every)

    return met.mapInArrow(propose, "a bigint, b bigint").distinct()


def _starts(rows: pa.Table) -> np.ndarray:
    keys = [rows.column(c).to_numpy() for c in ("cell", "u", "v")]
    change = np.zeros(rows.num_rows, dtype=bool)
    change[:1] = True
    for k in keys:
        change[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(change)


def _pairs(rows: pa.Table, percent: int, every: bool) -> Iterator[pa.RecordBatch]:
    """Proposed pairs of complete cells, each once."""
    if not rows.num_rows:
        return
    key, n, component = (rows.column(c).to_numpy() for c in ("key", "n", "component"))
    bits = np.frombuffer(b"".join(rows.column("bits").to_pylist()), dtype=np.uint64).reshape(rows.num_rows, -1)
    edges = np.append(_starts(rows), rows.num_rows)
    sizes = np.diff(edges)
    i, j = small_pairs(n, component, bits, np.repeat(sizes, sizes), np.repeat(edges[1:], sizes), percent)
    found = [np.column_stack([key[i], key[j]])]
    for a, b in zip(edges[:-1][sizes > SMALL], edges[1:][sizes > SMALL]):
        i, j = allowed_pairs(n[a:b], component[a:b], bits[a:b], percent, every)
        found.append(np.column_stack([key[a:b][i], key[a:b][j]]))
    found = [np.sort(f, axis=1) for f in found if len(f)]
    if found:
        pairs = np.unique(np.concatenate(found), axis=0)
        for i in range(0, len(pairs), OUT_ROWS):
            yield pa.RecordBatch.from_arrays([pa.array(pairs[i : i + OUT_ROWS, c].copy()) for c in (0, 1)], names=["a", "b"])


def small_pairs(n: np.ndarray, component: np.ndarray, bits: np.ndarray, size: np.ndarray, end: np.ndarray, percent: int
                ) -> tuple[np.ndarray, np.ndarray]:
    """All pairs that ``allowed_pairs`` finds in cells up to ``SMALL`` rows, side by side; ``size`` and ``end`` are those of each row's cell."""
    left, right = [], []
    at = np.flatnonzero((size > 1) & (size <= SMALL))
    for lag in range(1, SMALL):
        at = at[at + lag < end[at]]
        gap = np.bitwise_count(bits[at] ^ bits[at + lag]).sum(axis=1, dtype=np.int64)
        low, high = np.minimum(n[at], n[at + lag]), np.maximum(n[at], n[at + lag])
        ok = (component[at] != component[at + lag]) & (100 * low >= percent * high)
        ok &= gap * (100 + percent) <= (100 - percent) * (low + high)
        left.append(at[ok])
        right.append(at[ok] + lag)
    return np.concatenate(left), np.concatenate(right)


def allowed_pairs(n: np.ndarray, component: np.ndarray, bits: np.ndarray, percent: int, every: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rows of different classes whose sizes and bitmaps allow a link: all, or the leading and the nearest of each row."""
    left, right = [], []
    for a in range(0, len(n), BLOCK):
        b = min(len(n), a + BLOCK)
        gap = np.zeros((b - a, len(n)), dtype=np.int64)
        for w in range(bits.shape[1]):
            gap += np.bitwise_count(bits[a:b, w, None] ^ bits[None, :, w])
        low, high = np.minimum(n[a:b, None], n[None]), np.maximum(n[a:b, None], n[None])
        ok = (component[a:b, None] != component[None]) & (100 * low >= percent * high)
        ok &= gap * (100 + percent) <= (100 - percent) * (low + high)
        if every:
            i, j = np.nonzero(ok & (np.arange(a, b)[:, None] < np.arange(len(n))[None]))
        else:
            some = np.flatnonzero(ok.any(axis=1))
            i = np.concatenate([some, some])
            j = np.concatenate([ok[some].argmax(axis=1), np.where(ok[some], gap[some], BITMAP_BITS + 1).argmin(axis=1)])
        left.append(i + a)
        right.append(j)
    return np.concatenate(left), np.concatenate(right)


def _tag(id_: Column) -> Column:
    return F.xxhash64(F.coalesce(id_.cast("string"), F.lit("")))


def id_filter(chosen: DataFrame) -> np.ndarray:
    """Bit set of fixed size that holds the ids ``own`` of the sets to be cut."""
    tag = _tag(F.col("own"))
    word, bit = F.pmod(tag, F.lit(1 << FILTER_BITS - 6)).cast("int"), F.shiftrightunsigned(tag, 58).cast("int")
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), bit)
    held = chosen.select(word.alias("w"), one.alias("bit")).groupBy("w").agg(F.bit_or("bit").alias("bits")).toPandas()
    out = np.zeros(1 << FILTER_BITS - 6, dtype=np.uint64)
    out[held["w"].to_numpy(dtype=np.int64)] = held["bits"].to_numpy(dtype=np.int64).view(np.uint64)
    return out


def segments(docs: DataFrame, id_col: str, text_col: str, width: int, wanted: np.ndarray) -> DataFrame:
    """``key``, ``fragment``, ``seg``: sets of the texts whose id may be wanted, cut vertically.

    A set may come several times, from texts that share it.
    """
    edges = np.array([(i << 64) // FRAGMENTS for i in range(1, FRAGMENTS)], dtype=np.uint64)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, seen = Shingler(width), set()
        for batch in batches:
            tags = batch.column(0).to_numpy().view(np.uint64)
            held = wanted[tags % np.uint64(len(wanted))] >> (tags >> np.uint64(58)) & np.uint64(1)
            chosen = batch.column(1).take(pa.array(np.flatnonzero(held)))
            for _, _, texts in _texts(chosen):
                keys, parts = [], []
                for text in texts:
                    shingles = shingler.of(text)
                    key = _key(shingles)
                    if key not in seen:
                        seen.add(key)
                        keys.append(key)
                        parts += np.split(shingles, np.searchsorted(shingles, edges))
                if len(seen) > MEMO_KEYS:
                    seen = set()
                if keys:
                    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([
                        _signed(np.repeat(np.array(keys, dtype=np.uint64), FRAGMENTS)), pa.array(np.tile(np.arange(FRAGMENTS, dtype=np.int32), len(keys))),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts).view(np.int64))),
                    ], names=["key", "fragment", "seg"])

    return docs.select(_tag(F.col(id_col)), text_col).mapInArrow(cut, "key bigint, fragment int, seg array<bigint>")


def verified(pairs: DataFrame, segs: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """The pairs that link: overlaps are counted per fragment and summed per pair."""
    left = segs.select(F.col("key").alias("a"), "fragment", F.col("seg").alias("one"))
    right = segs.select(F.col("key").alias("b"), "fragment", F.col("seg").alias("two"))
    # the maximum drops what a set that comes several times repeats
    partial = pairs.join(left, "a").join(right, ["b", "fragment"]).groupBy("a", "b", "fragment").agg(
        F.max(F.size(F.array_intersect("one", "two"))).cast("bigint").alias("overlap")
    )
    summed = partial.groupBy("a", "b").agg(F.sum("overlap").alias("overlap"))
    both = summed.join(sizes.select(F.col("key").alias("a"), F.col("n").alias("n_a")), "a").join(
        sizes.select(F.col("key").alias("b"), F.col("n").alias("n_b")), "b"
    )
    return both.filter(100 * F.col("overlap") >= percent * (F.col("n_a") + F.col("n_b") - F.col("overlap"))).select("a", "b")


def set_components(docs: DataFrame, sets: DataFrame, frequent: np.ndarray, id_col: str, text_col: str, width: int, percent: int,
                   near_rounds: int = NEAR_ROUNDS, cell: int = CELL) -> DataFrame:
    """``key``, ``component`` of the sets that link with another; ``sets`` has ``key``, ``n``, ``bits``, ``own``."""
    met = written(cells(docs, text_col, width, percent, frequent), "cells")
    sizes = met.groupBy("cell").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > SMALL).select("cell")
    large = written(met.join(sizes, "cell"), "large")
    members = written(sets.join(met.select("key").distinct(), "key", "left_semi").withColumn("component", F.col("key")), "members")
    segs = labels = links = tried = None
    for turn in range(near_rounds + 1):
        known = members if labels is None else members.drop("component").join(labels, "key")
        rows = (met if turn == 0 else large).join(known.drop("own"), "key")
        pairs = proposals(rows, percent, turn == near_rounds, cell)
        pairs = written(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
        if segs is None:  # of all sets that are, or may yet be, in a pair
            chosen = pairs.select("a").union(pairs.select("b")).union(large.select("key")).toDF("key").distinct()
            segs = written(segments(docs, id_col, text_col, width, id_filter(members.join(chosen, "key", "left_semi"))), "segments")
        found = written(verified(pairs, segs, members.select("key", "n"), percent), "links")
        tried = pairs if tried is None else tried.union(pairs)
        links = found if links is None else links.union(found)
        edges = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        linked = edges.select(F.col("a").alias("key")).distinct()
        joined = connected_components(linked, edges, [], "key")
        if large.isEmpty():
            break
        labels = members.select("key").join(joined, "key", "left").select("key", F.coalesce("component", "key").alias("component"))
    return joined


def linked_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, percent: int = PERCENT,
                 near_rounds: int = NEAR_ROUNDS, cell: int = CELL) -> DataFrame:
    """Id, ``n_shingles``, ``component_id`` (smallest id of the class) of every row."""
    marked = written(marked_sets(docs, id_col, text_col, width), "sets")
    frequent = frequent_buckets(marked)
    rows = marked.filter("sketch is null")
    sets = written(rows.filter("n > 0").groupBy("key").agg(
        F.first("n").alias("n"), F.first("bits").alias("bits"), F.min("id").alias("own"), (F.min("second") != F.max("second")).alias("clash")
    ), "distinct")
    if not sets.filter("clash").isEmpty():
        raise RuntimeError("two different shingle sets have one digest")
    joined = set_components(docs, sets.select("key", "n", "bits", "own"), frequent, id_col, text_col, width, percent, near_rounds, cell)
    named = sets.select("key", "own").join(joined, "key", "left").withColumn("component", F.coalesce("component", "key"))
    names = named.groupBy("component").agg(F.min("own").alias("component_id"))
    of_set = named.select("key", "component").join(names, "component").select("key", "component_id")
    with_words = rows.filter("n > 0").join(of_set, "key").select("id", "n", "component_id")
    without = rows.filter("n = 0").select("id", "n", F.col("id").alias("component_id"))
    return with_words.union(without).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")
