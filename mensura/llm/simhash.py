"""SimHash near-duplicates with a Gray-order hierarchical index.

Fingerprints are 64 majority bits over the XXH64 values of four-word shingles.
Two fingerprints link at ``radius`` or fewer differing bits; classes are the
connected components of all links, found exactly:

1. Equal fingerprints collapse before anything is compared.
2. The uppermost index level masks the 64 bits in ``radius + keep`` blocks:
   differences spoil at most ``radius`` blocks, so linked fingerprints agree in
   some ``keep`` of them and meet under that masked pattern.  A pattern shared
   by more than ``cell`` fingerprints is dealt to cells of two parts each, so
   that every two of its fingerprints still meet in one cell and no task gets
   a pattern whole.
3. Inside a cell fingerprints are sorted by Gray rank, which puts shared bits
   side by side.  Runs of ``FANOUT`` form nodes, runs of nodes form upper
   nodes; each holds the bits all below it share that no node above has
   factored out.  A search walks down with accumulated differences and drops a
   whole node as soon as they exceed the radius, or when all below it is known
   to be in the query's class already.
4. A cell returns a spanning forest of its links, never all pairs, and the
   forests are joined to components with lineage cut in the shared folder.

Null and empty texts have fingerprint 0 and link like any other.  Repeated rows
share fingerprint and class.  Null ids are in a class but never name it; a
class without any id is named null.  Only the id and text columns are read.  An
empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from mensura.llm.common import fresh, raw_texts, written
from mensura.operators.graph import connected_components

SHINGLE, SEED = 4, 42
RADIUS, KEEP, CELL = 4, 2, 4096
FANOUT = 8
CHUNK_ROWS = 200_000
QUERY_ROWS = 512


def text_fingerprint(text: bytes) -> int:
    """Unsigned fingerprint of one text."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = (np.cumsum([len(w) + 1 for w in words]) - 1).tolist()
    starts = [0, *[e + 1 for e in ends[:-1]]]
    width = min(SHINGLE, len(words))
    n = len(words) - width + 1
    digest = xxhash.xxh64_digest
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, n, 1 << 16):
        m = min(n, i + (1 << 16))
        hashes = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts[i:m], ends[i + width - 1 : m + width - 1])])
        counts += np.unpackbits(np.frombuffer(hashes, dtype=np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprint(text: Column) -> Column:
    """The 64 bits of every whole text as BIGINT."""

    @F.arrow_udf("bigint")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            data, offsets = raw_texts(column)
            found = [text_fingerprint(data[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.array(np.array(found, dtype=np.uint64).astype(np.int64))

    return run(text)


def hex_digits(bits: Column) -> Column:
    return F.lower(F.lpad(F.hex(bits), 16, "0"))


def masks(radius: int = RADIUS, keep: int = KEEP) -> list[int]:
    """Every choice of ``keep`` of ``radius + keep`` bit blocks, as signed 64-bit masks."""
    edges = np.linspace(0, 64, radius + keep + 1).round().astype(int)
    blocks = [((1 << int(b - a)) - 1) << int(a) for a, b in zip(edges[:-1], edges[1:])]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    return [signed(sum(chosen)) for chosen in combinations(blocks, keep)]


def gray_rank(bits: np.ndarray) -> np.ndarray:
    """Position of a code word in the Gray sequence: running parity from the top bit."""
    rank = bits.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Hierarchy over fingerprints sorted by (cell, Gray rank)."""

    def __init__(self, cell: np.ndarray, bits: np.ndarray):
        order = np.lexsort((gray_rank(bits), cell))
        self.order, self.bits = order, bits[order]
        self.cell = cell[order]
        first = np.concatenate([[True], self.cell[1:] != self.cell[:-1]])
        at = np.arange(len(bits)) - np.maximum.accumulate(np.where(first, np.arange(len(bits)), 0))
        low, high, own = self.bits, self.bits, self.cell
        #: per level from below: first child of each node, shared bits, first row of each node
        self.starts: list[np.ndarray] = []
        shared: list[tuple[np.ndarray, np.ndarray]] = []
        rows = [np.arange(len(bits))]
        while True:
            group = at // FANOUT
            begin = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (group[1:] != group[:-1])]))
            low, high = np.bitwise_and.reduceat(low, begin), np.bitwise_or.reduceat(high, begin)
            own, at = own[begin], group[begin]
            self.starts.append(begin)
            shared.append((~(low ^ high), low))
            rows.append(rows[-1][begin])
            if at.max(initial=0) == 0:
                break
        self.rows = rows  # first row below each node; level 0 are the rows
        self.root = np.searchsorted(own, self.cell)
        # bits factored out above are left out below
        parent_mask = np.zeros(len(own), dtype=np.uint64)
        self.masks: list[np.ndarray] = [None] * (len(shared) + 1)
        self.patterns: list[np.ndarray] = [None] * (len(shared) + 1)
        for level in range(len(shared), 0, -1):
            mask, pattern = shared[level - 1]
            self.masks[level], self.patterns[level] = mask & ~parent_mask, pattern
            sizes = np.diff(np.append(self.starts[level - 1], len(shared[level - 2][0]) if level > 1 else len(bits)))
            parent_mask = np.repeat(mask, sizes)
        self.masks[0], self.patterns[0] = ~parent_mask, self.bits
        self.n = len(bits)

    def forest(self, radius: int) -> list[tuple[int, int]]:
        """Row pairs (positions in the given order) that span every class of linked rows."""
        label = np.arange(self.n)
        links: list[np.ndarray] = []
        for i in range(0, self.n, QUERY_ROWS):
            found = self._search(np.arange(i, min(self.n, i + QUERY_ROWS)), radius, label)
            if len(found[0]):
                links.append(self._unite(label, *found))
        pairs = np.concatenate(links) if links else np.zeros((0, 2), dtype=np.int64)
        return self.order[pairs]

    def _search(self, query: np.ndarray, radius: int, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        node, gap = self.root[query], np.zeros(len(query), dtype=np.int64)
        for level in range(len(self.starts), -1, -1):
            ends = np.append(self.rows[level][1:], self.n)
            low = np.minimum.reduceat(label, self.rows[level])
            high = np.maximum.reduceat(label, self.rows[level])
            gap = gap + np.bitwise_count((self.bits[query] ^ self.patterns[level][node]) & self.masks[level][node])
            settled = (low[node] == high[node]) & (low[node] == label[query])
            open_ = (gap <= radius) & (ends[node] > query + 1) & ~settled
            query, node, gap = query[open_], node[open_], gap[open_]
            if level == 0:
                return query, node
            begin = self.starts[level - 1]
            last = np.append(begin[1:], len(self.rows[level - 1]))
            sizes = last[node] - begin[node]
            skip = np.repeat(begin[node] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
            query, gap, node = np.repeat(query, sizes), np.repeat(gap, sizes), skip + np.arange(sizes.sum())

    @staticmethod
    def _unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Merge the classes of linked rows in ``label``; returns one link per merge."""
        kept = []
        while len(a):
            la, lb = label[a], label[b]
            apart = la != lb
            a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
            if not len(a):
                break
            # every class hangs itself below its smallest linked class: no cycles, at least halving
            high, low = np.maximum(la, lb), np.minimum(la, lb)
            order = np.lexsort((low, high))
            pick = order[np.concatenate([[True], high[order][1:] != high[order][:-1]])]
            kept.append(np.column_stack([a[pick], b[pick]]))
            target = np.arange(len(label))
            target[high[pick]] = low[pick]
            while (target[target] != target).any():
                target = target[target]
            label[:] = target[label]
        return np.concatenate(kept) if kept else np.zeros((0, 2), dtype=np.int64)


def links(distinct: DataFrame, bits: str, radius: int = RADIUS, keep: int = KEEP, cell: int = CELL) -> DataFrame:
    """Spanning links ``a``, ``b`` of the classes that meet in each cell; ``distinct`` has one row per fingerprint."""
    tables = [F.struct(F.lit(t).alias("t"), F.col(bits).bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(masks(radius, keep))]
    keyed = distinct.select(F.col(bits).alias("bits"), F.explode(F.array(*tables)).alias("c")).select("bits", "c.*")
    full = (
        keyed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > cell)
        .withColumn("parts", F.ceil(F.col("n") / cell).cast("int"))
    )
    part = F.pmod(F.xxhash64("bits", "t"), F.col("parts")).cast("int")
    dealt = keyed.join(full.select("t", "key", "parts"), ["t", "key"], "left")
    cells = F.when(F.col("parts").isNull(), F.array(F.struct(F.lit(0).alias("a"), F.lit(0).alias("b")))).otherwise(
        F.transform(
            F.sequence(F.lit(0), F.col("parts") - 1),
            lambda j: F.struct(F.least(part, j).alias("a"), F.greatest(part, j).alias("b")),
        )
    )
    placed = dealt.select("t", "key", F.explode(cells).alias("c"), "bits").select("t", "key", "c.a", "c.b", "bits")
    met = placed.repartition("t", "key", "a", "b").sortWithinPartitions("t", "key", "a", "b")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        rows = 0
        for batch in batches:
            held.append(np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]))
            rows += len(held[-1])
            if rows >= CHUNK_ROWS:
                whole = np.concatenate(held)
                start = int(np.flatnonzero((whole[:, :4] != whole[-1, :4]).any(axis=1)).max(initial=-1)) + 1
                if start:
                    yield _forest(whole[:start], radius)
                held = [whole[start:]]
                rows = len(held[0])
        if held:
            yield _forest(np.concatenate(held), radius)

    return met.mapInArrow(search, "a bigint, b bigint")


def _forest(rows: np.ndarray, radius: int) -> pa.RecordBatch:
    """Links of complete cells; cells of one row have none."""
    change = np.concatenate([[True], (rows[1:, :4] != rows[:-1, :4]).any(axis=1)]) if len(rows) else np.zeros(0, bool)
    cell = np.cumsum(change)
    many = np.bincount(cell, minlength=1)[cell] > 1 if len(rows) else change
    bits, cell = rows[many, 4], cell[many]
    pairs = GrayIndex(cell, bits.view(np.uint64)).forest(radius) if len(bits) else np.zeros((0, 2), dtype=np.int64)
    ends = bits[pairs] if len(pairs) else np.zeros((0, 2), dtype=np.int64)
    return pa.RecordBatch.from_arrays([pa.array(ends[:, 0].copy()), pa.array(ends[:, 1].copy())], names=["a", "b"])


def classes(marked: DataFrame, id_col: str, bits: str, radius: int = RADIUS, keep: int = KEEP, cell: int = CELL) -> DataFrame:
    """One row per fingerprint: ``bits``, ``class`` (its name), ``component_id`` (smallest id of the class).

    ``marked`` has ids and fingerprints and is read several times: write it first.
    """
    distinct = written(marked.groupBy(F.col(bits).alias("bits")).agg(F.min(id_col).alias("own")), "fingerprints")
    found = written(links(distinct, "bits", radius, keep, cell).distinct(), "links")
    edges = found.union(found.select("b", "a"))
    linked = edges.select(F.col("a").alias("bits")).distinct()
    joined = connected_components(linked, edges, [], "bits")
    named = distinct.join(joined, "bits", "left").withColumn("class", F.coalesce("component", "bits"))
    names = named.groupBy("class").agg(F.min("own").alias("component_id"))
    return named.select("bits", "class").join(names, "class").select("bits", "class", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """Id, ``fingerprint`` (16 hex digits), ``component_id`` of every row."""
    marked = written(docs.select(F.col(id_col).alias("id"), fingerprint(F.col(text_col)).alias("bits")), "marked")
    found = marked.join(classes(marked, "id", "bits", radius), "bits")
    return found.select(F.col("id").alias(id_col), hex_digits(F.col("bits")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """All columns of one row per class: that of the smallest id (null ids last), the first as written among equals."""
    bits, at = fresh(docs, "bits"), fresh(docs, "at")
    marked = written(
        docs.withColumn(bits, fingerprint(F.col(text_col))).withColumn(at, F.monotonically_increasing_id()), "marked", compression="zstd"
    )
    narrow = marked.select(F.col(id_col).alias("id"), F.col(bits).alias("bits"), F.col(at).alias("at"))
    named = narrow.join(classes(narrow, "id", "bits", radius).select("bits", "class"), "bits")
    first = named.groupBy("class").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "at")).alias("first"))
    kept = first.select(F.col("first.at").alias(at))
    return marked.join(kept, at, "left_semi").select(*docs.columns)
