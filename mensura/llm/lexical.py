"""Ranked lexical search of many queries at once, by common-subexpression evaluation.

1. A pass over the documents gives the number of documents and terms and, for
   the terms of the query items, their document frequencies.
2. Items are written as sums over terms and their shared parts are mined: terms
   that occur in the same items form one atom; then the pair of summands that
   most items share becomes a node of its own, again and again, until no two
   items share a pair.  The nodes form a query-sharing DAG.
3. A second pass scores batches of documents.  Per batch, the accumulator of
   every atom (one integer per document) is materialised once, every node is
   one addition of two accumulators, and every item adds the few nodes that
   are left.  A task keeps the best ``top`` documents of each item.
4. The tasks' bests are ranked in two salted steps.

All sums are 64-bit integers, so no order of addition changes a score.  Items
are worked off in blocks of ``BLOCK_BYTES`` of text, each with its own passes; a
block's terms and DAG are what the tasks receive, so their size has a bound.  A
block's results are written before the next one begins.

Null texts have no terms; an item or document without terms is in no result.
Repeated items, ids and documents are ranked as rows of their own; among equal
scores a null id comes last.  Only the id and text columns are read.  Empty
tables give no rows.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from mensura.llm.common import byte_batches, raw_texts, shared_folder, written
from mensura.llm.token_counts import sections

TOP = 50
BLOCK_BYTES = 1 << 20
#: atoms of an item, the most shared first, among which pairs are mined; the others are added one by one
MINED = 64
BATCH_BYTES, BATCH_DOCS = 1 << 20, 512
#: accumulators of a batch: documents x nodes
BATCH_CELLS = 4 << 20
SALTS = 32

#: term bytes stay (A-Z lowered), every other ASCII character separates
TERM_BYTES = bytes(
    c if c >= 0x80 or chr(c).isalnum() and not 65 <= c <= 90 else c + 32 if 65 <= c <= 90 else 0x20 for c in range(256)
)


def terms(text: bytes) -> list[bytes]:
    return text.translate(TERM_BYTES).split()


@dataclass
class Plan:
    """Items of a block as sums over a DAG of shared term sets."""

    #: term codes, ordered by atom
    codes: dict[bytes, int]
    #: first term code of every atom
    atoms: np.ndarray
    #: per node the two nodes that it adds; node ids go on after the atoms
    pairs: list[tuple[int, int]] = field(default_factory=list)
    #: per item the nodes that it adds
    items: list[list[int]] = field(default_factory=list)

    @property
    def nodes(self) -> int:
        return len(self.atoms) + len(self.pairs)


def share(items: list[set[bytes]]) -> Plan:
    """Mine the term sets that ``items`` share and arrange them as a DAG."""
    where: dict[bytes, list[int]] = defaultdict(list)
    for i, held in enumerate(items):
        for term in held:
            where[term].append(i)
    atoms: dict[tuple[int, ...], list[bytes]] = defaultdict(list)
    for term in sorted(where):
        atoms[tuple(where[term])].append(term)
    codes: dict[bytes, int] = {}
    starts, sums = [], [set() for _ in items]
    for node, (members, held) in enumerate(sorted(atoms.items())):
        starts.append(len(codes))
        codes.update(zip(held, range(len(codes), len(codes) + len(held))))
        for i in members:
            sums[i].add(node)
    plan = Plan(codes, np.array(starts, dtype=np.int64))
    users: dict[tuple[int, int], set[int]] = defaultdict(set)
    many = Counter(node for held in sums for node in held)
    mined = [set(sorted((n for n in held if many[n] > 1), key=lambda n: (-many[n], n))[:MINED]) for held in sums]
    for i, held in enumerate(mined):
        for pair in combinations(sorted(held), 2):
            users[pair].add(i)
    by_use: dict[int, set[tuple[int, int]]] = defaultdict(set)
    for pair, at in users.items():
        by_use[len(at)].add(pair)
    use = max(by_use, default=0)
    while use > 1:
        if not by_use[use]:
            use -= 1
            continue
        pair = min(by_use[use])
        node = len(plan.atoms) + len(plan.pairs)
        plan.pairs.append(pair)
        for i in sorted(users[pair]):
            rest = mined[i].difference(pair)
            for gone in pair:
                for other in mined[i]:
                    old = (min(gone, other), max(gone, other))
                    if gone != other and i in users.get(old, ()):
                        by_use[len(users[old])].discard(old)
                        users[old].discard(i)
                        by_use[len(users[old])].add(old)
            for other in rest:
                new = (other, node)
                by_use[len(users[new])].discard(new)
                users[new].add(i)
                by_use[len(users[new])].add(new)
            mined[i] = rest | {node}
            sums[i] = sums[i].difference(pair) | {node}
    plan.items = [sorted(held) for held in sums]
    return plan


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _coded(texts: list[bytes], codes: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Occurrences of coded terms per text, and all terms per text; texts are cut into sections, so none is split whole."""
    none = len(codes)
    tf = np.zeros((len(texts), none + 1), dtype=np.int64)
    for i, text in enumerate(texts):
        for section in sections(text):
            words = terms(section)
            tf[i] += np.bincount(np.fromiter(map(codes.get, words, repeat(none)), dtype=np.int64, count=len(words)), minlength=none + 1)
    return tf[:, :none], tf.sum(axis=1)


def _rows(width: int) -> int:
    """Documents of a batch, by the accumulators that each needs."""
    return max(1, min(BATCH_DOCS, BATCH_CELLS // max(1, width)))


def _batches(column: pa.Array, rows: int) -> Iterator[tuple[int, int, list[bytes]]]:
    data, offsets = raw_texts(column)
    for a, b in byte_batches(offsets, BATCH_BYTES):
        for i in range(a, b, rows):
            j = min(b, i + rows)
            yield i, j, [data[offsets[k] : offsets[k + 1]] for k in range(i, j)]


def statistics(docs: DataFrame, codes: dict[bytes, int], text_col: str = "text") -> tuple[int, int, np.ndarray]:
    """Documents with terms, terms of all documents, document frequency of each code."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, df = 0, 0, np.zeros(len(codes), dtype=np.int64)
        for batch in batches:
            for _, _, texts in _batches(batch.column(0), _rows(len(codes))):
                tf, lengths = _coded(texts, codes)
                n += int((lengths > 0).sum())
                total += int(lengths.sum())
                df += (tf > 0).sum(axis=0)
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([[-2, -1], held])), pa.array(np.concatenate([[n, total], df[held]]))], names=["code", "n"]
        )

    sums = docs.select(text_col).mapInArrow(count, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n")).collect()
    found = {r["code"]: r["n"] for r in sums}
    return found.get(-2, 0), found.get(-1, 0), np.array([found.get(i, 0) for i in range(len(codes))], dtype=np.int64)


def scores(plan: Plan, weights: np.ndarray, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """(items, documents) of integer scores, evaluated along the DAG."""
    parts = np.zeros((len(plan.codes), len(m)), dtype=np.int64)
    doc, code = np.nonzero(tf)
    held = tf[doc, code]
    parts[code, doc] = weights[code] * (1_000_000_000 * held // (1000 * held + 20 * m[doc]))
    nodes = np.empty((plan.nodes, len(m)), dtype=np.int64)
    nodes[: len(plan.atoms)] = np.add.reduceat(parts, plan.atoms, axis=0)
    for node, (a, b) in enumerate(plan.pairs, len(plan.atoms)):
        np.add(nodes[a], nodes[b], out=nodes[node])
    return np.stack([nodes[held].sum(axis=0) for held in plan.items])


class Best:
    """The best ``top`` (score, id, position) of every item seen so far."""

    def __init__(self, items: int, top: int):
        self.top = top
        self.held: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in range(items)]
        self.worst = np.zeros(items, dtype=np.int64)

    def add(self, found: np.ndarray, ids: np.ndarray) -> None:
        """``ids`` are ranked smallest first among equal scores."""
        for i in np.flatnonzero((found >= np.maximum(self.worst, 1)[:, None]).any(axis=1)):
            pick = np.flatnonzero(found[i] >= max(self.worst[i], 1))
            score = np.concatenate([self.held[i][0], found[i][pick]])
            own = np.concatenate([self.held[i][1], ids[pick]])
            order = np.lexsort((own, -score))[: self.top]
            self.held[i] = score[order], own[order]
            if len(order) == self.top:
                self.worst[i] = score[order[-1]]


#: stands for a null id inside tasks: after all others
NO_ID = np.iinfo(np.int64).max


def _search_block(docs: DataFrame, block: list[tuple[int, bytes]], top: int, id_col: str, text_col: str) -> DataFrame:
    held = [set(terms(text)) for _, text in block]
    plan = share(held)
    n_docs, total, df = statistics(docs, plan.codes, text_col)
    weights = np.array([weight(n_docs, int(x)) for x in df], dtype=np.int64)
    rows = _rows(plan.nodes + len(plan.codes))
    row_of = np.array([row for row, _ in block], dtype=np.int64)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(block), top)
        for batch in batches:
            ids = batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False)
            for a, b, texts in _batches(batch.column(1), rows):
                tf, lengths = _coded(texts, plan.codes)
                m = 50 + 50 * lengths * n_docs // max(total, 1)
                best.add(scores(plan, weights, tf, m), ids[a:b])
        sizes = [len(s) for s, _ in best.held]
        own = np.concatenate([d for _, d in best.held])
        yield pa.RecordBatch.from_arrays([
            pa.array(np.repeat(row_of, sizes)), pa.array(own, mask=own == NO_ID),
            pa.array(np.concatenate([s for s, _ in best.held])),
        ], names=["row", "doc", "score"])

    found = docs.select(F.col(id_col).cast("bigint"), text_col).mapInArrow(score, "row bigint, doc bigint, score bigint")
    return found.withColumn("salt", F.pmod(F.xxhash64("doc", "score"), F.lit(SALTS)))


def search(docs: DataFrame, items: DataFrame, top: int = TOP, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``item``, ``rank``, document id, ``score``: the ``top`` documents of every item with a score above 0."""
    spark = docs.sparkSession
    listed = written(items.select(
        F.col(item_col).alias("item"), F.coalesce(F.col(item_text_col), F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row"),
    ), "items")
    folder, schema = shared_folder(spark, "bests"), "row bigint, doc bigint, score bigint, rank int"
    paths: list[str] = []
    for block in _blocks(listed):
        part = _search_block(docs, [(r["row"], r["text"].encode()) for r in block], top, id_col, text_col)
        best = _ranked(_ranked(part, ["row", "salt"], top), ["row"], top)
        paths.append(f"{folder}/block={len(paths)}")
        best.select("row", "doc", "score", "rank").write.parquet(paths[-1])
    found = spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
    return found.join(listed.select("row", "item"), "row").select(F.col("item").alias(item_col), "rank", F.col("doc").alias(id_col), "score")


def _ranked(rows: DataFrame, keys: list[str], top: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("doc"))
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def _blocks(listed: DataFrame) -> Iterator[list]:
    """Items in blocks of about ``BLOCK_BYTES``, fetched a Spark partition at a time."""
    block, held = [], 0
    for row in listed.toLocalIterator():
        if block and held + len(row["text"]) > BLOCK_BYTES:
            yield block
            block, held = [], 0
        block.append(row)
        held += len(row["text"])
    if block:
        yield block
