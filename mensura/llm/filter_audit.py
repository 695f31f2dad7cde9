"""Interaction of row filters: every order of five filters from 32 counted states.

1. One Arrow pass gives each text a mask of the filters A to D that it fails;
   equal texts meet by digest, pre-aggregated, for filter E (copy of a smaller id).
2. Rows collapse to (part, mask) cells with their counts.  All that follows
   works on at most 32 cells a part, however many rows or orders there are.
3. The 32 filter subsets are walked in Gray order.  One step toggles one filter:
   the active-failure counters of the masks holding it change by one, and the
   cells whose counter leaves or reaches 0 leave or join the running survivors.
4. The states are stored; what a filter removes at a step of an order is the
   difference of two of them, and so are unique failures and Shapley sums.

Null texts count as empty, null sources as the part of the empty text.  A row
with a null id is no copy, makes no other row a copy and has no label; rows that
share an id and a text are no copies of each other.  Several label rows of an id
count as one that is good or toxic if any of them is.  Without rows there are
no parts and no result rows.  Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from mensura.llm.common import byte_batches, raw_texts, written
from mensura.llm.token_counts import sections

FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_CAPITAL_PERCENT = 200, 50, 2
SYMBOLS = b"#$%&*|"
BATCH_BYTES = 4 << 20
#: parts whose orders form one output batch
PARTS = 64
COUNTS = ("n", "good", "toxic")


def _word_failures(text: bytes) -> int:
    total, distinct = 0, set()
    for section in sections(text):
        words = section.split()
        total += len(words)
        distinct.update(words)
    return (total < MIN_WORDS) | (100 * len(distinct) < MIN_DISTINCT_PERCENT * total) << 1


def text_failures(text: Column) -> Column:
    """Bits of the filters A to D (bit 0 is A) that each whole text fails."""
    marks = np.zeros(256, dtype=bool)
    marks[list(SYMBOLS)] = True

    @F.arrow_udf("int")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            data, offsets = raw_texts(column)
            out = np.zeros(len(column), dtype=np.int32)
            for a, b in byte_batches(offsets, BATCH_BYTES):
                part = data[offsets[a] : offsets[b]]
                at = offsets[a : b + 1] - offsets[a]
                codes = np.frombuffer(part, dtype=np.uint8)
                held = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[at])
                capitals, points = held((codes >= 65) & (codes <= 90)), held((codes & 0xC0) != 0x80)
                words = [_word_failures(part[i:j]) for i, j in zip(at[:-1], at[1:])]
                out[a:b] = words
                out[a:b] |= (100 * capitals > MAX_CAPITAL_PERCENT * points).astype(np.int32) << 2
                out[a:b] |= (held(marks[codes]) > 0).astype(np.int32) << 3
            yield pa.array(out)

    return run(text)


def failure_masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """``id``, ``part``, ``mask`` of every row; bit i of the mask is the i-th filter."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = written(docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        text_failures(F.col(text_col)).alias("own"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"),
    ), "masks")
    copied = rows.groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first < last").select("digest", "first")
    copy = F.coalesce(F.col("id") > F.col("first"), F.lit(False)).cast("int")
    return rows.join(copied, "digest", "left").select("id", "part", (F.col("own") + copy * 16).alias("mask"))


def mask_cells(masks: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``part``, ``mask``, ``n``, ``good``, ``toxic``."""
    yes = lambda name: F.max(F.coalesce((F.col(name) == 1).cast("bigint"), F.lit(0)))
    known = labels.groupBy(F.col(id_col).alias("id")).agg(yes("quality").alias("good"), yes("toxic").alias("toxic"))
    return masks.join(known, "id", "left").groupBy("part", "mask").agg(
        F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTS[1:]]
    )


def gray_states(cells: np.ndarray, filters: int = len(FILTERS)) -> np.ndarray:
    """Survivor counts of every filter subset: (parts, masks, counts) to (parts, subsets, counts)."""
    masks = np.arange(1 << filters)
    failing = np.zeros(1 << filters, dtype=np.int64)
    alive = cells.sum(axis=1)
    states = np.empty_like(cells)
    states[:, 0] = alive
    active = 0
    for step in range(1, 1 << filters):
        bit = step & -step
        hit = masks & bit > 0
        active ^= bit
        if active & bit:
            alive = alive - cells[:, hit & (failing == 0)].sum(axis=1)
            failing[hit] += 1
        else:
            failing[hit] -= 1
            alive = alive + cells[:, hit & (failing == 0)].sum(axis=1)
        states[:, active] = alive
    return states


def order_rows(states: np.ndarray) -> dict[str, np.ndarray]:
    """Columns of all (part, order, step) rows, parts slowest, as differences of ``states``."""
    k = len(FILTERS)
    full = (1 << k) - 1
    orders = np.array(list(permutations(range(k))))
    own = (1 << orders).astype(np.int64)
    after = np.cumsum(own, axis=1)
    before = after - own
    lost = states[:, before] - states[:, after]  # parts, orders, steps, counts
    bits = 1 << np.arange(k)
    total = states[:, [0], 0] - states[:, bits, 0]
    unique = states[:, full ^ bits, 0] - states[:, [full], 0]
    shapley = np.zeros_like(total)
    for subset in range(full):
        for f in range(k):
            if not subset >> f & 1:
                size = subset.bit_count()
                shapley[:, f] += factorial(size) * factorial(k - 1 - size) * (states[:, subset, 0] - states[:, subset | 1 << f, 0])
    parts = len(states)
    flat = lambda x: np.broadcast_to(x, (parts, *orders.shape)).reshape(-1)
    return {
        "filter_order": np.repeat(np.tile(["".join(FILTERS[i] for i in o) for o in orders], parts), k),
        "step": np.tile(np.arange(1, k + 1, dtype=np.int32), parts * len(orders)),
        "kept": flat(states[:, after, 0]), "removed": flat(lost[..., 0]), "redundant": flat(total[:, orders] - lost[..., 0]),
        "unique_fails": flat(unique[:, orders]), "good_lost": flat(lost[..., 1]), "toxic_lost": flat(lost[..., 2]),
        "shapley": flat(shapley[:, orders]),
    }


RESULT = ("part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, "
          "good_lost bigint, toxic_lost bigint, shapley bigint")


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """One row per part, filter order and step; columns as in ``RESULT``."""
    cells = mask_cells(failure_masks(docs, id_col, text_col, part_col), labels, id_col)
    wide = cells.groupBy("part").agg(F.collect_list(F.struct("mask", *COUNTS)).alias("cells"))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, PARTS):
                some = batch.slice(i, PARTS)
                names, lists = some.column("part"), some.column("cells").to_pylist()
                counts = np.zeros((len(lists), 1 << len(FILTERS), len(COUNTS)), dtype=np.int64)
                for row, held in enumerate(lists):
                    for cell in held:
                        counts[row, cell["mask"]] = [cell[c] for c in COUNTS]
                rows = order_rows(gray_states(counts))
                each = len(rows["step"]) // len(lists)
                part = names.take(pa.array(np.repeat(np.arange(len(lists)), each)))
                yield pa.RecordBatch.from_arrays([part, *map(pa.array, rows.values())], names=["part", *rows])

    return wide.mapInArrow(walk, RESULT)
