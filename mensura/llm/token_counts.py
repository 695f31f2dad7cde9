"""Token counts: batch encoding in Arrow functions that return lengths only.

Texts are cut at ASCII white space into sections, so a text of any length uses
bounded memory, and the sections of an Arrow batch are worked off in batches of
about equal bytes.  Inside a batch every distinct word is counted once, from
the lengths of its pieces (see ``tokenizer``); pieces that this worker has not
met go to the library in batches balanced by bytes.  Only integers are kept.

Null and empty texts have 0 bytes and 0 tokens.  Rows are independent, so ties,
repeated rows and extra columns have no influence; an empty table stays empty.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from mensura.llm.common import byte_batches, raw_texts
from mensura.llm.tokenizer import PIECE, load, needs_whole

BATCH_BYTES = 4 << 20
SECTION_BYTES = 256 << 10
ENCODE_BYTES = 64 << 10
#: entries kept per worker; a memory bound, a forgotten piece is encoded again
MEMO_PIECES = 600_000

_SPACE = re.compile(rb"[\x09-\x0d\x20]")
_LENGTHS: dict[str, dict[bytes, int]] = {}


def sections(text: bytes, limit: int = SECTION_BYTES) -> Iterator[bytes]:
    """Cut after at least ``limit`` bytes at the next white space; tokens never cross it."""
    start = 0
    while len(text) - start > limit:
        space = _SPACE.search(text, start + limit)
        if space is None:
            break
        yield text[start : space.start()]
        start = space.end()
    yield text[start:]


def piece_lengths(tokenizer, pieces: list[bytes]) -> Iterator[tuple[bytes, int]]:
    """Library lengths of ``pieces``, in batches balanced by bytes."""
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in pieces], dtype=np.int64)])
    for a, b in byte_batches(offsets, ENCODE_BYTES):
        texts = [p.decode("utf-8", "replace") for p in pieces[a:b]]
        for piece, found in zip(pieces[a:b], tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
            yield piece, len(found)


class Counter:
    """Counts the tokens of texts; remembers pieces between batches."""

    def __init__(self, path: str):
        self.tokenizer = load(path)
        self.pieces = _LENGTHS.setdefault(path, {})

    def batch(self, texts: list[bytes]) -> list[int]:
        totals = [0] * len(texts)
        parts: list[tuple[int, list[bytes]]] = []
        for i, text in enumerate(texts):
            for section in sections(text):
                if needs_whole(section):
                    whole = section.decode("utf-8", "replace")
                    totals[i] += len(self.tokenizer.encode(whole, add_special_tokens=False).ids)
                else:
                    parts.append((i, section.lower().split()))
        words: set[bytes] = set()
        words.update(*[w for _, w in parts])
        lengths = self._words(words)
        for i, found in parts:
            totals[i] += sum(map(lengths.__getitem__, found))
        return totals

    def _words(self, words: set[bytes]) -> dict[bytes, int]:
        if len(self.pieces) > MEMO_PIECES:
            self.pieces.clear()
        split = [(w, PIECE.findall(w)) for w in words]
        new = {p for _, pieces in split for p in pieces}.difference(self.pieces)
        self.pieces.update(piece_lengths(self.tokenizer, list(new)))
        get = self.pieces.__getitem__
        return {w: get(p[0]) if len(p) == 1 else sum(map(get, p)) for w, p in split}


def n_tokens(text: Column, path: str) -> Column:
    """Number of tokens of every text, as BIGINT."""

    @F.arrow_udf("bigint")
    def counts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = Counter(path)
        for column in batches:
            data, offsets = raw_texts(column)
            out: list[int] = []
            for a, b in byte_batches(offsets, BATCH_BYTES):
                out += counter.batch([data[offsets[i] : offsets[i + 1]] for i in range(a, b)])
            yield pa.array(out, type=pa.int64())

    return counts(text)


def token_counts(docs: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns id, ``n_bytes``, ``n_tokens``, ``over_limit`` (more than ``limit`` tokens)."""
    counted = docs.select(
        F.col(id_col), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("bigint").alias("n_bytes"),
        n_tokens(F.col(text_col), path).alias("n_tokens"),
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
