"""BPE encoding and decoding with content-defined chunk reuse.

A polynomial rolling hash over 16 bytes cuts every text where the content says
so, hence equal passages of different documents give equal chunks wherever they
stand.  A chunk is encoded once per worker: the ids and decoded tokens of its
inner words are kept under the chunk's bytes.

A cut may fall inside a word, so the words at a chunk's ends are provisional.
Each join is repaired: the open word on the left and the open word on the right
are encoded again as one, and where a chunk holds no white space at all the
join grows over it until both sides end at white space, where no token depends
on the other side.  The result then equals the library's ids of the whole text.
Texts near special-token strings or capital letters before combining marks are
encoded by the library in whole sections.

Null and empty texts have no ids and decode to the empty text.  Rows are
independent of each other, so ties, repeated rows and extra columns have no
influence; an empty table stays empty.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from mensura.llm.common import byte_batches, raw_texts
from mensura.llm.token_counts import ENCODE_BYTES, sections
from mensura.llm.tokenizer import PIECE, load, needs_whole

BATCH_BYTES = 2 << 20
#: log2 of the mean chunk length in bytes
CHUNK_BITS = 8
#: memory bounds per worker; what is forgotten is encoded again
MEMO_PIECES, MEMO_CHUNK_BYTES = 500_000, 24 << 20

_STATE: dict[str, "Codec"] = {}


_BYTE_HASHES = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.uint32)
#: first bytes of characters before which a capital letter makes a section whole (see ``tokenizer``)
_MARKS = re.compile(rb"[\xcc\xcd\xd2\xe1\xe2\xe3\xef\xf0]")


def _whole(section: bytes) -> bool:
    """``needs_whole``, looked for only where one of its bytes occurs."""
    return (b"<|" in section or _MARKS.search(section) is not None) and needs_whole(section)


def chunk_ends(data: bytes, bits: int = CHUNK_BITS) -> np.ndarray:
    """End offsets of content-defined chunks: where the hash of the last 16 bytes has ``bits`` leading zeros."""
    rolled = _BYTE_HASHES[np.frombuffer(data, dtype=np.uint8)]
    factor = 0x6659FD93
    for width in (1, 2, 4, 8):
        rolled[width:] += rolled[:-width] * np.uint32(factor)
        factor = factor * factor & 0xFFFFFFFF
    return np.flatnonzero(rolled < np.uint32(1 << 32 - bits)) + 1


class Codec:
    """Ids and decoded text of many texts, with words and chunks encoded once."""

    def __init__(self, path: str):
        self.tokenizer = load(path)
        self.pieces: dict[bytes, tuple[bytes, bytes]] = {}
        self.chunks: dict[bytes, tuple] = {}
        self.chunk_bytes = 0

    @classmethod
    def of(cls, path: str) -> "Codec":
        if path not in _STATE:
            _STATE[path] = cls(path)
        return _STATE[path]

    def _library(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        ids = [f.ids for f in found]
        decoded = self.tokenizer.decode_batch(ids, skip_special_tokens=False)
        return [(np.asarray(i, dtype="<u4").tobytes(), d.encode()) for i, d in zip(ids, decoded)]

    def _words(self, words: set[bytes]) -> dict[bytes, tuple[bytes, bytes]]:
        """The memo, with all ``words`` in it; a word of ASCII letters is a piece by itself."""
        memo = self.pieces
        if len(memo) > MEMO_PIECES:
            memo.clear()
        split = [(w, PIECE.findall(w)) for w in words.difference(memo) if not w.isalpha()]
        new = {w for w in words.difference(memo) if w.isalpha()}
        new = list(new.union(*[p for _, p in split]).difference(memo))
        sizes = np.concatenate([[0], np.cumsum([len(p) for p in new], dtype=np.int64)])
        for a, b in byte_batches(sizes, ENCODE_BYTES):
            memo.update(zip(new[a:b], self._library([p.decode("utf-8", "replace") for p in new[a:b]])))
        memo.update([(w, _joined([memo[q] for q in p])) for w, p in split if len(p) > 1])
        return memo

    def batch(self, texts: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """(ids as little-endian 32-bit integers, decoded UTF-8) of each text."""
        plans: list[list] = []
        words: set[bytes] = set()
        new: dict[bytes, list[bytes]] = {}
        for text in texts:
            plan: list = []
            for section in sections(text):
                if _whole(section):
                    plan.append(section)
                    continue
                section = section.lower()
                ends = [0, *chunk_ends(section).tolist(), len(section)]
                steps: list = []
                held = b""  # the open word left of the current join
                for a, b in zip(ends, ends[1:]):
                    if a == b:
                        continue
                    chunk = section[a:b]
                    known = self.chunks.get(chunk)
                    if known is None:
                        known = _dissect(chunk)
                        self.chunks[chunk] = known
                        self.chunk_bytes += 4 * len(chunk) + 400
                        new[chunk] = known[1]
                        words.update(known[1])
                    head, _, tail, closed = known
                    if not closed:
                        held += head
                        continue
                    if join := held + head:
                        steps.append((True, join))
                        words.add(join)
                    steps.append((False, chunk))
                    held = tail
                if held:
                    steps.append((True, held))
                    words.add(held)
                plan.append(steps)
            plans.append(plan)
        coded = self._words(words)
        for chunk, inner in new.items():
            head, _, tail, closed = self.chunks[chunk]
            self.chunks[chunk] = (head, _joined([coded[w] for w in inner]), tail, closed)
        for plan in plans:
            parts: list[tuple[bytes, bytes]] = []
            for steps in plan:
                if isinstance(steps, bytes):
                    parts += self._library([steps.decode("utf-8", "replace")])
                else:
                    parts += [coded[x] if join else self.chunks[x][1] for join, x in steps]
            yield _joined(parts)
        if self.chunk_bytes > MEMO_CHUNK_BYTES:
            self.chunks.clear()
            self.chunk_bytes = 0


def _dissect(chunk: bytes) -> tuple[bytes, list[bytes], bytes, bool]:
    """(open word at the start, inner words, open word at the end, holds white space)."""
    words = chunk.split()
    opened, ended = not chunk[:1].isspace(), not chunk[-1:].isspace()
    if opened and ended and len(words) == 1:
        return chunk, [], b"", False
    head = words.pop(0) if opened else b""
    tail = words.pop() if ended else b""
    return head, words, tail, True


def _joined(parts: list[tuple[bytes, bytes]]) -> tuple[bytes, bytes]:
    """Decoding without a decoder puts one space between tokens."""
    return b"".join([p[0] for p in parts]), b" ".join([p[1] for p in parts if p[0]])


def _coded(path: str, kind: str, make: Callable[[list[tuple[bytes, bytes]]], pa.Array]):
    @F.arrow_udf(kind)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = Codec.of(path)
        for column in batches:
            data, offsets = raw_texts(column)
            out = [make([])]
            for a, b in byte_batches(offsets, BATCH_BYTES):
                texts = [data[offsets[i] : offsets[i + 1]] for i in range(a, b)]
                out.append(make(list(codec.batch(texts))))
            yield pa.concat_arrays(out)

    return run


def encode(text: Column, path: str) -> Column:
    """Token ids of every text, ARRAY<INT>; empty for null."""

    def make(coded):
        sizes = np.cumsum([0] + [len(ids) // 4 for ids, _ in coded])
        flat = np.frombuffer(b"".join([ids for ids, _ in coded]), dtype="<u4").astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(sizes, type=pa.int32()), pa.array(flat))

    return _coded(path, "array<int>", make)(text)


def decode(ids: Column, path: str) -> Column:
    """Text of every list of ids as the library decodes it, special tokens kept; null for null."""

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokenizer = load(path)
        for column in batches:
            lists = column.to_pylist()
            texts = tokenizer.decode_batch([x or [] for x in lists], skip_special_tokens=False)
            yield pa.array([None if x is None else t for x, t in zip(lists, texts)], type=pa.string())

    return run(ids)


#: what ``digests`` returns
DIGESTS = "n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def digests(text: Column, path: str) -> Column:
    """Struct of the number of ids, the SHA-256 of the ids and that of their decoded text."""

    def make(coded):
        sha = lambda x: hashlib.sha256(x).hexdigest()
        return pa.StructArray.from_arrays(
            [
                pa.array([len(ids) // 4 for ids, _ in coded], type=pa.int64()),
                pa.array([sha(ids) for ids, _ in coded], type=pa.string()),
                pa.array([sha(decoded) for _, decoded in coded], type=pa.string()),
            ],
            names=["n_tokens", "ids_sha256", "decoded_sha256"],
        )

    return _coded(path, f"struct<{DIGESTS.replace(' ', ':').replace(',:', ',')}>", make)(text)


def encoded_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` of every row."""
    coded = docs.select(F.col(id_col), digests(F.col(text_col), path).alias("_coded"))
    return coded.select(id_col, "_coded.*")
