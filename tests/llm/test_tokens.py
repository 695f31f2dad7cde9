import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from mensura.llm import bpe_codec, token_counts
from mensura.llm.queries import QUERIES, VOCABULARY

LIBRARY = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
SPECIAL = ["<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "don't", "I'LL", "x's,", "é", "H̱", "가", "≠"]


def texts():
    draw = random.Random(7)
    letters = list("ab'sdtlmrve.,!?-<|>=é̸́ 　\u0085\x0b\x1c\x00 \n\tAİIßΣς12٣中’—_H") + SPECIAL
    found = ["".join(draw.choice(letters) for _ in range(draw.randint(0, 40))) for _ in range(1500)]
    found += ["", " ", "a" * 5000, ("word " * 9000) + "<|endoftext|>" + ("tail. " * 60000), "中" * 3000]
    return found + [None, "same text", "same text"]


def expected(text):
    ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return len(ids), sha(np.array(ids, dtype="<u4").tobytes()), sha(LIBRARY.decode(ids, skip_special_tokens=False).encode())


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(
        [(i, t, "x") for i, t in enumerate(texts())] + [(None, "no id", None)], "doc_id long, text string, n_tokens string"
    )


def test_counts_equal_the_library(docs):
    got = token_counts.token_counts(docs, VOCABULARY, limit=20).collect()
    want = {i: t for i, t in enumerate(texts())} | {None: "no id"}
    assert len(got) == len(want)
    for row in got:
        text = want[row.doc_id]
        assert (row.n_bytes, row.n_tokens) == (len((text or "").encode()), expected(text)[0]), repr(text)[:80]
        assert row.over_limit == (row.n_tokens > 20)


def test_codec_equals_the_library(docs):
    want = {i: t for i, t in enumerate(texts())} | {None: "no id"}
    for row in bpe_codec.encoded_digests(docs, VOCABULARY).collect():
        assert tuple(row)[1:] == expected(want[row.doc_id]), repr(want[row.doc_id])[:80]


def test_ids_decode_to_the_library_text(docs):
    coded = docs.withColumn("ids", bpe_codec.encode(F.col("text"), VOCABULARY))
    want = {i: t for i, t in enumerate(texts())} | {None: "no id"}
    for row in coded.withColumn("back", bpe_codec.decode(F.col("ids"), VOCABULARY)).collect():
        ids = LIBRARY.encode(want[row.doc_id] or "", add_special_tokens=False).ids
        assert row.ids == ids and row.back == LIBRARY.decode(ids, skip_special_tokens=False)


def test_chunks_follow_content():
    draw = np.random.default_rng(3)
    shared = draw.integers(97, 123, 4000, dtype=np.uint8).tobytes()
    a, b = b"x" * 37 + shared, b"other start" * 9 + shared
    cuts = lambda data, skip: {int(e) - skip for e in bpe_codec.chunk_ends(data) if e >= skip + 16}
    assert cuts(a, 37) == cuts(b, 99) and len(cuts(a, 37)) > 3


def test_empty_table(docs):
    none = docs.filter("false")
    assert token_counts.token_counts(none, VOCABULARY).collect() == []
    assert bpe_codec.encoded_digests(none, VOCABULARY).collect() == []


@pytest.mark.parametrize("name", ["op9_token_counts", "op10_bpe_codec"])
def test_queries_on_the_smallest_tables(spark, name):
    folder = "/root/testdata/sf0.001"
    want = {r.doc_id: expected(r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    for row in QUERIES[name](spark, folder).collect():
        assert row.n_tokens == want[row.doc_id][0]
        if name == "op10_bpe_codec":
            assert tuple(row)[1:] == want[row.doc_id]
