"""Language-model scores of whole texts: counts, training and scoring as Spark jobs.

1. A pass writes the texts with their position and block and, per block, its
   words with their counts.  A block is a run of neighbouring rows of one task
   that ends before it exceeds ``BLOCK_BYTES``; only a longer text is a block
   by itself above that size.
2. Equal words meet by shuffle and sum up; joined back to the blocks these are
   the blocks' dictionaries.  Their number grows with the corpus and no
   dictionary is ever held for more than a block.
3. Blocks meet their dictionaries once: every text becomes its class codes (two
   bytes a token) and the sums that do not depend on the model.
4. The log-bilinear model (``lbl``) learns from every training token: in each of
   ``ROUNDS`` rounds all tasks start from the same parameters, pass over their
   own codes with noise-contrastive estimation, and their parameters are
   averaged by tokens in two steps.  Every round reads the codes of all
   training texts, at every size.  Only the frequent words, the totals of the
   ending classes and the averaged parameters reach the driver, all of fixed size.
5. The codes are scored with normalised probabilities.

Tokens are words between ASCII white space in lower case (A-Z), then one end.
Null and empty texts are the end alone.  Rows with a null id fold as the empty
id.  Repeated rows count and score like others; only the id and text columns
are read.  Without training rows all counts are 0 and the model is that of its
start.  An empty table stays empty.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from mensura.llm import lbl
from mensura.llm.common import byte_batches, fold, raw_texts, shared_folder, written

BLOCK_BYTES = 32 << 20
BATCH_TOKENS = 1 << 20
#: rounds of training, each over all training texts
ROUNDS = 2
PARTIALS = 32

_TABLES: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}


def _words(text: bytes) -> list[bytes]:
    return text.lower().split()


def _split(docs: DataFrame, id_col: str, text_col: str, folds: int, held_out: int) -> tuple[DataFrame, DataFrame]:
    """Texts (``at``, ``id``, ``trains``, ``text``, ``block``) and words (``block``, ``word``, ``n``), written in one pass.

    ``n`` counts the word in the block's training texts; the end of text is the empty word.
    """
    rows = docs.select(
        F.monotonically_increasing_id().alias("at"), F.col(id_col).alias("id"),
        (fold(F.col(id_col), folds) != held_out).alias("trains"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    names = ["at", "id", "trains", "text", "block", "word", "n", "part"]
    kind = docs.schema[id_col].dataType.simpleString()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, counts, id_type = None, 0, Counter(), None

        def words() -> pa.RecordBatch:
            n = len(counts)
            nulls = [pa.nulls(n, t) for t in (pa.int64(), id_type, pa.bool_(), pa.string())]
            return pa.RecordBatch.from_arrays([
                *nulls, pa.array(np.full(n, block), pa.int64()), pa.array(list(counts), pa.binary()),
                pa.array(list(counts.values()), pa.int64()), pa.array(["words"] * n),
            ], names=names)

        for batch in batches:
            data, offsets = raw_texts(batch.column("text"))
            id_type, blocks = batch.column("id").type, np.empty(batch.num_rows, dtype=np.int64)
            for i, (at, trains) in enumerate(zip(batch.column("at").to_pylist(), batch.column("trains").to_pylist())):
                size = int(offsets[i + 1] - offsets[i])
                if block is None or held + size > BLOCK_BYTES:
                    if block is not None:
                        yield words()
                    block, held, counts = at, 0, Counter({lbl.END: 0})
                held += size
                blocks[i] = block
                found = _words(data[offsets[i] : offsets[i + 1]])
                if trains:
                    counts.update(found)
                    counts[lbl.END] += 1
                else:
                    for word in set(found):
                        counts.setdefault(word, 0)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([
                *(batch.column(c) for c in names[:4]), pa.array(blocks), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64()), pa.array(["texts"] * n),
            ], names=names)
        if block is not None:
            yield words()

    schema = f"at bigint, id {kind}, trains boolean, text string, block bigint, word binary, n bigint, part string"
    path = shared_folder(docs.sparkSession, "split")
    rows.mapInArrow(split, schema).write.parquet(path, compression="zstd")
    read = lambda part, *columns: docs.sparkSession.read.schema(schema).parquet(path).filter(F.col("part") == part).select(*columns)
    return read("texts", *names[:5]), read("words", "block", "word", "n")


def dictionaries(words: DataFrame) -> DataFrame:
    """``block``, ``word``, ``n`` (count there), ``c`` (count over the training part), ``first`` (true once per word), written.

    The aggregate and the join need the same columns and so read one shuffle by word.
    """
    met = words.repartition("word")
    totals = met.groupBy("word").agg(F.sum("n").alias("c"), F.min("block").alias("least"))
    rows = met.join(totals, "word").select("block", "word", "n", "c", (F.col("block") == F.col("least")).alias("first"))
    return written(rows, "dictionaries", compression="zstd")


def _ending(word: Column) -> Column:
    @F.arrow_udf("int")
    def run(column: pa.Array) -> pa.Array:
        return pa.array([lbl.ending(w) for w in column.to_pylist()], pa.int32())

    return run(word)


def vocabulary(words: DataFrame) -> tuple[lbl.Vocabulary, int, int]:
    """Classes with their totals, number of training tokens, number of distinct training tokens."""
    known = words.filter(F.col("first") & (F.col("c") > 0))
    total, types = known.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    end = known.filter(F.length("word") == 0).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    inner = known.filter(F.length("word") > 0)
    top = inner.orderBy(F.desc("c"), "word").limit(lbl.SHORTLIST).select("word", "c").collect()
    made = lbl.Vocabulary([bytes(r["word"]) for r in top], None, None)
    counts, kinds = np.zeros(made.classes), np.zeros(made.classes)
    counts[0], kinds[0] = end, int(end > 0)
    for r in inner.groupBy(_ending(F.col("word")).alias("e")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("k")).collect():
        counts[made.first_ending + r["e"]], kinds[made.first_ending + r["e"]] = r["c"], r["k"]
    for i, r in enumerate(top, 1):
        counts[i], kinds[i] = r["c"], 1
        at = made.first_ending + lbl.ending(bytes(r["word"]))
        counts[at] -= r["c"]
        kinds[at] -= 1
    made.class_counts, made.class_types = counts, kinds
    return made, int(total), int(types)


def _code_lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all rows of a binary column, and where each row's begin and end."""
    if not len(column):
        return np.zeros(0, dtype=np.uint16), np.zeros(1, dtype=np.int64)
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    codes = np.frombuffer(data, dtype=np.uint16, count=int(offsets[-1] - offsets[0]) // 2, offset=int(offsets[0]))
    return codes, (offsets - offsets[0]) // 2


def train(coded: DataFrame, vocab: lbl.Vocabulary, rounds: int = ROUNDS) -> lbl.Parameters:
    noise = lbl.noise_distribution(vocab)
    params = lbl.Parameters.new(noise)
    texts = coded.filter("trains").select("codes", "at")
    for turn in range(rounds):
        start = params

        def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            trainer = None
            for batch in batches:
                if trainer is None and batch.num_rows:
                    trainer = lbl.Trainer(start, noise, batch.column("at")[0].as_py() + turn)
                codes, offsets = _code_lists(batch.column("codes"))
                for a, b in byte_batches(offsets, BATCH_TOKENS):
                    trainer.learn(*lbl.contexts([codes[offsets[i] : offsets[i + 1]] for i in range(a, b)]))
            if trainer:
                yield _partial([(trainer.p.flat.astype(np.float64), float(trainer.tokens))])

        parts = texts.mapInArrow(learn, "flat array<double>, weight double").repartition(PARTIALS)
        sums = parts.mapInArrow(_combine, "flat array<double>, weight double").collect()
        flat = lbl.averaged((np.array(r["flat"]), r["weight"]) for r in sums)
        params = params if flat is None else lbl.Parameters(vocab.classes, flat)
    return params


def _partial(parts: list[tuple[np.ndarray, float]]) -> pa.RecordBatch:
    flat = lbl.averaged(parts)
    values = pa.array([] if flat is None else [flat], pa.list_(pa.float64()))
    return pa.RecordBatch.from_arrays([values, pa.array([sum(w for _, w in parts)] if len(values) else [], pa.float64())], names=["flat", "weight"])


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield _partial([
        (values.values.to_numpy(), weight.as_py()) for batch in batches for values, weight in zip(batch.column("flat"), batch.column("weight"))
    ])


def _tables(params: lbl.Parameters) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    key = hash(params.flat.tobytes())
    if key not in _TABLES:
        _TABLES.clear()
        _TABLES[key] = params.tables()
    return _TABLES[key]


RESULT = "held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def lm_scores(docs: DataFrame, folds: int = 5, held_out: int = 1, id_col: str = "doc_id", text_col: str = "text",
              rounds: int = ROUNDS) -> DataFrame:
    """Id, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score`` of every row."""
    texts, words = _split(docs, id_col, text_col, folds, held_out)
    own = dictionaries(words)
    vocab, total, types = vocabulary(own)
    id_type = docs.schema[id_col].dataType.simpleString()

    def code(rows: pa.Table, known: pa.Table) -> pa.Table:
        rows = rows.sort_by("at")
        listed = known.column("word").to_pylist()
        index = dict(zip(listed, range(len(listed))))
        counts = known.column("c").to_numpy()
        classes = np.fromiter(map(vocab.class_of, listed), dtype=np.uint16, count=len(listed))
        fixed = np.stack([
            np.log10((counts + 0.5) / (total + 0.5 * (types + 1))), vocab.within(classes.astype(np.int64), counts), (counts > 0).astype(np.float64)
        ])
        data, offsets = raw_texts(rows.column("text"))
        lists, sums = [], []
        for i in range(rows.num_rows):
            found = _words(data[offsets[i] : offsets[i + 1]])
            found.append(lbl.END)
            at = np.fromiter(map(index.__getitem__, found), dtype=np.int64, count=len(found))
            lists.append(classes[at].tobytes())
            sums.append(fixed[:, at].sum(axis=1))
        base, inner, held = np.array(sums).T
        return pa.table({
            "at": rows.column("at"), "id": rows.column("id"), "trains": rows.column("trains"), "codes": pa.array(lists, pa.binary()),
            "base": pa.array(base), "inner": pa.array(inner), "n_known": pa.array(held.astype(np.int64)),
        })

    left, right = texts.groupBy("block"), own.select("block", "word", "c").groupBy("block")
    columns = f"at bigint, id {id_type}, trains boolean, codes binary, base double, inner double, n_known bigint"
    coded = written(left.cogroup(right).applyInArrow(code, columns), "codes", compression="zstd")
    params = train(coded, vocab, rounds)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a1, a2, z = _tables(params)
        for batch in batches:
            codes, offsets = _code_lists(batch.column("codes"))
            learned = []
            for a, b in byte_batches(offsets, BATCH_TOKENS):
                h1, h2, w = lbl.contexts([codes[offsets[i] : offsets[i + 1]] for i in range(a, b)])
                logp = a1[h1, w].astype(np.float64) + a2[h2, w] - z[h1, h2]
                learned.append(np.add.reduceat(logp, offsets[a:b] - offsets[a]))
            whole = np.concatenate(learned) if learned else np.zeros(0)
            yield pa.RecordBatch.from_arrays([
                batch.column("id"), pa.array(~np.array(batch.column("trains").to_pylist(), dtype=bool)), pa.array(np.diff(offsets)), batch.column("n_known"),
                pa.array(np.full(batch.num_rows, total, dtype=np.int64)), batch.column("base"),
                pa.array((whole + batch.column("inner").to_numpy()) / np.log(10)),
            ], names=[id_col, *[c.split()[0] for c in RESULT.split(", ")]])

    return coded.select("id", "trains", "codes", "n_known", "base", "inner").mapInArrow(score, f"`{id_col}` {id_type}, {RESULT}")
