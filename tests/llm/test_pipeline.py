from pyspark.sql import functions as F

import corpus_pipeline
from mensura.llm.queries import QUERIES
from test_decontaminate import by_hand as hits_by_hand
from test_simhash import by_hand as bits_by_hand, roots
from test_tokens import expected

SF = "/root/testdata/sf0.001"


def test_every_stage_against_its_operator_or_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    ids = lambda df: [r.doc_id for r in df.select("doc_id").collect()]

    good = corpus_pipeline.written(stages["quality"](spark, docs, SF), "t")
    assert good.columns == docs.columns
    assert sorted(ids(good)) == sorted(r.doc_id for r in QUERIES["op1_quality"](spark, SF).collect() if r.predicted)
    named = corpus_pipeline.written(stages["language"](spark, good, SF), "t")
    assert sorted(ids(named)) == sorted(i for i in ids(good) if any(c.isalpha() for c in texts[i]))
    single = corpus_pipeline.written(stages["near_duplicates"](spark, named, SF), "t")
    order = sorted(ids(named))
    assert sorted(ids(single)) == sorted({order[k] for k in roots([bits_by_hand(texts[i]) for i in order])})
    clean = corpus_pipeline.written(stages["decontamination"](spark, single, SF), "t")
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    found = {i: hits_by_hand(texts[i], items, 13) for i in ids(single)}
    assert sorted(ids(clean)) == sorted(i for i, (n, hit, _) in found.items() if not (hit and 20 * hit >= n))
    assert clean.columns == docs.columns and 0 < clean.count() < len(texts)
    coded = stages["encoding"](spark, clean, SF)
    assert coded.columns == [*docs.columns, "n_tokens", "ids_sha256", "decoded_sha256"]
    assert {r.doc_id: tuple(r)[-3:] for r in coded.collect()} == {i: expected(texts[i]) for i in ids(clean)}
    assert {r.doc_id: r.text for r in coded.collect()} == {i: texts[i] for i in ids(clean)}
    clash = stages["encoding"](spark, clean.withColumn("N_tokens", F.lit("x")), SF)
    assert clash.columns == coded.columns


def test_run_equals_its_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, SF), name)
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, docs.collect()))


def test_edges(spark):
    docs = spark.createDataFrame(
        [(5, None), (3, ""), (4, "a b c d e"), (4, "a b c d e"), (None, "a b c d e"), (None, "other words are here now"), (9, "12 %")],
        "doc_id long, text string",
    ).withColumn("lang", F.lit("en")).withColumn("found", F.lit("clash")).withColumn("Bits", F.lit(1)).withColumn("at", F.lit(2))
    kept = corpus_pipeline.without_near_duplicates(spark, docs, SF)
    assert kept.columns == docs.columns
    rows = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert rows == sorted([(3, ""), (4, "a b c d e"), (None, "other words are here now"), (9, "12 %")], key=str)
    assert all(r.found == "clash" and r.Bits == 1 and r.at == 2 for r in kept.collect())
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.filter("false"), SF).collect() == []
        assert stage(spark, docs, SF).count() <= 7


def test_very_long_texts_pass_whole(spark):
    draw = __import__("random").Random(2)
    words = ["".join(draw.choices("abcdefghij", k=6)) for _ in range(4000)]
    long = " ".join(draw.choice(words) for _ in range(120_000))
    docs = spark.createDataFrame([(1, long), (2, long), (3, long[:-7] + " other"), (4, "short text here")], "doc_id long, text string").withColumn("lang", F.lit("en"))
    assert sorted(r.doc_id for r in corpus_pipeline.without_near_duplicates(spark, docs, SF).collect()) == [1, 4]
    assert sorted(r.doc_id for r in corpus_pipeline.uncontaminated(spark, docs, SF).collect()) == [1, 2, 3, 4]
    rows = {r.doc_id: r for r in corpus_pipeline.encoded(spark, docs, SF).collect()}
    assert rows[1].text == long and tuple(rows[1])[-3:] == expected(long) == tuple(rows[2])[-3:]


def test_unlabelled_corpus_keeps_texts_with_a_letter(spark):
    texts = ["a b c", "12 %", None, "", "\u4e2d\u6587", "d e f", "\u2014 7"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("lang", F.lit(None).cast("string"))
    kept = corpus_pipeline.known_language(spark, docs, SF)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [0, 4, 5]
    # the only labelled row is held out of the training
    held = docs.withColumn("lang", F.when(F.expr("doc_id = 5"), "en"))
    assert sorted(r.doc_id for r in corpus_pipeline.known_language(spark, held, SF).collect()) == [0, 4, 5]
