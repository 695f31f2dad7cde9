"""Cleaning and encoding of a document corpus, one operator per stage.

Quality and language rejects go, one document of each near-duplicate class
stays (the smallest id), contaminated documents go, and what is left is
encoded.  Every stage works on all rows its predecessor kept and passes their
columns on unchanged; stages decide per row or per class, never by position in
the table.  Null ids and repeated rows pass like others, except that a class of
near duplicates keeps one row; an empty table passes through empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from mensura.llm import bpe_codec, decontaminate, language, quality, simhash
from mensura.llm.common import fresh, table, written
from mensura.llm.queries import VOCABULARY

#: as in the quality query
QUALITY_THRESHOLD = 0.3

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _filtered(docs: DataFrame, found: Column, keep: Callable[[Column], Column]) -> DataFrame:
    name = fresh(docs, "found")
    return docs.withColumn(name, found).filter(keep(F.col(name))).drop(name)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return _filtered(docs, quality.score(F.col("text"), model), lambda score: score >= QUALITY_THRESHOLD)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter, or null, have no language; documents that mix languages stay.

    If no row teaches a language there is no model, and the texts with a letter stay.
    """
    net = language.fit(docs)
    if not net.languages:
        return _filtered(docs, language.has_letter(F.col("text")), lambda lettered: lettered)
    return _filtered(docs, language.identify(F.col("text"), net), lambda found: found["lang_pred"] != "und")


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    name = fresh(docs, "found")
    found = decontaminate.with_hits(docs, decontaminate.phrase_blocks(table(spark, sf_dir, "benchmark")), name)
    return found.filter(~decontaminate.is_contaminated(F.col(name))).drop(name)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with the number of their ids and the digests of ids and decoded text; columns of these names give way."""
    name = fresh(docs, "coded")
    made = {c.split()[0] for c in bpe_codec.DIGESTS.split(", ")}
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in made]
    return docs.withColumn(name, bpe_codec.digests(F.col("text"), VOCABULARY)).select(*kept, f"{name}.*")


STAGES: list[tuple[str, Stage]] = [
    ("quality", good_quality),
    ("language", known_language),
    ("near_duplicates", without_near_duplicates),
    ("decontamination", uncontaminated),
    ("encoding", encoded),
]

#: trained models decide in two stages: no SQL gives these rows
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
