"""The corpus pipeline: each stage reads what its predecessor wrote."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexloom.llm import language, near_dups, packing, secrets, substrings
from vertexloom.llm.common import cut, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Share of the best language's probability below which a text counts as being in none.
SURE = 0.5


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in one of the learnt languages; the others (no letter, or none that is sure) go."""
    seen = language.predict(docs, language.train(docs), tuple(COLUMNS[1:]))
    return seen.where((F.col("lang_pred") != "und") & (F.col("score") >= SURE)).select(COLUMNS)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least doc_id of each group of near duplicates."""
    return near_dups.keep_one(docs).select(COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that a document with a smaller doc_id has too."""
    return _counted(substrings.remove(docs.select(COLUMNS)))


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in the place of each secret."""
    return _counted(secrets.redact(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify),
    ("near_dedup", deduplicate),
    ("substring_dedup", cut_repeats),
    ("secret_scan", hide_secrets),
    ("packing", pack),
]
#: Models, hashes and packing aren't expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written in the shared folder and read again, and goes when its successor is written."""
    docs, written = table(spark, sf_dir, "documents"), []
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs, *written)
            written = [docs]
    return docs
