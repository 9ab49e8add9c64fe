"""From raw documents to an encoded training mixture, in five stages.

Each stage takes (spark, docs, sf_dir), works on every row that the one before kept, and is written as
Parquet in the shared folder before the next one reads it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rankweave.llm import langid, line_dedup, mixing, segment, simhash
from rankweave.llm.common import materialise, prepare, table

# Encoding, language models and schedules have no SQL form; tests use brute force.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told (learned from the labels of these documents); the rest go.

    Where no language was learned (no label on a text with a letter), only null texts and texts without a letter go.
    """
    prepare(spark)
    parser = langid.train(docs)
    if not parser.languages:
        return docs.filter(docs["text"].rlike("\\p{L}"))
    found = langid.identify(docs, parser)
    return found.filter(found["lang_pred"] != langid.UNDETERMINED).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the later occurrences of repeated three-line windows."""
    prepare(spark)
    return line_dedup.dedup_lines(docs).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group of near duplicates."""
    prepare(spark)
    return simhash.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture at its target weights: sources that end early are read again, no document is lost."""
    prepare(spark)
    return mixing.mixture(docs)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row of the mixture, with the scores of the N best segmentations."""
    prepare(spark)
    return segment.segment(docs.select("doc_id", "source", "text")).drop("text")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("mix_sources", mix_sources),
    ("encode", encode_texts),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; every stage but the last is written and reread."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
