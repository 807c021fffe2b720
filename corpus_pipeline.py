"""The corpus pipeline: toxicity, near duplicates, repeated passages, source mix, tokens.

Each stage gets all rows its predecessor kept, as Parquet read again, and all but
the last return the columns of `documents`, with any further column the table has,
whatever its name.  An empty table stays empty through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomwork.llm import jaccard_join, mixing, pieces, substring_dedup, toxicity
from loomwork.llm.common import read, stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the Kneser-Ney models reject go.

    Null, empty and blank texts have the score of no evidence; repeated rows share a
    score; very long texts are scored whole.
    """
    return toxicity.kept(docs, read(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of linked documents the one with the smallest doc_id stays.

    Null, empty and blank texts are linked with nothing and stay; so do rows with a null
    doc_id; of rows equal in doc_id and text one stays, different texts under one
    doc_id both do.
    """
    return jaccard_join.kept(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Runs of 50 words that a document with a smaller doc_id has are cut out.

    No row goes; null texts stay null; a null doc_id comes last; rows with one doc_id
    don't cut each other.
    """
    return substring_dedup.cleaned(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated, or left out, to reach the sources' targets.

    Texts without words count 0 and are drawn as any other; a null source is one of its
    own; rows with one (or a null) doc_id share the draw.
    """
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row, and whether decoding them gives the text again; null for a null text."""
    return pieces.encoded(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeats", cut_repeats),
    ("mix", mix_sources),
    ("tokens", encode),
]

#: Neither the language models, nor the pieces can be put in SQL: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
