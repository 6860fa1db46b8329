"""A training corpus from ``documents``: quality, near-duplicates, repeated passages, benchmark passages, mix.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before kept; all but the last return the columns
they were given, extra ones included, whatever their names. An empty table gives none. Very long texts are worked on whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltlake.llm import decontaminate, mixing, neardup, quality, suffix_dedup
from voltlake.llm.common import lake, written

SIMILARITY = 80  # percent of five-word shingles
REPEAT_BYTES = 256  # searched as bytes; passages of REPEAT_WORDS in fewer bytes are searched as words
REPEAT_WORDS = 51  # over 50 words


def _measured(docs: DataFrame) -> DataFrame:
    """Documents whose texts were cut, with their new length."""
    return docs.withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), "n_chars")) if "n_chars" in docs.columns else docs


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the quality classifier keeps. Null and empty texts have no n-gram against them and stay; equal rows fare alike."""
    return quality.accepted(docs, lake(spark, sf_dir).labels)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates, that of the smallest id. Texts without words are linked with nothing and stay, rows that repeat id and text are one; a row with a null id
    stays only if no row with an id is like it."""
    lake(spark, sf_dir)
    return neardup.representatives(docs, percent=SIMILARITY)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows without strings of REPEAT_BYTES bytes and passages of REPEAT_WORDS words that occur again, in any row. Rows of which nothing is left go; null and empty texts stay."""
    lake(spark, sf_dir)
    return _measured(suffix_dedup.without_repeats(docs, length=REPEAT_BYTES, words=REPEAT_WORDS))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows without words inside benchmark windows; rows that mostly consist of them go. Null texts have no words and stay null."""
    return _measured(decontaminate.clean(docs, lake(spark, sf_dir).benchmark))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of documents with copy, n_copies and shuffle_key, which replace columns of these names. A null source is one that is not named; equal rows are drawn alike."""
    lake(spark, sf_dir)
    return mixing.mix(docs)


STAGES = [
    ("quality", good_quality),
    ("near_dedup", near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mix", source_mix),
]

ORACLE_SQL = None  # the stages have no SQL form; tests hold run() against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = lake(spark, sf_dir).documents
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
