"""From raw documents to packed training sequences, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from assayflow.llm.common import stored
from assayflow.llm.line_dedup import without_repeated_lines
from assayflow.llm.mixing import mixed
from assayflow.llm.near_dedup import without_near_duplicates
from assayflow.llm.packing import pack
from assayflow.llm.quality import good_documents


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or lie far from all language references go.

    Null and empty texts go; rows equal in all columns stay or go together; null ids and sources, very long texts and extra
    columns stay as they are; an empty table gives an empty one.
    """
    return good_documents(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of equal or similar lines the first occurrence by id and line stays; documents keep their other lines.

    No row goes: a document whose lines all go has an empty text. Null texts stay null, null ids come last; rows equal in id and text are
    one document; extra columns stay, whatever their names; an empty table gives an empty one.
    """
    return without_repeated_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays, that of the smallest id (null ids last; of equal rows one).

    Texts without words, null ones too, are one class; texts are compared whole; extra columns stay; an empty table gives an empty one.
    """
    return without_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are cut or repeated to their targets; a repeated document is that many rows.

    Null sources are one source, null ids hash as the empty string; texts without words count 0 words; rows equal in id, source and
    number of words are taken equally often; extra columns stay; an empty table gives an empty one.
    """
    return mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows and their places in sequences.

    Null and empty texts are one token; only texts over a sequence long are cut; repeated rows are packed each; an empty table gives an empty one.
    """
    return pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]
#: No SQL: near duplicates, fuzzy lines and packing can't be expressed.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result but the last is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
