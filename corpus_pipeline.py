"""Corpus pipeline: documents -> quality rules -> line dedup -> near dedup -> mix of sources -> token windows.

A stage's result is written before the next stage begins; then the work tables of the stage before are deleted. Every stage keeps the columns
that documents have, whatever others there are and whatever their names, but for the last, and gives an empty table for an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import line_templates, mixing, near_dup, packing, quality
from larkspur.llm.common import drop, scratch, stage_of
from larkspur.llm.queries import tokenizer


def _measured(docs: DataFrame) -> DataFrame:
    """n_chars as the text now has them."""
    return docs.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, without the lines that too many documents of their host have.

    A null or empty text has no words and fails; a null source is a host of its own; repeated rows are judged alike.
    """
    with stage_of(docs, first=True):
        return _measured(quality.clean_documents(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines whose template recurs across documents.

    A null text stays null, an empty one empty; no row goes; repeated rows count as one document and lose the same lines.
    """
    with stage_of(docs):
        return _measured(line_templates.deduplicated(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of the smallest id.

    Documents without words (null and empty texts too) are linked with nothing and stay; of repeated rows one stays.
    """
    with stage_of(docs):
        return near_dup.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them.

    A null text has size 0 and may be taken; a null source is a source of its own, the last; repeated rows are taken together.
    """
    with stage_of(docs):
        return mixing.mixed_documents(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in token windows.

    A null text is an empty one, which is the closing id alone; repeated rows are packed each.
    """
    with stage_of(docs, last=True):
        return packing.packed_documents(docs, tokenizer("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("source mix", mix_sources),
    ("packing", pack_windows),
]
#: Line templates, sketches and token windows are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        made = scratch(stage(spark, docs, sf_dir))
        if i:
            drop(docs)
        docs = made
    return STAGES[-1][1](spark, docs, sf_dir)
