"""The queries of this package and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import chunk_dedup, divergence, licenses, line_templates, lm_scoring, mixing, near_dup, packing, pii, quality, topk_search, turn_repair, warc
from larkspur.llm.common import table


def tokenizer(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_pareto_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.pareto_mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op4_differencing_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op5_lattice_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_documents(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op6_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


def op8_bottom_k_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op3_dual_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op2_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_templates.line_report(table(spark, sf_dir, "documents"))


def op7_gear_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_dedup.repeats(table(spark, sf_dir, "documents"))


def op9_patience_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op10_weak_supervision_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op11_salvaged_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return turn_repair.repair(turn_repair.damaged(conversations), conversations)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_pareto_mixing": op1_pareto_mixing,
    "op4_differencing_packing": op4_differencing_packing,
    "op5_lattice_likelihood": op5_lattice_likelihood,
    "op6_line_frequency": op6_line_frequency,
    "op8_bottom_k_near_dedup": op8_bottom_k_near_dedup,
    "op3_dual_tree_search": op3_dual_tree_search,
    "op2_line_templates": op2_line_templates,
    "op7_gear_chunks": op7_gear_chunks,
    "op9_patience_licenses": op9_patience_licenses,
    "op10_weak_supervision_pii": op10_weak_supervision_pii,
    "op11_salvaged_warc": op11_salvaged_warc,
    "op12_turn_repair": op12_turn_repair,
    "op13_source_divergence": op13_source_divergence,
}
ORACLE_SQL = {
    "op1_pareto_mixing": mixing.ORACLE,
    "op6_line_frequency": quality.ORACLE,
    "op3_dual_tree_search": topk_search.ORACLE,
    "op11_salvaged_warc": warc.ORACLE,
    "op13_source_divergence": divergence.ORACLE,
}
