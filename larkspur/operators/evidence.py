"""Evidence as edges: what a finding or an action cites, and the rows that a piece of evidence stands on. No ids are gathered in arrays."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.operators.joins import join_checked, join_written


def citations(things: DataFrame, key: str) -> DataFrame:
    """(key, evidence_id, position) of things (key, evidence_ids): an edge for each reference, repeats included."""
    return things.select(key, F.posexplode("evidence_ids").alias("position", "evidence_id")).select(key, "evidence_id", "position")


def evidence_rows(gaps: DataFrame, coverage: DataFrame, topics: DataFrame, completeness: DataFrame, reviews: DataFrame, assessments: DataFrame, questions: DataFrame) -> DataFrame:
    """(evidence_id, family, row_id): the rows that each piece of evidence stands on.

    Types: reviews of the product and type in either list; dimensions: reviews that have it; questions: those of the topic; data:
    every row of the source. Aggregates and sources, written tables of a row per product and key, meet rows by a join whose side is
    measured, so rows are not shuffled where those are small. An edge table is as large as its rows; nothing of it is collected.
    """
    hits = assessments.select(F.col("review_id").alias("row_id"), F.explode(F.array_distinct(F.transform(F.filter("dimensions", lambda x: x["present"]), lambda x: x["dimension"]))).alias("dimension"))
    hits = hits.join(reviews.select("row_id", "product_id").hint("merge"), "row_id")
    kind = F.regexp_replace("kind", "^(self|competitor)_", "")
    sources = completeness.select("evidence_id", "product_id", kind.alias("_kind"))
    rows = reviews.select("product_id", F.concat("sort", F.lit("_reviews")).alias("_kind"), "row_id").unionByName(questions.select("product_id", F.lit("questions").alias("_kind"), "row_id"))
    parts = [
        ("type", reviews.select("product_id", "type_id", "row_id"), gaps.select("evidence_id", "product_id", "type_id"), ["product_id", "type_id"]),
        ("dimension", hits.select("product_id", "dimension", "row_id"), coverage.select("evidence_id", "product_id", "dimension"), ["product_id", "dimension"]),
        ("question", questions.select("product_id", "topic_id", "row_id"), topics.select("evidence_id", "product_id", "topic_id"), ["product_id", "topic_id"]),
        ("data", rows, sources, ["product_id", "_kind"]),
    ]
    return reduce(DataFrame.unionByName, [join_checked(r, cited, on).select("evidence_id", F.lit(family).alias("family"), "row_id") for family, r, cited, on in parts])


def traced(cited: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """(key, evidence_id, family, row_id): the rows behind each thing's evidence, each once. cited: of citations()."""
    return join_written(edges, cited.select(key, "evidence_id").distinct(), "evidence_id").select(key, "evidence_id", "family", "row_id")


def cited_by(edges: DataFrame, cited: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """(row_id, key, evidence_id): the way back, from given rows (row_id) to what stands on them."""
    return traced(cited, join_written(edges, rows.select("row_id").distinct(), "row_id", "left_semi"), key).select("row_id", key, "evidence_id")


def gate_citations(proposed: DataFrame, cited: DataFrame, ready: DataFrame, allowed: DataFrame, data: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(findings, edges, errors) of proposals whose evidence is edges.

    proposed: finding_id, status; cited, allowed and data: edges (finding_id, evidence_id) of the proposal, of what the finding may
    cite and of what it falls back on. A proposal counts if its status is the one found (ready: finding_id, status), it cites
    something, nothing twice, and only what is allowed; then the finding has all allowed edges, else it is unavailable, has those
    of data and an error row (code, finding_id). findings: finding_id, status, accepted.
    """
    may = allowed.select("finding_id", "evidence_id", F.lit(1).alias("_may")).distinct()
    each = cited.groupBy("finding_id", "evidence_id").agg(F.count(F.lit(1)).alias("_times")).join(may.hint("merge"), ["finding_id", "evidence_id"], "left")
    sums = each.groupBy("finding_id").agg(F.max("_times").alias("_most"), F.count_if(F.col("_may").isNull()).alias("_foreign"))
    # One row per finding: small by its nature, yet measured.
    x = join_written(ready.select("finding_id", "status"), proposed.select("finding_id", F.col("status").alias("_status")), "finding_id", "left")
    x = join_written(x, sums, "finding_id", "left")
    ok = F.coalesce((F.col("_status") == F.col("status")) & (F.col("_most") == 1) & (F.col("_foreign") == 0), F.lit(False))
    x = x.withColumn("accepted", ok)
    findings = x.select("finding_id", F.when(F.col("accepted"), F.col("status")).otherwise("unavailable").alias("status"), "accepted")
    kept = join_written(allowed.select("finding_id", "evidence_id"), findings.where("accepted").select("finding_id"), "finding_id", "left_semi")
    fallen = join_written(data.select("finding_id", "evidence_id"), findings.where("NOT accepted").select("finding_id"), "finding_id", "left_semi")
    return findings, kept.unionByName(fallen), findings.where("NOT accepted").select(F.lit("SYNTHESIS_EVIDENCE_REJECTED").alias("code"), "finding_id")
