"""One report over the benchmark tables: each of its tables is written once, and the others build on it."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.operators import aggregates as A
from larkspur.operators import findings as FN
from larkspur.operators import validate_rows as V
from larkspur.operators.evidence import evidence_rows
from larkspur.operators.joins import join_checked
from larkspur.plans import bindings as B
from larkspur.plans.spill import written
from larkspur.schemas import DIMENSIONS, KINDS, READY_ROWS, TOPICS, catalog


class Report:
    """Products, reviews and questions of one report: the order segments, the questions' products named after three of them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @cached_property
    def products(self) -> DataFrame:
        return written(B.products_orders(self.spark, self.sf_dir))

    @cached_property
    def own(self) -> DataFrame:
        return self.products.where("role = 'self'").select("product_id")

    @cached_property
    def types(self) -> DataFrame:
        return written(B.priorities(self.spark, self.sf_dir))

    @cached_property
    def reviews(self) -> DataFrame:
        return written(B.reviews_orders(self.spark, self.sf_dir))

    @cached_property
    def assessments(self) -> DataFrame:
        return written(B.assessments_orders(self.spark, self.sf_dir, self.reviews))

    @cached_property
    def questions(self) -> DataFrame:
        names = F.create_map(F.lit("p0"), F.lit("BUILDING"), F.lit("p1"), F.lit("FURNITURE"), F.lit("p2"), F.lit("MACHINERY"))
        q = B.answered(self.spark, self.sf_dir).withColumn("product_id", F.element_at(names, F.col("product_id")))
        return written(q.withColumn("source_id", F.concat("product_id", F.lit(":questions"))))

    @cached_property
    def gaps(self) -> DataFrame:
        return written(A.type_share_gap(self.reviews, self.types))

    @cached_property
    def coverage(self) -> DataFrame:
        return written(A.dimension_coverage(self.assessments, self.reviews, catalog(self.spark, DIMENSIONS, "dimension")))

    @cached_property
    def topics(self) -> DataFrame:
        return written(A.topic_stats(self.questions, catalog(self.spark, TOPICS, "topic_id")))

    @cached_property
    def eligible(self) -> DataFrame:
        return written(A.eligible_products(self.products, self.questions))

    @cached_property
    def ready(self) -> DataFrame:
        return written(A.readiness(self.reviews, self.questions, self.products))

    @cached_property
    def flags(self) -> DataFrame:
        return written(A.problem_flags(self.ready, self.gaps, self.coverage, self.topics, self.products))

    @cached_property
    def sources(self) -> DataFrame:
        counts = self.reviews.groupBy("product_id", F.concat("sort", F.lit("_reviews")).alias("kind")).agg(F.count(F.lit(1)).alias("used_rows"))
        return written(V.densify_sources(self.products, self.spark.createDataFrame([(k,) for k in KINDS], "kind string"), counts))

    @cached_property
    def completeness(self) -> DataFrame:
        full = self.sources.withColumn("valid_rows", F.col("used_rows")).withColumn("excluded_over_limit", F.lit(0).cast("long"))
        return written(V.completeness(self.products, full))

    @cached_property
    def evidence(self) -> DataFrame:
        """(evidence_id, family, product_id) of all aggregates and sources."""
        kind = lambda df, f: df.select("evidence_id", F.lit(f).alias("family"), "product_id")
        return written(kind(self.gaps, "type").union(kind(self.coverage, "dimension")).union(kind(self.topics, "question")).union(kind(self.completeness, "data")))

    @cached_property
    def allowed_edges(self) -> DataFrame:
        """(finding_id, evidence_id): what a finding may cite."""
        mine = lambda df, keep, f: join_checked(df, keep, "product_id", "left_semi").select(F.lit(f).alias("finding_id"), "evidence_id")
        f03 = A.eligible_topic_evidence(self.topics, self.questions).select(F.lit("F03").alias("finding_id"), "evidence_id")
        return written(mine(self.gaps, self.own, "F01").union(mine(self.coverage, self.own, "F02")).union(f03))

    @cached_property
    def data_edges(self) -> DataFrame:
        return written(FN.data_citations(self.completeness, READY_ROWS))

    @cached_property
    def edges(self) -> DataFrame:
        """(evidence_id, family, row_id) of every piece of evidence."""
        return written(evidence_rows(self.gaps, self.coverage, self.topics, self.completeness, self.reviews, self.assessments, self.questions))

    @cached_property
    def allowed(self) -> DataFrame:
        """(finding_id, evidence_ids): what a finding may cite, as arrays."""
        return written(self.allowed_edges.groupBy("finding_id").agg(F.array_sort(F.collect_list("evidence_id")).alias("evidence_ids")))

    @cached_property
    def findings(self) -> DataFrame:
        return written(join_checked(self.flags, self.allowed, "finding_id").select("finding_id", "status", "has_problem", "measure", "evidence_ids"))

    @cached_property
    def actions(self) -> DataFrame:
        return written(FN.build_actions(self.findings, self.eligible))
