"""Aggregates of labelled reviews and questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.text import in_order
from larkspur.operators.joins import join_checked, join_written, small
from larkspur.plans.spill import written
from larkspur.schemas import READY_ROWS, SHARE_GAP, LOW_COVERAGE, TOPIC_SHARE, TOP_ROWS


def share(part: Column, whole: Column) -> Column:
    """part / whole as a double, 0 for nothing."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def distinct_products(rows: DataFrame, collation: str | None = None) -> DataFrame:
    return rows.select("product_id").distinct().orderBy(*in_order("product_id", collation))


def type_share_gap(reviews: DataFrame, types: DataFrame) -> DataFrame:
    """Per product and type: count and share in the default and the recent list and their difference.

    Shares are of all rows of the list, labelled or not. Types (a catalog, so a few rows) without rows are there with 0. One shuffle, on product and
    type; the totals are sums over its result.
    """
    counts = reviews.groupBy("product_id", "type_id").agg(
        F.count_if(F.col("sort") == "default").alias("default_count"), F.count_if(F.col("sort") == "recent").alias("recent_count")
    )
    totals = counts.groupBy("product_id").agg(F.sum("default_count").alias("default_total"), F.sum("recent_count").alias("recent_total"))
    dense = totals.crossJoin(small(types.select("type_id")))
    out = dense.join(counts, ["product_id", "type_id"], "left").fillna(0, ["default_count", "recent_count"])
    out = out.withColumn("default_share", share(F.col("default_count"), F.col("default_total"))).withColumn("recent_share", share(F.col("recent_count"), F.col("recent_total")))
    return out.select(
        "product_id", "type_id", "default_count", "default_share", "recent_count", "recent_share", (F.col("recent_share") - F.col("default_share")).alias("difference"),
        F.concat_ws("-", F.lit("AGG-TYPE"), "product_id", "type_id").alias("evidence_id"),
    )


def top_gap_type(gaps: DataFrame, own: DataFrame, collation: str | None = None) -> DataFrame:
    """Own row of the largest absolute difference; ties by type, then product."""
    return gaps.join(own.select("product_id").hint("merge"), "product_id", "left_semi").orderBy(F.desc(F.abs("difference")), *in_order("type_id", collation), *in_order("product_id", collation)).limit(1)


def representatives(questions: DataFrame, most: int = 3, collation: str | None = None) -> DataFrame:
    """(product_id, topic_id, row_id, n): the first rows of each topic of a product, by rank and id."""
    order = Window.partitionBy("product_id", "topic_id").orderBy("rank", *in_order("row_id", collation))
    return questions.select("product_id", "topic_id", "rank", "row_id").withColumn("n", F.row_number().over(order)).where(F.col("n") <= most).drop("rank")


def eligible_topic_evidence(topics: DataFrame, questions: DataFrame, need: int = READY_ROWS) -> DataFrame:
    """Topic rows of products with enough questions, whatever their role."""
    enough = questions.groupBy("product_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= need).select("product_id")
    return join_written(topics, enough, "product_id", "left_semi")


def topic_stats(questions: DataFrame, topics: DataFrame, most: int = 3, collation: str | None = None) -> DataFrame:
    """Per product and topic: count, share of all questions, and the first row ids by rank and id."""
    top = (
        representatives(questions, most, collation)
        .groupBy("product_id", "topic_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "row_id"))), lambda x: x["row_id"]).alias("representative_ids"))
    )
    counts = questions.groupBy("product_id", "topic_id").agg(F.count(F.lit(1)).alias("count"))
    totals = counts.groupBy("product_id").agg(F.sum("count").alias("total"))
    dense = totals.crossJoin(small(topics.select("topic_id"))).join(counts, ["product_id", "topic_id"], "left").join(top, ["product_id", "topic_id"], "left")
    n = F.coalesce("count", F.lit(0))
    return dense.select(
        "product_id", "topic_id", n.alias("count"), share(n, F.col("total")).alias("share"),
        F.coalesce("representative_ids", F.array().cast("array<string>")).alias("representative_ids"),
        F.concat_ws("-", F.lit("AGG-QUESTION"), "product_id", "topic_id").alias("evidence_id"),
    )


def dimension_coverage(assessments: DataFrame, reviews: DataFrame, dimensions: DataFrame, need: int = TOP_ROWS) -> DataFrame:
    """Per product with enough default reviews and dimension: assessments that have it, all assessments, coverage."""
    enough = reviews.where("sort = 'default'").groupBy("product_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= need).select("product_id")
    enough = written(enough)
    rows = join_checked(assessments.select("review_id", "dimensions").join(reviews.select(F.col("row_id").alias("review_id"), "product_id").hint("merge"), "review_id"), enough, "product_id", "left_semi")
    total = rows.groupBy("product_id").agg(F.count_distinct("review_id").alias("total_count"))
    hits = (
        rows.select("product_id", "review_id", F.explode(F.array_distinct(F.transform(F.filter("dimensions", lambda d: d["present"]), lambda d: d["dimension"]))).alias("dimension"))
        .groupBy("product_id", "dimension").agg(F.count_distinct("review_id").alias("hit_count"))
    )
    dense = enough.crossJoin(small(dimensions.select("dimension"))).join(total.hint("merge"), "product_id", "left").join(hits.hint("merge"), ["product_id", "dimension"], "left")
    hit, all_ = F.coalesce("hit_count", F.lit(0)), F.coalesce("total_count", F.lit(0))
    return dense.select(
        "product_id", "dimension", hit.alias("hit_count"), all_.alias("total_count"), share(hit, all_).alias("coverage"),
        F.concat_ws("-", F.lit("AGG-SIX"), "product_id", "dimension").alias("evidence_id"),
    )


def lowest_coverage(coverage: DataFrame, own: DataFrame, collation: str | None = None) -> DataFrame:
    return coverage.join(own.select("product_id").hint("merge"), "product_id", "left_semi").orderBy("coverage", *in_order("dimension", collation)).limit(1)


def eligible_products(products: DataFrame, questions: DataFrame, need: int = READY_ROWS) -> DataFrame:
    """Every product with its questions and whether it is compared: own ones always, others with enough questions."""
    n = questions.groupBy("product_id").agg(F.count(F.lit(1)).alias("questions"))
    q = F.coalesce("questions", F.lit(0))
    return products.select("product_id", "role").join(n, "product_id", "left").select("product_id", "role", q.alias("questions"), ((F.col("role") == "self") | (q >= need)).alias("eligible"))


def top_own_topic(topics: DataFrame, own: DataFrame, collation: str | None = None) -> DataFrame:
    """Own row of the largest share; ties by topic."""
    return topics.join(own.select("product_id").hint("merge"), "product_id", "left_semi").orderBy(F.desc("share"), *in_order("topic_id", collation)).limit(1)


def top_topic_per_product(topics: DataFrame, eligible: DataFrame, collation: str | None = None) -> DataFrame:
    order = Window.partitionBy("product_id").orderBy(F.desc("share"), *in_order("topic_id", collation))
    return topics.join(eligible.select("product_id").hint("merge"), "product_id", "left_semi").withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


def readiness(reviews: DataFrame, questions: DataFrame, products: DataFrame, need: int = READY_ROWS) -> DataFrame:
    """(finding_id, status, default_rows, recent_rows, question_rows, competitors): what the own products' rows allow."""
    own = products.where("role = 'self'").select("product_id")
    r = join_written(reviews, own, "product_id", "left_semi").agg(F.count_if(F.col("sort") == "default").alias("default_rows"), F.count_if(F.col("sort") == "recent").alias("recent_rows"))
    e = eligible_products(products, questions, need)
    q = e.agg(
        F.coalesce(F.sum(F.when(F.col("role") == "self", F.col("questions"))), F.lit(0)).alias("question_rows"),
        F.count_if((F.col("role") == "competitor") & F.col("eligible")).alias("competitors"),
    )
    one = r.crossJoin(F.broadcast(q))
    ready = F.array(
        F.struct(F.lit("F01").alias("finding_id"), ((F.col("default_rows") >= need) & (F.col("recent_rows") >= need)).alias("ok")),
        F.struct(F.lit("F02").alias("finding_id"), (F.col("default_rows") >= need).alias("ok")),
        F.struct(F.lit("F03").alias("finding_id"), (F.col("question_rows") >= need).alias("ok")),
    )
    return one.select(F.explode(ready).alias("f"), "default_rows", "recent_rows", "question_rows", "competitors").select(
        "f.finding_id", F.when(F.col("f.ok"), "available").otherwise("unavailable").alias("status"), "default_rows", "recent_rows", "question_rows", "competitors"
    )


def problem_flags(ready: DataFrame, gaps: DataFrame, coverage: DataFrame, topics: DataFrame, products: DataFrame) -> DataFrame:
    """(finding_id, status, measure, has_problem): each finding's measure over own products against its threshold."""
    own = products.where("role = 'self'").select("product_id").hint("merge")
    m = (
        gaps.join(own, "product_id", "left_semi").agg(F.max(F.abs("difference")).alias("F01"))
        .crossJoin(F.broadcast(coverage.join(own, "product_id", "left_semi").agg(F.min("coverage").alias("F02"))))
        .crossJoin(F.broadcast(topics.join(own, "product_id", "left_semi").agg(F.max("share").alias("F03"))))
        .selectExpr("stack(3, 'F01', F01, 'F02', F02, 'F03', F03) AS (finding_id, measure)")
    )
    hit = (
        F.when(F.col("finding_id") == "F01", F.col("measure") >= SHARE_GAP)
        .when(F.col("finding_id") == "F02", F.col("measure") < LOW_COVERAGE)
        .otherwise(F.col("measure") >= TOPIC_SHARE)
    )
    return ready.select("finding_id", "status").join(F.broadcast(m), "finding_id", "left").select(
        "finding_id", "status", "measure", F.coalesce((F.col("status") == "available") & hit, F.lit(False)).alias("has_problem")
    )
