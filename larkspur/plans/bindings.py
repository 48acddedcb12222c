"""The benchmark tables as tables of the domain, in Spark and as common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.operators.numbering import numbered

TOP, CAP = 20, 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Orders as reviews: the segment is the product, even orders are its default list from the dearest on, odd ones its recent list
# from the latest on, the priority is the type.


def reviews_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("product_id"))
    o = table(spark, sf_dir, "orders").join(customers.hint("merge"), F.col("o_custkey") == F.col("c_custkey"))
    even = F.col("o_orderkey") % 2 == 0
    by = F.when(even, -F.col("o_totalprice").cast("double")).otherwise(-F.unix_micros(F.col("o_orderdate").cast("timestamp")).cast("double"))
    o = o.select("product_id", F.when(even, "default").otherwise("recent").alias("sort"), by.alias("_by"), "o_orderkey", F.col("o_orderpriority").alias("type_id"))
    return numbered(o, ["product_id", "sort"], ["_by", "o_orderkey"], "rank").select(
        F.concat_ws(":", "sort", "o_orderkey").alias("row_id"), F.concat("product_id", F.lit(":"), "sort", F.lit("_reviews")).alias("source_id"),
        "product_id", "sort", F.col("rank").cast("int").alias("rank"), "type_id", "o_orderkey",
    )


REVIEWS_ORDERS = """ro_all AS (
  SELECT c_mktsegment AS product_id, o_orderkey, o_orderpriority AS type_id, CASE WHEN o_orderkey % 2 = 0 THEN 'default' ELSE 'recent' END AS sort, o_totalprice, o_orderdate
  FROM orders JOIN customer ON o_custkey = c_custkey
), reviews AS (
  SELECT sort || ':' || o_orderkey AS row_id, product_id || ':' || sort || '_reviews' AS source_id, product_id, sort, type_id, o_orderkey,
    CAST(row_number() OVER (PARTITION BY product_id, sort ORDER BY CASE WHEN sort = 'default' THEN o_totalprice END DESC, CASE WHEN sort = 'recent' THEN o_orderdate END DESC, o_orderkey) AS INTEGER) AS rank FROM ro_all
)"""


def products_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    segment = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("product_id")).distinct()
    return segment.select("product_id", F.when(F.col("product_id") == "BUILDING", "self").otherwise("competitor").alias("role"), F.initcap("product_id").alias("name"))


PRODUCTS_ORDERS = """products AS (
  SELECT DISTINCT c_mktsegment AS product_id, CASE WHEN c_mktsegment = 'BUILDING' THEN 'self' ELSE 'competitor' END AS role FROM customer
)"""


def priorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("type_id")).distinct()


PRIORITIES = "types AS (SELECT DISTINCT o_orderpriority AS type_id FROM orders)"

# Line items as assessments of the first 20 default reviews.

FLAGS = {"persona": "l_returnflag = 'R'", "scene": "l_returnflag = 'A'", "painPoint": "l_returnflag = 'N'", "detail": "l_discount >= 0.08", "effect": "l_tax >= 0.07", "delight": "l_quantity >= 45"}


def assessments_orders(spark: SparkSession, sf_dir: str, reviews: DataFrame | None = None) -> DataFrame:
    reviews = reviews_orders(spark, sf_dir) if reviews is None else reviews
    top = reviews.where((F.col("sort") == "default") & (F.col("rank") <= TOP))
    lines = table(spark, sf_dir, "lineitem").join(top.select(F.col("o_orderkey").alias("l_orderkey")).hint("merge"), "l_orderkey", "left_semi")
    has = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(*[F.bool_or(F.expr(f)).alias(d) for d, f in FLAGS.items()])
    rows = top.join(has.hint("merge"), "o_orderkey", "left")
    dims = F.array(*[F.struct(F.lit(d).alias("dimension"), F.coalesce(d, F.lit(False)).alias("present"), F.when(F.col(d), F.concat(F.lit(f"{d}:"), "row_id")).otherwise("").alias("evidence")) for d in FLAGS])
    rows = rows.select(F.col("row_id").alias("review_id"), "product_id", "rank", dims.alias("dimensions"))
    return rows.withColumn("score", F.size(F.filter("dimensions", lambda d: d["present"])))


ASSESSMENTS_ORDERS = f"""top_rows AS (SELECT * FROM reviews WHERE sort = 'default' AND rank <= {TOP}), flags AS (
  SELECT r.row_id AS review_id, r.product_id, r.rank, {', '.join(f'coalesce(bool_or({f}), false) AS {d}' for d, f in FLAGS.items())}
  FROM top_rows r LEFT JOIN lineitem l ON r.o_orderkey = l.l_orderkey GROUP BY ALL
), assessed AS ({' UNION ALL '.join(f"SELECT review_id, product_id, rank, '{d}' AS dimension, {d} AS present FROM flags" for d in FLAGS)}
), dims AS (SELECT unnest([{', '.join(f"'{d}'" for d in FLAGS)}]) AS dimension)"""

# Conversations as questions: a user turn and the assistant turn after it.


def questions_conv(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    turns = Window.partitionBy("conv_id").orderBy("turn")
    c = c.withColumn("next_role", F.lead("role").over(turns)).withColumn("next_text", F.lead("text").over(turns)).where("role = 'user'")
    m = F.col("conv_id") % 5
    c = c.select(
        F.when(m < 2, "p0").when(m < 4, "p1").otherwise("p2").alias("product_id"), "conv_id", "turn", F.col("text").alias("question"),
        F.when(F.col("next_role") == "assistant", F.col("next_text")).otherwise("").alias("answer"),
    )
    return numbered(c, ["product_id"], ["conv_id", "turn"], "rank").select(
        F.concat("product_id", F.lit(":questions")).alias("source_id"), F.concat_ws(":", F.lit("q"), "conv_id", "turn").alias("row_id"), "product_id", F.col("rank").cast("int").alias("rank"),
        "question", "answer", F.concat(F.lit("q"), 1 + F.length("question") % 8).alias("topic_id"),
    )


QUESTIONS_CONV = """turns AS (
  SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
), asked AS (
  SELECT CASE WHEN conv_id % 5 < 2 THEN 'p0' WHEN conv_id % 5 < 4 THEN 'p1' ELSE 'p2' END AS product_id, conv_id, turn, text AS question,
    CASE WHEN next_role = 'assistant' THEN next_text ELSE '' END AS answer FROM turns WHERE role = 'user'
), all_questions AS (
  SELECT product_id || ':questions' AS source_id, 'q:' || conv_id || ':' || turn AS row_id, product_id,
    CAST(row_number() OVER (PARTITION BY product_id ORDER BY conv_id, turn) AS INTEGER) AS rank, question, answer, 'q' || (1 + length(question) % 8) AS topic_id FROM asked
), questions AS (SELECT * FROM all_questions WHERE answer <> '')"""


def answered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return questions_conv(spark, sf_dir).where("answer <> ''")


def products_conv(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("p0", "self", "P0"), ("p1", "competitor", "P1"), ("p2", "competitor", "P2")], "product_id string, role string, name string")


PRODUCTS_CONV = "qproducts AS (SELECT * FROM (VALUES ('p0', 'self'), ('p1', 'competitor'), ('p2', 'competitor')) v(product_id, role))"
TOPICS_SQL = "topics AS (SELECT 'q' || i AS topic_id FROM range(1, 9) t(i))"


# Documents as a sheet: the source is the sheet; ranks repeat and are missing by rule.


def grid_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "text", "n_chars")
    places = numbered(d.select("source", "doc_id"), ["source"], ["doc_id"], "sq").select("doc_id", "sq")
    d = d.join(places.hint("merge"), "doc_id")
    rank = F.when(F.col("doc_id") % 11 == 0, None).when(F.col("sq") % 5 == 0, F.col("sq") - 1).otherwise(F.col("sq"))
    return d.select(
        F.col("source").alias("source_id"), (F.col("sq") + 1).alias("row_no"), (F.col("doc_id") % 17 == 0).alias("is_formula"), rank.cast("string").alias("rank_text"),
        F.when(F.col("n_chars") < 300, "").otherwise(F.col("text")).alias("text"),
    )


GRID_DOCS = f"""numbered AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS sq FROM documents
), grid AS (
  SELECT source AS source_id, sq + 1 AS row_no, doc_id % 17 = 0 AS is_formula,
    CASE WHEN doc_id % 11 = 0 THEN NULL WHEN sq % 5 = 0 THEN sq - 1 ELSE sq END AS rank, CASE WHEN n_chars < 300 THEN '' ELSE text END AS text FROM numbered
), early AS (
  SELECT *, CASE WHEN is_formula THEN 'FORMULA_RANK' WHEN rank IS NULL OR rank <= 0 THEN 'MISSING_RANK' WHEN trim(text) = '' THEN 'EMPTY_INITIAL_TEXT' END AS reason FROM grid
), firsts AS (SELECT source_id, rank, min(row_no) AS fr FROM early WHERE reason IS NULL GROUP BY ALL
), cuts AS (SELECT source_id, max(fr) AS cut FROM (SELECT * FROM firsts QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY fr) <= {CAP}) GROUP BY source_id
), judged AS (
  SELECT e.source_id, e.row_no, e.rank, e.text, coalesce(e.reason, CASE WHEN f.fr > c.cut THEN 'OVER_LIMIT' WHEN e.row_no > f.fr THEN 'DUPLICATE_RANK' ELSE 'USED' END) AS reason
  FROM early e LEFT JOIN firsts f ON e.source_id = f.source_id AND e.rank = f.rank AND e.reason IS NULL LEFT JOIN cuts c ON e.source_id = c.source_id
)"""

# Documents as reviews of two lists: even ids and odd ids.


def reviews_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    sort = F.when(F.col("doc_id") % 2 == 0, "default").otherwise("recent")
    return d.select(
        F.col("lang").alias("product_id"), sort.alias("sort"), F.concat("lang", F.lit(":"), sort, F.lit("_reviews")).alias("source_id"), F.col("doc_id").alias("row_id"),
        F.col("text").alias("initial_text"), F.concat(F.lit("q"), "quality", F.lit("t"), "toxic").alias("type_id"),
    )


REVIEWS_DOCS = r"""dr AS (
  SELECT lang AS product_id, CASE WHEN doc_id % 2 = 0 THEN 'default' ELSE 'recent' END AS sort, lang || ':' || CASE WHEN doc_id % 2 = 0 THEN 'default' ELSE 'recent' END || '_reviews' AS source_id,
    doc_id AS row_id, text AS initial_text, regexp_replace(text, '\s', '', 'g') AS key, 'q' || quality || 't' || toxic AS type_id FROM documents LEFT JOIN labels USING (doc_id)
)"""

# Pages as uploaded files: path without scheme and query, host as group.


def files_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    return p.select(F.col("page_id").alias("id"), path.alias("path"), F.substring_index(path, "/", 1).alias("detected"), F.length("html").cast("long").alias("size"))


FILES_PAGES = """files AS (
  SELECT id, path, split_part(path, '/', 1) AS detected, size FROM (
    SELECT page_id AS id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS path, CAST(length(html) AS BIGINT) AS size FROM pages)
)"""


def markdown_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Markdown text per source and language as lines (doc, pos, line): a heading and a table with a line for each of its documents."""
    d = table(spark, sf_dir, "documents").withColumn("doc", F.concat_ws(":", "source", "lang"))
    body = d.select("doc", F.lit(1).alias("part"), F.col("doc_id").alias("o"), F.format_string("| %d | **%s** |", "doc_id", F.md5("text")).alias("line"))
    around = [F.struct(F.lit(p).alias("part"), F.lit(o).cast("long").alias("o"), line.alias("line")) for p, o, line in (
        (0, 0, F.concat(F.lit("## 1. "), "source", F.lit(" "), "lang")), (0, 1, F.lit("")), (0, 2, F.lit("| key | name |")), (0, 3, F.lit("|---|:---:|")), (2, 0, F.lit("")), (2, 1, F.lit("end")))]
    ends = d.select("doc", "source", "lang").distinct().select("doc", F.explode(F.array(*around)).alias("x")).select("doc", "x.*")
    return numbered(body.unionByName(ends), ["doc"], ["part", "o"], "pos").select("doc", "pos", "line")
