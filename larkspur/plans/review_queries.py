"""Queries over lists of reviews and questions: validation, duplicates, aggregates, readiness."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.functions import text as T
from larkspur.operators import aggregates as A
from larkspur.operators import dedup as D
from larkspur.operators import validate_rows as V
from larkspur.plans import bindings as B
from larkspur.plans.registry import query
from larkspur.plans.report import Report
from larkspur.plans.spill import written
from larkspur.schemas import KINDS, TOPICS, catalog

RO, PO, TY, AS, QC, PC, TP, GD, DR = B.REVIEWS_ORDERS, B.PRODUCTS_ORDERS, B.PRIORITIES, B.ASSESSMENTS_ORDERS, B.QUESTIONS_CONV, B.PRODUCTS_CONV, B.TOPICS_SQL, B.GRID_DOCS, B.REVIEWS_DOCS
GAPS = """counts AS (
  SELECT p.product_id, t.type_id, count(*) FILTER (sort = 'default' AND r.type_id = t.type_id) AS default_count, count(*) FILTER (sort = 'recent' AND r.type_id = t.type_id) AS recent_count,
    count(*) FILTER (sort = 'default') AS dt, count(*) FILTER (sort = 'recent') AS rt
  FROM (SELECT DISTINCT product_id FROM reviews) p CROSS JOIN types t JOIN reviews r ON r.product_id = p.product_id GROUP BY ALL
), gaps AS (
  SELECT product_id, type_id, default_count, coalesce(default_count / nullif(dt, 0), 0) AS default_share, recent_count, coalesce(recent_count / nullif(rt, 0), 0) AS recent_share,
    coalesce(recent_count / nullif(rt, 0), 0) - coalesce(default_count / nullif(dt, 0), 0) AS difference, 'AGG-TYPE-' || product_id || '-' || type_id AS evidence_id FROM counts
)"""
COVER = """cover AS (
  SELECT product_id, dimension, count(*) FILTER (present) AS hit_count, count(*) AS total_count, count(*) FILTER (present) / count(*) AS coverage, 'AGG-SIX-' || product_id || '-' || dimension AS evidence_id
  FROM assessed WHERE product_id IN (SELECT product_id FROM reviews WHERE sort = 'default' GROUP BY 1 HAVING count(*) >= 20) GROUP BY ALL
)"""
TSTAT = """tstat AS (
  SELECT p.product_id, t.topic_id, count(q.row_id) AS count, count(q.row_id) / max(p.total) AS share, coalesce(list(q.row_id ORDER BY q.rank, q.row_id) FILTER (q.row_id IS NOT NULL), [])[1:3] AS representative_ids,
    'AGG-QUESTION-' || p.product_id || '-' || t.topic_id AS evidence_id
  FROM (SELECT product_id, count(*) AS total FROM questions GROUP BY 1) p CROSS JOIN topics t LEFT JOIN questions q ON q.product_id = p.product_id AND q.topic_id = t.topic_id GROUP BY p.product_id, t.topic_id
)"""


def gaps(s, d):
    return A.type_share_gap(B.reviews_orders(s, d), written(B.priorities(s, d)))


def coverage(s, d):
    return Report(s, d).coverage


def topics(s, d):
    return A.topic_stats(B.answered(s, d), catalog(s, TOPICS, "topic_id"))


query("type_share_gap", f"WITH {RO}, {TY}, {GAPS} SELECT * FROM gaps")(gaps)
query("dimension_coverage", f"WITH {RO}, {AS}, {COVER} SELECT * FROM cover")(coverage)
query("topic_stats", f"WITH {QC}, {TP}, {TSTAT} SELECT * FROM tstat")(topics)


@query("top_gap_type", f"WITH {RO}, {TY}, {GAPS} SELECT * FROM gaps WHERE product_id = 'BUILDING' ORDER BY abs(difference) DESC, type_id, product_id LIMIT 1")
def _(s, d):
    return A.top_gap_type(gaps(s, d), B.products_orders(s, d).where("role = 'self'"))


@query("lowest_coverage", f"WITH {RO}, {AS}, {COVER} SELECT * FROM cover WHERE product_id = 'BUILDING' ORDER BY coverage, dimension LIMIT 1")
def _(s, d):
    r = Report(s, d)
    return A.lowest_coverage(r.coverage, r.own)


@query("distinct_products", "SELECT DISTINCT c_mktsegment AS product_id FROM customer")
def _(s, d):
    return A.distinct_products(B.table(s, d, "customer").select(F.col("c_mktsegment").alias("product_id")))


@query("filter_by_sort_role", f"WITH {RO}, {PO} SELECT row_id, rank FROM reviews JOIN products USING (product_id) WHERE sort = 'recent' AND role = 'self'")
def _(s, d):
    return V.of_list(B.reviews_orders(s, d), B.products_orders(s, d), "recent", "self").select("row_id", "rank")


ELIGIBLE = "elig AS (SELECT p.product_id, role, count(q.row_id) AS questions, role = 'self' OR count(q.row_id) >= 90 AS eligible FROM qproducts p LEFT JOIN questions q ON q.product_id = p.product_id GROUP BY p.product_id, role)"


@query("eligible_products", f"WITH {QC}, {PC}, {ELIGIBLE} SELECT * FROM elig")
def _(s, d):
    return A.eligible_products(B.products_conv(s), B.answered(s, d))


@query("top_own_topic", f"WITH {QC}, {PC}, {TP}, {TSTAT} SELECT * FROM tstat WHERE product_id = 'p0' ORDER BY share DESC, topic_id LIMIT 1")
def _(s, d):
    return A.top_own_topic(topics(s, d), B.products_conv(s).where("role = 'self'"))


@query("top_topic_per_product", f"WITH {QC}, {PC}, {TP}, {TSTAT}, {ELIGIBLE} SELECT * FROM tstat WHERE product_id IN (SELECT product_id FROM elig WHERE eligible) QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY share DESC, topic_id) = 1")
def _(s, d):
    return A.top_topic_per_product(topics(s, d), A.eligible_products(B.products_conv(s), B.answered(s, d)).where("eligible"))


query("f03_eligible_evidence", f"WITH {QC}, {TP}, {TSTAT} SELECT evidence_id FROM tstat WHERE product_id IN (SELECT product_id FROM questions GROUP BY 1 HAVING count(*) >= 90)")(
    lambda s, d: A.eligible_topic_evidence(topics(s, d), B.answered(s, d)).select("evidence_id")
)
query("representatives", f"WITH {QC} SELECT product_id, topic_id, row_id, CAST(row_number() OVER (PARTITION BY product_id, topic_id ORDER BY rank, row_id) AS INTEGER) AS n FROM questions QUALIFY n <= 3")(
    lambda s, d: A.representatives(B.answered(s, d), 3)
)


READY = f"""own AS (SELECT count(*) FILTER (sort = 'default') AS default_rows, count(*) FILTER (sort = 'recent') AS recent_rows FROM reviews WHERE product_id = 'BUILDING'
), ownq AS (SELECT CAST(coalesce(sum(questions) FILTER (role = 'self'), 0) AS BIGINT) AS question_rows, count(*) FILTER (role = 'competitor' AND eligible) AS competitors FROM elig
), ready AS (SELECT f AS finding_id, CASE WHEN (f = 'F01' AND default_rows >= 90 AND recent_rows >= 90) OR (f = 'F02' AND default_rows >= 90) OR (f = 'F03' AND question_rows >= 90) THEN 'available' ELSE 'unavailable' END AS status,
  default_rows, recent_rows, question_rows, competitors FROM own, ownq, (VALUES ('F01'), ('F02'), ('F03')) v(f))"""


DOMAIN = f"{RO}, {PO}, {TY}, {QC.replace('questions AS (SELECT * FROM all_questions', 'questions AS (SELECT * REPLACE (CASE product_id WHEN $$p0$$ THEN $$BUILDING$$ WHEN $$p1$$ THEN $$FURNITURE$$ ELSE $$MACHINERY$$ END AS product_id) FROM all_questions')}, {TP}, {ELIGIBLE.replace('qproducts', 'products')}, {READY}"


@query("readiness", f"WITH {DOMAIN} SELECT * FROM ready")
def readiness(s, d):
    return Report(s, d).ready


FLAGGED = f"""{DOMAIN}, {AS}, {COVER}, {GAPS}, {TSTAT}, measures AS (
  SELECT 'F01' AS finding_id, max(abs(difference)) AS measure FROM gaps WHERE product_id = 'BUILDING' UNION ALL SELECT 'F02', min(coverage) FROM cover WHERE product_id = 'BUILDING'
  UNION ALL SELECT 'F03', max(share) FROM tstat WHERE product_id = 'BUILDING'
), flagged AS (
  SELECT finding_id, status, measure, coalesce(status = 'available' AND CASE finding_id WHEN 'F01' THEN measure >= 0.1::DOUBLE WHEN 'F02' THEN measure < 0.6::DOUBLE ELSE measure >= 0.3::DOUBLE END, false) AS has_problem FROM ready JOIN measures USING (finding_id)
)"""


@query("problem_flags", f"WITH {FLAGGED} SELECT * FROM flagged")
def problem_flags(s, d):
    return Report(s, d).flags


# Validation of rows.

EMPTY = [("text", "EMPTY_INITIAL_TEXT")]


def judged(s, d):
    return V.exclude_rows(B.grid_docs(s, d), EMPTY, B.CAP)


query("exclude_rows_reviews", f"WITH {GD} SELECT source_id, row_no, rank, reason FROM judged")(lambda s, d: judged(s, d).select("source_id", "row_no", "rank", "reason"))
query("exclusion_counts", f"WITH {GD} SELECT source_id, reason, count(*) AS n FROM judged WHERE reason <> 'USED' GROUP BY ALL")(lambda s, d: V.exclusion_counts(judged(s, d)))
query("first_by_rank", f"WITH {GD} SELECT source_id, rank, fr AS row_no FROM firsts")(lambda s, d: V.first_by_rank(V.early_reason(B.grid_docs(s, d), EMPTY)))
query("sample_cap", f"WITH {GD} SELECT source_id, row_no FROM early WHERE reason IS NULL QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY row_no) <= 20")(
    lambda s, d: V.sample_cap(V.early_reason(B.grid_docs(s, d), EMPTY).where("early IS NULL"), B.CAP).select("source_id", "row_no")
)
query(
    "source_summary",
    f"""WITH {GD} SELECT source_id, count(*) AS rows_read, count(*) FILTER (reason IN ('USED', 'OVER_LIMIT')) AS valid_rows, count(*) FILTER (reason = 'USED') AS used_rows,
    count(*) FILTER (reason <> 'USED') AS excluded_rows, count(*) FILTER (reason = 'OVER_LIMIT') AS excluded_over_limit,
    CASE WHEN count(*) FILTER (reason = 'USED') = 0 THEN 'missing' WHEN count(*) FILTER (reason = 'USED') < 18 THEN 'insufficient' WHEN count(*) FILTER (reason = 'USED') < 20 THEN 'provisional' ELSE 'complete' END AS status
    FROM judged GROUP BY source_id""",
)(lambda s, d: V.source_summary(judged(s, d), 18, 20))
query("status_of", "SELECT i AS used, CASE WHEN i = 0 THEN 'missing' WHEN i < 90 THEN 'insufficient' WHEN i < 100 THEN 'provisional' ELSE 'complete' END AS status FROM (SELECT DISTINCT user_id % 120 AS i FROM events)")(
    lambda s, d: B.table(s, d, "events").select((F.col("user_id") % 120).alias("used")).distinct().select("used", V.status_of(F.col("used")).alias("status"))
)
WIDE = "０１２３４５６７８９"
query("parse_rank", "SELECT doc_id, CASE WHEN regexp_full_match(item, '[0-9]+') AND length(item) < 30 AND CAST(item AS HUGEINT) BETWEEN 1 AND 9007199254740991 THEN CAST(item AS BIGINT) END AS rank FROM (SELECT doc_id, text AS item FROM documents UNION ALL SELECT doc_id, CAST(doc_id * 1000003 - 5 AS VARCHAR) FROM documents UNION ALL SELECT doc_id, CAST(doc_id AS VARCHAR) FROM documents)")(
    lambda s, d: B.table(s, d, "documents").select("doc_id", F.explode(F.array("text", (F.col("doc_id") * 1000003 - 5).cast("string"), F.concat(F.lit("　00"), F.translate(F.col("doc_id").cast("string"), "0123456789", WIDE), F.lit(" ")))).alias("item"))
    .select("doc_id", T.rank_value(F.col("item")).alias("rank"))
)


@query(
    "exclude_rows_questions",
    f"""WITH {QC}, e AS (SELECT *, CASE WHEN trim(question) = '' THEN 'EMPTY_QUESTION_TEXT' WHEN trim(answer) = '' THEN 'EMPTY_ANSWER' END AS early FROM all_questions
    ), n AS (SELECT *, row_number() OVER (PARTITION BY source_id, early IS NULL ORDER BY rank) AS k FROM e)
    SELECT source_id, CAST(rank + 1 AS INTEGER) AS row_no, coalesce(early, CASE WHEN k > 60 THEN 'OVER_LIMIT' ELSE 'USED' END) AS reason FROM n""",
)
def _(s, d):
    rows = B.questions_conv(s, d).select("source_id", (F.col("rank") + 1).alias("row_no"), F.lit(False).alias("is_formula"), F.col("rank").cast("string").alias("rank_text"), "question", "answer")
    return V.exclude_rows(rows, [("question", "EMPTY_QUESTION_TEXT"), ("answer", "EMPTY_ANSWER")], 60).select("source_id", "row_no", "reason")


COUNTS = f"counts2 AS (SELECT product_id, sort || '_reviews' AS kind, count(*) AS used_rows FROM reviews GROUP BY ALL), kinds AS (SELECT * FROM (VALUES {', '.join(f'($${k}$$)' for k in KINDS)}) v(kind))"


def all_sources(s, d):
    return Report(s, d).sources


SOURCES = f"""{COUNTS}, sources AS (SELECT p.product_id || ':' || k.kind AS source_id, p.product_id, k.kind, coalesce(used_rows, 0) AS used_rows,
  CASE WHEN coalesce(used_rows, 0) = 0 THEN 'missing' WHEN used_rows < 90 THEN 'insufficient' WHEN used_rows < 100 THEN 'provisional' ELSE 'complete' END AS status
  FROM products p CROSS JOIN kinds k LEFT JOIN counts2 c ON c.product_id = p.product_id AND c.kind = k.kind)"""
DENSE = f"{RO}, {PO}, {SOURCES}"
query("densify_sources", f"WITH {DENSE} SELECT * FROM sources")(all_sources)


@query("completeness_evidence", f"WITH {DENSE} SELECT 'DATA-' || product_id || '-' || kind AS evidence_id, product_id, role || '_' || kind AS kind, 100 AS expected_rows, used_rows AS valid_rows, used_rows, CAST(0 AS BIGINT) AS excluded_over_limit, status, used_rows < 90 AS blocking, true AS known FROM sources JOIN products USING (product_id)")
def completeness(s, d):
    return Report(s, d).completeness


@query("completeness_join", f"WITH {DENSE} SELECT source_id, product_id IN (SELECT product_id FROM products WHERE product_id <> 'MACHINERY') AS known FROM sources")
def _(s, d):
    r = Report(s, d)
    return V.known_products(r.sources, r.products.where("product_id <> 'MACHINERY'")).select("source_id", "known")


# Duplicates.


def keyed(s, d):
    return D.with_text_key(B.reviews_docs(s, d).select("row_id", "product_id", "sort", "source_id", "initial_text"), "initial_text")


query("normalize_exact", f"WITH {DR} SELECT row_id, md5(key) AS key FROM dr")(lambda s, d: keyed(s, d).select("row_id", "key"))
query("duplicate_groups", f"WITH {DR}, n AS (SELECT source_id, dr.key AS k, row_id, count(*) OVER (PARTITION BY source_id, dr.key) AS size, row_number() OVER (PARTITION BY source_id, dr.key ORDER BY row_id) AS n FROM dr) SELECT source_id, md5(k) AS key, size, CAST((n - 1) // 1000 + 1 AS BIGINT) AS part, list(row_id ORDER BY row_id) AS row_ids FROM n WHERE size > 1 GROUP BY ALL")(lambda s, d: D.duplicate_groups(keyed(s, d)))
NUMBERED = f"{DR}, nd AS (SELECT *, row_number() OVER (PARTITION BY product_id, sort, dr.key ORDER BY row_id) AS n FROM dr)"
query("occurrence_number", f"WITH {NUMBERED} SELECT row_id, n FROM nd")(lambda s, d: D.occurrence_number(keyed(s, d)).select("row_id", "n"))
MATCHED = f"{NUMBERED}, m AS (SELECT l.product_id, md5(l.key) AS key, l.n, l.row_id AS default_row, r.row_id AS recent_row FROM nd l JOIN nd r ON l.product_id = r.product_id AND l.key = r.key AND l.n = r.n AND l.sort = 'default' AND r.sort = 'recent')"
query("multiset_match", f"WITH {MATCHED} SELECT * FROM m")(lambda s, d: D.multiset_match(keyed(s, d)))


@query("cross_list_overlap", f"""WITH {MATCHED} SELECT d.product_id, coalesce(max(c.pairs), 0) AS pairs, count(*) FILTER (sort = 'default') AS default_rows, count(*) FILTER (sort = 'recent') AS recent_rows,
  list_sort(list(DISTINCT source_id) FILTER (sort = 'default')) AS default_sources, list_sort(list(DISTINCT source_id) FILTER (sort = 'recent')) AS recent_sources,
  coalesce(coalesce(max(c.pairs), 0) / nullif(least(count(*) FILTER (sort = 'default'), count(*) FILTER (sort = 'recent')), 0), 0) AS overlap FROM dr d LEFT JOIN (SELECT product_id, count(*) AS pairs FROM m GROUP BY 1) c USING (product_id) GROUP BY 1""")
def _(s, d):
    k = keyed(s, d)
    return D.cross_list_overlap(k, D.multiset_match(k))


query("text_intersect_all", f"WITH {MATCHED} SELECT product_id, count(*) AS pairs FROM m GROUP BY 1")(lambda s, d: D.text_intersect_all(keyed(s, d)))
