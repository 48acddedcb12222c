"""Queries over findings, actions, integrity checks, report tables and cell functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from larkspur.functions import text as T
from larkspur.operators import aggregates as A
from larkspur.operators import findings as FN
from larkspur.operators import integrity as I
from larkspur.operators import report as R
from larkspur.operators import validate_rows as V
from larkspur.operators.numbering import numbered
from larkspur.plans import bindings as B
from larkspur.plans import review_queries as RQ
from larkspur.plans.registry import query
from larkspur.plans.report import Report
from larkspur.plans.spill import scratch_path, written
from larkspur.schemas import DIMENSIONS, KIND_LABELS, STATUS_LABELS, TOPICS, catalog

RO, PO, AS = B.REVIEWS_ORDERS, B.PRODUCTS_ORDERS, B.ASSESSMENTS_ORDERS
FOUND = f"""{RQ.FLAGGED}, families AS (
  SELECT 'F01' AS finding_id, evidence_id FROM gaps WHERE product_id = 'BUILDING' UNION ALL SELECT 'F02', evidence_id FROM cover WHERE product_id = 'BUILDING'
  UNION ALL SELECT 'F03', evidence_id FROM tstat WHERE product_id IN (SELECT product_id FROM elig WHERE questions >= 90)
), findings AS (SELECT f.finding_id, f.status, f.has_problem, list(e.evidence_id ORDER BY e.evidence_id) AS evidence_ids FROM flagged f JOIN families e USING (finding_id) GROUP BY ALL)"""


def P1(share, unit="%"):
    """The SQL of a share in hundredths with one decimal, by whole numbers: 2^60 times a double is one, and exact."""
    x = f"(CAST({share} AS DOUBLE) * 100)"
    tenths = f"((20 * CAST(abs({x}) * 1152921504606846976.0::DOUBLE AS HUGEINT) + 1152921504606846976) // 2305843009213693952)"
    return f"(CASE WHEN {x} < 0 THEN '-' ELSE '' END || CAST({tenths} // 10 AS VARCHAR) || '.' || CAST({tenths} % 10 AS VARCHAR) || '{unit}')"



TITLED = " UNION ALL ".join(f"SELECT '{f}' AS finding_id, '{o}' AS outcome, '{t}' AS title" for f, o, t in FN.TITLES)
query("finding_text", f"WITH {RQ.FLAGGED}, t AS ({TITLED}) SELECT f.finding_id, title, {P1('measure')} AS measure FROM flagged f JOIN t ON t.finding_id = f.finding_id AND outcome = CASE WHEN status = 'unavailable' THEN status WHEN has_problem THEN 'problem' ELSE 'none' END")(
    lambda s, d: FN.finding_titles(Report(s, d).flags).select("finding_id", "title", T.percent1(F.col("measure")).alias("measure"))
)


def said(key, *figures):
    """The SQL of a finding's detail: the fixed text around its figures."""
    parts = FN.DETAILS[key].replace("%%", "%").split("%s")
    return " || ".join(x for p, f in zip(parts, [*figures, None], strict=True) for x in ([f"$${p}$$"] if p else []) + ([f"CAST({f} AS VARCHAR)"] if f else []))


def named(column, names):
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items()) + f" ELSE {column} END"


SOME = " || CAST(count(*) FILTER (role = 'competitor' AND questions >= 90) AS VARCHAR) || ".join(f"'{x}'" for x in FN.COMPETITORS["some"].split("%s"))
NOTE = f"(SELECT CASE WHEN count(*) FILTER (role = 'competitor' AND questions >= 90) = 0 THEN '{FN.COMPETITORS['few']}' ELSE {SOME} END FROM elig)"
CLAUSE = " || ".join(f"'{p}' || {f}" if f else f"'{p}'" for p, f in zip(FN.TOPIC_CLAUSE.split("%s"), (f"CASE WHEN product_id = 'BUILDING' THEN '{FN.OWN_NAME}' ELSE product_id[1] || lower(product_id[2:]) END", named("topic_id", TOPICS), "count", P1("share"), None), strict=True))
DETAILED = f"""top_gap AS (SELECT * FROM gaps WHERE product_id = 'BUILDING' ORDER BY abs(difference) DESC, type_id LIMIT 1), low AS (SELECT * FROM cover WHERE product_id = 'BUILDING' ORDER BY coverage, dimension LIMIT 1
), tops AS (SELECT * FROM tstat WHERE product_id IN (SELECT product_id FROM elig WHERE questions >= 90) QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY share DESC, topic_id) = 1
), clauses AS (SELECT string_agg({CLAUSE}, '；' ORDER BY product_id <> 'BUILDING', product_id) AS c FROM tops
), detailed AS (SELECT *, CASE finding_id
  WHEN 'F01' THEN CASE WHEN status = 'unavailable' THEN (SELECT {said(('F01', 'unavailable'), 'max(default_rows)', 'max(recent_rows)')} FROM ready)
    WHEN has_problem THEN (SELECT {said(('F01', 'problem'), 'type_id', 'default_count', P1('default_share'), 'recent_count', P1('recent_share'), P1('abs(difference)'))} FROM top_gap)
    ELSE (SELECT {said(('F01', 'none'), 'type_id', P1('abs(difference)'))} FROM top_gap) END
  WHEN 'F02' THEN CASE WHEN status = 'unavailable' THEN (SELECT CASE WHEN max(default_rows) < 20 THEN {said(('F02', 'few'), 'max(default_rows)')} ELSE {said(('F02', 'unavailable'), 'max(default_rows)')} END FROM ready)
    WHEN has_problem THEN (SELECT {said(('F02', 'problem'), named('dimension', DIMENSIONS), 'hit_count', P1('coverage'))} FROM low) ELSE (SELECT {said(('F02', 'none'), P1('coverage'))} FROM low) END
  ELSE CASE WHEN status = 'unavailable' THEN (SELECT {said(('F03', 'unavailable'), 'max(question_rows)')} FROM ready)
    WHEN has_problem THEN {said(('F03', 'problem'), '(SELECT c FROM clauses)', NOTE)} ELSE {said(('F03', 'none'), f"(SELECT {P1('max(share)')} FROM tops WHERE product_id = 'BUILDING')", NOTE)} END END AS detail FROM findings)"""


def detailed(r):
    return FN.finding_details(r.findings, r.ready, r.products, r.eligible, r.gaps, r.coverage, r.topics)


query("finding_details", f"WITH {FOUND}, {DETAILED} SELECT finding_id, detail FROM detailed")(lambda s, d: detailed(Report(s, d)).select("finding_id", "detail"))


@query("finding_details_short", f"WITH {FOUND}, {DETAILED.replace('FROM findings)', 'FROM (SELECT * REPLACE ($$unavailable$$ AS status) FROM findings))')} SELECT finding_id, detail FROM detailed")
def _(s, d):
    """The same findings as if none could be made."""
    r = Report(s, d)
    f = r.findings.withColumn("status", F.lit("unavailable"))
    return FN.finding_details(f, r.ready, r.products, r.eligible, r.gaps, r.coverage, r.topics).select("finding_id", "detail")


DATA_FOR = f"""data_for AS (SELECT f AS finding_id, coalesce(list('DATA-' || product_id || '-' || kind ORDER BY 'DATA-' || product_id || '-' || kind) FILTER (product_id IS NOT NULL), []) AS ids
  FROM (VALUES ('F01', 'self_default_reviews'), ('F01', 'self_recent_reviews'), ('F02', 'self_default_reviews'), ('F03', 'self_questions'), ('F03', 'competitor_questions')) v(f, k)
  LEFT JOIN (SELECT s.*, role || '_' || kind AS rk FROM sources s JOIN products USING (product_id) WHERE $keep) ON rk = k AND (k <> 'competitor_questions' OR used_rows < 90) GROUP BY f)"""
query("pick_data_evidence", f"WITH {RQ.DENSE}, {DATA_FOR.replace('$keep', 'kind <> $$default_reviews$$')} SELECT finding_id, CASE WHEN len(ids) = 0 AND finding_id <> 'F03' THEN ['DATA-BUILDING-questions'] ELSE ids END AS evidence_ids FROM data_for")(
    lambda s, d: FN.data_evidence(Report(s, d).completeness.where("NOT endswith(kind, 'default_reviews')"), 90)
)


def proposed(r):
    """Findings as a model may propose them: one as found, one with a wrong status, one with evidence that there is not."""
    ids = F.when(F.col("finding_id") == "F03", F.array_append("evidence_ids", F.lit("AGG-NONE"))).otherwise(F.slice("evidence_ids", 1, 2))
    status = F.when(F.col("finding_id") == "F02", "unavailable").otherwise(F.col("status"))
    return FN.gate_findings(r.findings.select("finding_id", status.alias("status"), ids.alias("evidence_ids")), r.findings, r.allowed, FN.data_evidence(r.completeness, 90))


query("gate_findings", f"WITH {FOUND}, {RQ.SOURCES}, {DATA_FOR.replace('$keep', 'true')} SELECT f.finding_id, CASE WHEN f.finding_id = 'F01' THEN status ELSE 'unavailable' END AS status, f.finding_id = 'F01' AS accepted, CASE WHEN f.finding_id = 'F01' THEN evidence_ids ELSE ids END AS evidence_ids FROM findings f JOIN data_for USING (finding_id)")(
    lambda s, d: proposed(Report(s, d))[0]
)
query("refused_findings", f"WITH {FOUND} SELECT 'SYNTHESIS_EVIDENCE_REJECTED' AS code, finding_id FROM findings WHERE finding_id <> 'F01'")(lambda s, d: proposed(Report(s, d))[1])

ACT = " UNION ALL ".join(f"SELECT '{f}' AS finding_id, '{p}' AS priority, '{a}' AS action, '{c}' AS cause" for f, p, a, c in FN.ACTIONS)
ACTED = f"""{FOUND}, templates AS ({ACT}), actions AS (SELECT 'A' || lpad(CAST(row_number() OVER (ORDER BY f.finding_id) AS VARCHAR), 2, '0') AS action_id, t.priority, t.action,
  f.finding_id || '｜' || array_to_string(evidence_ids, '、') || '：' || cause AS reason, [f.finding_id] AS finding_ids, evidence_ids
  FROM findings f JOIN templates t ON t.finding_id = f.finding_id AND t.priority = CASE WHEN status = 'unavailable' THEN 'P0' ELSE 'P1' END WHERE status = 'unavailable' OR has_problem)"""
query("build_actions", f"WITH {ACTED} SELECT * FROM actions")(lambda s, d: Report(s, d).actions)


@query("build_actions_short", f"WITH {ACTED} SELECT 'A' || lpad(CAST(row_number() OVER (ORDER BY f.finding_id) AS VARCHAR), 2, '0') AS action_id, CASE f.finding_id WHEN 'F03' THEN '{FN.MORE_COMPETITORS[0]}' ELSE t.action END AS action FROM findings f JOIN templates t ON t.finding_id = f.finding_id AND t.priority = 'P0'")
def _(s, d):
    """Actions if no finding could be made: a competitor without enough questions asks for more of them."""
    r = Report(s, d)
    return FN.build_actions(r.findings.withColumn("status", F.lit("unavailable")), r.eligible).select("action_id", "action")


query("action_numbering", f"WITH {ACTED} SELECT action_id, finding_ids FROM actions")(lambda s, d: Report(s, d).actions.select("action_id", "finding_ids"))
query("business_reason", f"WITH {ACTED} SELECT action_id, cause AS reason FROM actions JOIN templates t ON t.finding_id = finding_ids[1] AND t.priority = actions.priority")(
    lambda s, d: Report(s, d).actions.select("action_id", T.business_reason(F.col("reason"), F.col("finding_ids"), F.col("evidence_ids")).alias("reason"))
)

EVID = "data_ids AS (SELECT 'DATA-' || product_id || '-' || kind AS evidence_id, product_id FROM products, (VALUES ('default_reviews'), ('recent_reviews'), ('questions')) v(kind)), evid AS (SELECT evidence_id, 'type' AS family, product_id FROM gaps UNION ALL SELECT evidence_id, 'dimension', product_id FROM cover UNION ALL SELECT evidence_id, 'question', product_id FROM tstat UNION ALL SELECT evidence_id, 'data', product_id FROM data_ids)"
query("evidence_union", f"WITH {FOUND}, {EVID} SELECT DISTINCT evidence_id FROM evid")(lambda s, d: I.evidence_union(Report(s, d).evidence))


@query("action_lineage", f"WITH {ACTED}, {EVID} SELECT action_id, finding_ids[1] AS finding_id, e AS evidence_id, e IN (SELECT evidence_id FROM evid) AS known FROM (SELECT *, unnest(evidence_ids) AS e FROM actions)")
def _(s, d):
    r = Report(s, d)
    return FN.action_lineage(r.actions, r.evidence)


@query("finding_evidence_join", f"WITH {FOUND}, {EVID} SELECT finding_id, e AS evidence_id, family FROM (SELECT *, unnest(evidence_ids) AS e FROM findings) LEFT JOIN evid ON evid.evidence_id = e")
def _(s, d):
    r = Report(s, d)
    return FN.finding_evidence_rows(r.findings, r.evidence)


query("array_refs_merge", f"WITH {ACTED} SELECT action_id, list_sort(list_distinct(evidence_ids || ['extra'])) AS ids FROM actions")(lambda s, d: Report(s, d).actions.select("action_id", F.array_sort(FN.refs_merge(F.lit("extra"), F.col("evidence_ids"))).alias("ids")))
query("extract_refs", f"WITH {ACTED} SELECT action_id, finding_ids, list_sort(evidence_ids) AS evidence_ids FROM actions")(
    lambda s, d: Report(s, d).actions.select("action_id", T.extract_refs(F.col("reason"), "finding").alias("finding_ids"), T.extract_refs(F.col("reason"), "evidence").alias("evidence_ids"))
)
query("id_set_equal", "SELECT conv_id, list_sort(list(DISTINCT role)) = ['assistant', 'user'] AS ok FROM conversations GROUP BY conv_id")(
    lambda s, d: B.table(s, d, "conversations").groupBy("conv_id").agg(F.collect_list("role").alias("roles")).select("conv_id", I.ids_equal(F.col("roles"), F.array(F.lit("user"), F.lit("assistant"))).alias("ok"))
)

# Integrity checks on tables with planted faults.

TYP = B.PRIORITIES
query("v01_duplicate_row_id", f"WITH {RO} SELECT 'DUPLICATE_ROW_ID' AS code, row_id AS object_id FROM reviews WHERE o_orderkey % 37 = 0")(
    lambda s, d: I.repeated(B.reviews_orders(s, d).union(B.reviews_orders(s, d).where("o_orderkey % 37 = 0")), "row_id", "DUPLICATE_ROW_ID")
)


def assessed(s, d, assessments=None):
    """Assessments with unknown, repeated and misplaced reviews, and dimensions that are none."""
    a = (B.assessments_orders(s, d) if assessments is None else assessments).select("review_id", "product_id", "rank", "dimensions")
    odd = F.transform("dimensions", lambda x: x.withField("dimension", F.when(F.col("rank") == 3, F.lit("other")).otherwise(x["dimension"])))
    return a.withColumn("dimensions", odd).union(a.where("rank = 5")).union(a.where("rank = 7").withColumn("review_id", F.concat(F.lit("no:"), "review_id")))


query("v02_unknown_model_row", f"WITH {RO} SELECT 'UNKNOWN_MODEL_ROW' AS code, 'no:' || row_id AS object_id FROM reviews WHERE sort = 'default' AND rank = 7")(
    lambda s, d: I.unknown(assessed(s, d).withColumnRenamed("review_id", "row_id"), B.reviews_orders(s, d), ["row_id"], "UNKNOWN_MODEL_ROW", "row_id")
)
query("v03_duplicate_model_row", f"WITH {RO} SELECT 'DUPLICATE_MODEL_ROW' AS code, row_id AS object_id FROM reviews WHERE sort = 'default' AND rank = 5")(lambda s, d: I.repeated(assessed(s, d), "review_id", "DUPLICATE_MODEL_ROW"))
query("v04_invalid_top20", f"WITH {RO} SELECT 'INVALID_TOP20_REVIEW' AS code, product_id AS object_id FROM reviews GROUP BY product_id")(lambda s, d: I.invalid_top(assessed(s, d), B.reviews_orders(s, d), 20))
query("v05_invalid_dimension", f"WITH {RO} SELECT 'INVALID_DIMENSION' AS code, row_id AS object_id FROM reviews WHERE sort = 'default' AND rank = 3")(lambda s, d: I.invalid_dimension(assessed(s, d), tuple(DIMENSIONS)))
query("v06_invalid_type_id", f"WITH {RO} SELECT 'INVALID_TYPE_ID' AS code, row_id AS object_id FROM reviews WHERE type_id = '1-URGENT'")(
    lambda s, d: I.unknown(B.reviews_orders(s, d), B.priorities(s, d).where("type_id <> '1-URGENT'"), ["type_id"], "INVALID_TYPE_ID", "row_id")
)
query("v07_invalid_topic_id", f"WITH {B.QUESTIONS_CONV} SELECT 'INVALID_TOPIC_ID' AS code, row_id AS object_id FROM questions WHERE topic_id = 'q8'")(
    lambda s, d: I.unknown(B.answered(s, d), catalog(s, TOPICS, "topic_id").where("topic_id <> 'q8'"), ["topic_id"], "INVALID_TOPIC_ID", "row_id")
)


@query("aggregate_reconcile", f"WITH {RO}, {TYP}, {RQ.GAPS} SELECT product_id, type_id, CASE type_id[1] WHEN '1' THEN 'MISSING' WHEN '2' THEN 'DIFFERENT' ELSE 'REPEATED' END AS fault FROM gaps WHERE type_id[1] IN ('1', '2', '3')")
def _(s, d):
    g = RQ.gaps(s, d)
    n = F.substring("type_id", 1, 1)
    off = g.where(n != "1").withColumn("default_count", F.when(n == "2", F.col("default_count") + 1).otherwise(F.col("default_count")))
    return I.reconcile(off.union(g.where(n == "3")), g, ["product_id", "type_id"])


@query("v08_aggregate_mismatch", f"WITH {RO}, {AS}, {RQ.COVER} SELECT product_id, dimension, 'DIFFERENT' AS fault FROM cover WHERE dimension = 'scene' AND hit_count > 0")
def _(s, d):
    cover = RQ.coverage(s, d)
    return I.reconcile(cover.withColumn("coverage", F.when(F.col("dimension") == "scene", F.col("coverage") / 2).otherwise(F.col("coverage"))), cover, ["product_id", "dimension"])


@query("v09_catalog_mismatch", "SELECT 'CATALOG_MISMATCH' AS code, CAST(p_partkey AS VARCHAR) AS object_id FROM part WHERE p_partkey % 7 IN (1, 2)")
def _(s, d):
    """Parts as a catalog of which each seventh entry has another place and each seventh is missing."""
    p = B.table(s, d, "part").select("p_partkey", F.col("p_name").alias("name"), F.col("p_partkey").alias("position"))
    moved = p.where("p_partkey % 7 <> 2").withColumn("position", F.when(F.col("p_partkey") % 7 == 1, -1).otherwise(F.col("position")))
    return I.catalog_checks(moved, p, "p_partkey")


@query("catalog_reconcile", "SELECT p_partkey, p_name AS name, 'missing' AS side FROM part WHERE p_partkey % 7 = 2 UNION ALL SELECT p_partkey, p_name || '!', 'extra' FROM part WHERE p_partkey % 7 = 1 UNION ALL SELECT p_partkey, p_name, 'missing' FROM part WHERE p_partkey % 7 = 1")
def _(s, d):
    p = B.table(s, d, "part").select("p_partkey", F.col("p_name").alias("name"))
    given = p.where("p_partkey % 7 <> 2").withColumn("name", F.when(F.col("p_partkey") % 7 == 1, F.concat("name", F.lit("!"))).otherwise(F.col("name")))
    return I.catalog_reconcile(given, p)


@query("v10_completeness_mismatch", f"WITH {RQ.DENSE} SELECT source_id, 'DIFFERENT' AS fault FROM sources WHERE kind = 'recent_reviews'")
def _(s, d):
    sources = RQ.all_sources(s, d)
    return I.reconcile(sources.withColumn("used_rows", F.when(F.col("kind") == "recent_reviews", F.col("used_rows") + 1).otherwise(F.col("used_rows"))), sources, ["source_id"])


@query("v11_source_anchor", f"WITH {RO} SELECT 'SOURCE_ANCHOR_MISMATCH' AS code, row_id AS object_id FROM reviews WHERE o_orderkey % 41 = 0")
def _(s, d):
    r = B.reviews_orders(s, d).withColumn("kind", F.concat("sort", F.lit("_reviews")))
    moved = r.withColumn("kind", F.when(F.col("o_orderkey") % 41 == 0, "questions").otherwise(F.col("kind")))
    return I.source_anchor(moved, RQ.all_sources(s, d))


query("v12_missing_required_source", f"WITH {PO} SELECT 'MISSING_REQUIRED_SOURCE' AS code, product_id || ':questions' AS object_id FROM products")(
    lambda s, d: I.missing_required(B.products_orders(s, d), s.createDataFrame([("default_reviews",), ("recent_reviews",), ("questions",)], "kind string"), RQ.all_sources(s, d).where("used_rows > 0"))
)
@query("v13_readiness_mismatch", f"WITH {RQ.DOMAIN} SELECT finding_id, 'DIFFERENT' AS fault FROM ready WHERE finding_id = 'F02'")
def _(s, d):
    ready = RQ.readiness(s, d).select("finding_id", "status")
    return I.reconcile(ready.withColumn("status", F.when(F.col("finding_id") == "F02", "other").otherwise(F.col("status"))), ready, ["finding_id"])
@query("v14_diagnosis_mismatch", f"WITH {RQ.FLAGGED} SELECT finding_id, 'DIFFERENT' AS fault FROM flagged WHERE finding_id = 'F01'")
def _(s, d):
    flags = RQ.problem_flags(s, d).select("finding_id", "has_problem")
    return I.reconcile(flags.withColumn("has_problem", F.col("has_problem") != (F.col("finding_id") == "F01")), flags, ["finding_id"])


def finding_ids(s, d):
    """Findings of many products with two id fields that disagree, lack or repeat by rule."""
    p = B.table(s, d, "pages").select("page_id")
    one = F.when(F.col("page_id") % 9 == 0, None).otherwise(F.concat(F.lit("F"), F.col("page_id") - F.when(F.col("page_id") % 13 == 0, 1).otherwise(0)))
    other = F.when(F.col("page_id") % 7 == 0, F.lit("F0")).otherwise(one)
    return p.select("page_id", one.alias("finding_id"), other.alias("id"))


IDS = "fid AS (SELECT page_id, CASE WHEN page_id % 9 <> 0 THEN 'F' || (page_id - CASE WHEN page_id % 13 = 0 THEN 1 ELSE 0 END) END AS finding_id, CASE WHEN page_id % 7 = 0 THEN 'F0' WHEN page_id % 9 <> 0 THEN 'F' || (page_id - CASE WHEN page_id % 13 = 0 THEN 1 ELSE 0 END) END AS id FROM pages)"
query("v15_conflicting_finding_id", f"WITH {IDS} SELECT 'CONFLICTING_FINDING_ID' AS code, CAST(page_id AS VARCHAR) AS object_id FROM fid WHERE finding_id <> id")(lambda s, d: I.where(finding_ids(s, d), F.col("finding_id") != F.col("id"), "CONFLICTING_FINDING_ID", "page_id"))
query("v16_missing_finding_id", f"WITH {IDS} SELECT 'MISSING_FINDING_ID' AS code, CAST(page_id AS VARCHAR) AS object_id FROM fid WHERE finding_id IS NULL AND id IS NULL")(lambda s, d: I.where(finding_ids(s, d), F.coalesce("finding_id", "id").isNull(), "MISSING_FINDING_ID", "page_id"))
query("v17_duplicate_finding_id", f"WITH {IDS} SELECT 'DUPLICATE_FINDING_ID' AS code, finding_id AS object_id FROM fid WHERE finding_id IS NOT NULL GROUP BY finding_id HAVING count(*) > 1")(
    lambda s, d: I.repeated(finding_ids(s, d).where("finding_id IS NOT NULL"), "finding_id", "DUPLICATE_FINDING_ID")
)


#: What miscited() has the findings cite, and what a finding may cite by the rules of finding_evidence().
CITED = f"""{FOUND}, {EVID}, enough AS (SELECT product_id FROM elig WHERE questions >= 90), mis AS (SELECT 'F01' AS finding_id, evidence_id FROM gaps WHERE product_id = 'BUILDING' UNION ALL SELECT 'F02', 'AGG-NONE'
  UNION ALL SELECT 'F03', evidence_id FROM gaps WHERE product_id = 'BUILDING' UNION ALL SELECT 'F03', evidence_id FROM tstat WHERE product_id = 'MACHINERY'
), cited AS (SELECT f.finding_id, status, mis.evidence_id, family, evid.product_id FROM findings f LEFT JOIN mis ON mis.finding_id = f.finding_id LEFT JOIN evid ON evid.evidence_id = mis.evidence_id
), judged AS (SELECT finding_id, status, coalesce(bool_and(family = 'data'), false) AS all_data, coalesce(bool_or(family = CASE finding_id WHEN 'F01' THEN 'type' WHEN 'F02' THEN 'dimension' ELSE 'question' END), false) AS has_due,
  coalesce(bool_or(family = 'question' AND product_id = 'BUILDING'), false) AS has_own FROM cited GROUP BY ALL)"""


@query("v18_v21_finding_evidence", f"""WITH {CITED} SELECT 'UNKNOWN_EVIDENCE' AS code, evidence_id AS object_id FROM cited WHERE evidence_id IS NOT NULL AND family IS NULL
  UNION ALL SELECT 'INVALID_F03_EVIDENCE', evidence_id FROM cited WHERE finding_id = 'F03' AND family IN ('type', 'dimension')
  UNION ALL SELECT 'INELIGIBLE_COMPETITOR_EVIDENCE', evidence_id FROM cited WHERE finding_id = 'F03' AND family = 'question' AND product_id NOT IN (SELECT product_id FROM enough)
  UNION ALL SELECT 'INVALID_FINDING_EVIDENCE', finding_id FROM judged WHERE CASE WHEN status = 'unavailable' THEN NOT all_data ELSE NOT has_due OR (finding_id = 'F03' AND NOT has_own) END""")
def _(s, d):
    r = Report(s, d)
    return I.finding_evidence(miscited(r).select("finding_id", "status", "evidence_ids"), r.evidence, r.own, r.eligible.where("questions >= 90").select("product_id"))


def miscited(r):
    """Findings of which one cites what there is not, and one what it may not cite."""
    ids = lambda c, name: r.evidence.where(c).agg(F.array_sort(F.collect_list("evidence_id")).alias(name))
    # One row each, with the ids of one product.
    f = r.findings.crossJoin(F.broadcast(ids("family = 'type' AND product_id = 'BUILDING'", "types"))).crossJoin(F.broadcast(ids("family = 'question' AND product_id = 'MACHINERY'", "others")))
    own_ids = F.when(F.col("finding_id") == "F01", F.col("types")).when(F.col("finding_id") == "F02", F.array(F.lit("AGG-NONE"))).otherwise(F.concat("types", "others"))
    return f.withColumn("evidence_ids", own_ids).drop("types", "others")


CODES = ("MISSING_ACTION_FINDING", "MISSING_ACTION_EVIDENCE", "UNKNOWN_FINDING", "UNKNOWN_EVIDENCE", "EVIDENCE_NOT_IN_FINDING", "REASON_FINDING_MISMATCH", "REASON_EVIDENCE_MISMATCH")


@query("v22_v30_action_checks", "SELECT CASE k % 8 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(CODES)) + """ END AS code, CAST(k AS VARCHAR) AS object_id FROM (SELECT c_custkey AS k FROM customer) WHERE k % 8 < 7
  UNION ALL SELECT 'TOO_MANY_ACTIONS', CAST(count(*) AS VARCHAR) FROM customer UNION ALL SELECT 'DUPLICATE_FINDING_ACTION', f FROM (SELECT CASE c_custkey % 8 WHEN 2 THEN 'F9' ELSE 'F' || c_custkey END AS f FROM customer WHERE c_custkey % 8 <> 0) GROUP BY f HAVING count(*) > 1""")
def _(s, d):
    """One action per customer, each eighth without fault, the others with the fault of their number."""
    k, m = F.col("c_custkey"), F.col("c_custkey") % 8
    n = B.table(s, d, "customer")
    none = F.array().cast("array<string>")
    f = F.concat(F.lit("F"), F.when(m == 2, 9).otherwise(k).cast("string"))
    e = F.concat(F.lit("AGG-"), F.when(m == 3, "x").when(m == 4, (k - 1).cast("string")).otherwise(k.cast("string")))
    fs, es = F.when(m == 0, none).otherwise(F.array(f)), F.when(m == 1, none).otherwise(F.array(e))
    reason = F.concat(F.when(m == 5, "F0").otherwise(f), F.lit("｜"), F.when(m == 6, "AGG-0").otherwise(e), F.lit("：x"))
    acts = n.select(k.cast("string").alias("action_id"), fs.alias("finding_ids"), es.alias("evidence_ids"), reason.alias("reason"))
    found = n.where(k != 9).select(F.concat(F.lit("F"), k).alias("finding_id"), F.array(F.concat(F.lit("AGG-"), k)).alias("evidence_ids"))
    return I.action_checks(acts, found, n.select(F.concat(F.lit("AGG-"), k).alias("evidence_id")))


@query("v23_conflicting_action_reference", "SELECT 'CONFLICTING_ACTION_REFERENCE' AS code, CAST(page_id AS VARCHAR) AS object_id FROM pages, range(CASE WHEN page_id % 15 = 0 THEN 2 ELSE 1 END) WHERE page_id % 3 = 0 OR page_id % 5 = 0")
def _(s, d):
    """Actions with single and plural ids: each third names another finding, each fifth other evidence; others leave one out."""
    k = F.col("page_id")
    f, e = F.concat(F.lit("F"), k), F.concat(F.lit("AGG-"), k)
    p = B.table(s, d, "pages").select(
        k.cast("string").alias("action_id"), F.when(k % 3 == 0, "F").when(k % 4 > 0, f).alias("finding_id"), F.when(k % 4 != 1, F.array(f, f)).when(k % 3 == 0, F.array(f)).alias("finding_ids"),
        F.when(k % 5 == 0, "AGG-").otherwise(e).alias("evidence_id"), F.when((k % 5 == 0) | (k % 2 == 0), F.array(e)).alias("evidence_ids"), F.concat(f, F.lit("｜"), e, F.lit("：x")).alias("reason"),
    )
    found = B.table(s, d, "pages").select(f.alias("finding_id"), F.array(e).alias("evidence_ids"))
    return I.action_checks(p, found, found.select(F.col("evidence_ids")[0].alias("evidence_id"))).where("code = 'CONFLICTING_ACTION_REFERENCE'")


def tables_of(r):
    """The whole report with every kind of fault planted in it, and the catalogs it is held against."""
    s = r.spark
    first_review = r.reviews.where("product_id = 'BUILDING' AND sort = 'default' AND rank = 1").agg(F.first("row_id").alias("_id"))
    q = r.questions.crossJoin(F.broadcast(first_review))
    own_first = (F.col("product_id") == "MACHINERY") & (F.col("rank") == F.min(F.when(F.col("product_id") == "MACHINERY", F.col("rank"))).over(Window.partitionBy("product_id")))
    questions = written(q.withColumn("row_id", F.when(own_first, F.col("_id")).otherwise(F.col("row_id"))).drop("_id"))
    assessments = written(assessed(s, r.sf_dir, r.assessments))
    names = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("type_id")).alias("position")  # a catalog: a few rows
    types = written(r.types.where("type_id <> '1-URGENT'").select("type_id", F.col("type_id").alias("name"), names))
    topics = catalog(s, {k: v for k, v in TOPICS.items() if k != "q8"}, "topic_id")
    gaps, stats, cover = A.type_share_gap(r.reviews, types), A.topic_stats(questions, topics), A.dimension_coverage(assessments, r.reviews, catalog(s, DIMENSIONS, "dimension"))
    used = r.reviews.select("source_id").union(questions.select("source_id")).groupBy("source_id").agg(F.count(F.lit(1)).alias("n"))
    n = F.coalesce("n", F.lit(0))
    dense = r.sources.select("source_id", "product_id", "kind").join(used.hint("merge"), "source_id", "left")
    zero = F.lit(0).cast("long")
    sources = written(dense.where("source_id <> 'HOUSEHOLD:questions'").select("source_id", "product_id", "kind", n.alias("rows_read"), n.alias("valid_rows"), n.alias("used_rows"), zero.alias("excluded_rows"), zero.alias("excluded_over_limit"), V.status_of(n).alias("status")))
    complete = V.completeness(r.products, sources).drop("known")
    off = lambda c, key, by: F.when(c, F.col(key) + by).otherwise(F.col(key))
    ready = A.readiness(r.reviews, questions, r.products)
    flags = written(A.problem_flags(ready, gaps, cover, stats, r.products))
    f = miscited(r).select("finding_id", "evidence_ids").join(flags.hint("merge"), "finding_id")
    f = f.select(F.substring("finding_id", 2, 2).cast("int").alias("row_no"), "finding_id", F.col("finding_id").alias("id"), "status", (F.col("has_problem") != (F.col("finding_id") == "F01")).alias("has_problem"), "evidence_ids")
    more = [(11, "F01", "F09"), (12, None, None), (13, "F03", "F03")]
    none = F.array().cast("array<string>")
    more = s.createDataFrame(more, "row_no int, finding_id string, id string").select("row_no", "finding_id", "id", F.lit("available").alias("status"), F.lit(False).alias("has_problem"), none.alias("evidence_ids"))
    acts = [  # action_id, finding_id, finding_ids, evidence_id, evidence_ids, reason
        ("a1", "F02", ["F01"], None, ["AGG-TYPE-BUILDING-2-HIGH"], "F01｜AGG-TYPE-BUILDING-2-HIGH：x"),
        ("a2", None, [], None, ["AGG-TYPE-BUILDING-2-HIGH"], ""),
        ("a3", None, ["F01"], None, [], ""),
        ("a4", None, ["F07"], None, ["AGG-TYPE-BUILDING-2-HIGH"], ""),
        ("a5", None, ["F01"], None, ["AGG-NONE"], ""),
        ("a6", None, ["F01"], None, ["AGG-TYPE-FURNITURE-5-LOW"], ""),
        ("a7", None, ["F01"], None, ["AGG-TYPE-BUILDING-2-HIGH"], "F03｜AGG-TYPE-BUILDING-2-HIGH：x"),
        ("a8", "F01", None, "AGG-TYPE-BUILDING-2-HIGH", None, "F01｜AGG-TYPE-BUILDING-5-LOW：x"),
        ("a9", None, ["F02"], None, [], ""),
    ]
    actions = s.createDataFrame(acts, "action_id string, finding_id string, finding_ids array<string>, evidence_id string, evidence_ids array<string>, reason string")
    given = I.ReportTables(
        products=r.products, reviews=r.reviews, questions=questions, excluded=r.products.select(F.concat(F.lit("e:"), "product_id").alias("row_id"), F.concat(F.lit("nowhere:"), "product_id").alias("source_id"), F.lit("OVER_LIMIT").alias("reason")),
        sources=sources, completeness=complete.withColumn("used_rows", off(F.col("product_id") == "MACHINERY", "used_rows", 1)), assessments=assessments,
        types=types.withColumn("position", off(F.col("type_id") == "3-MEDIUM", "position", 10)), topics=topics.where("topic_id <> 'q3'"),
        gaps=gaps.withColumn("default_count", off((F.col("product_id") == "FURNITURE") & (F.col("type_id") == "2-HIGH"), "default_count", 1)),
        topic_stats=stats.where("NOT (product_id = 'BUILDING' AND topic_id = 'q2')"), coverage=cover.withColumn("hit_count", off((F.col("product_id") == "HOUSEHOLD") & (F.col("dimension") == "scene"), "hit_count", 1)),
        readiness=ready.select("finding_id", F.when(F.col("finding_id") == "F02", "other").otherwise(F.col("status")).alias("status")), findings=f.unionByName(more), actions=actions,
    )
    return given, types, topics, catalog(s, DIMENSIONS, "dimension")


WHOLE = f"""SELECT 'DUPLICATE_ROW_ID' AS code, row_id AS object_id FROM reviews WHERE product_id = 'BUILDING' AND sort = 'default' AND rank = 1
  UNION ALL SELECT 'CATALOG_MISMATCH', unnest(['3-MEDIUM', 'q3'])
  UNION ALL SELECT 'UNKNOWN_MODEL_ROW', 'no:' || row_id FROM reviews WHERE sort = 'default' AND rank = 7 UNION ALL SELECT 'DUPLICATE_MODEL_ROW', row_id FROM reviews WHERE sort = 'default' AND rank = 5
  UNION ALL SELECT 'INVALID_TOP20_REVIEW', product_id FROM products UNION ALL SELECT 'INVALID_DIMENSION', row_id FROM reviews WHERE sort = 'default' AND rank = 3
  UNION ALL SELECT 'INVALID_TYPE_ID', row_id FROM reviews WHERE type_id = '1-URGENT'
  UNION ALL SELECT 'INVALID_TOPIC_ID', CASE WHEN product_id = 'MACHINERY' AND rank = (SELECT min(rank) FROM questions WHERE product_id = 'MACHINERY') THEN (SELECT row_id FROM reviews WHERE product_id = 'BUILDING' AND sort = 'default' AND rank = 1) ELSE row_id END FROM questions WHERE topic_id = 'q8'
  UNION ALL SELECT 'AGGREGATE_MISMATCH', unnest(['FURNITURE:2-HIGH', 'BUILDING:q2', 'HOUSEHOLD:scene'])
  UNION ALL SELECT 'COMPLETENESS_MISMATCH', 'DATA-MACHINERY-' || k FROM (VALUES ('default_reviews'), ('recent_reviews'), ('questions')) v(k)
  UNION ALL SELECT 'SOURCE_ANCHOR_MISMATCH', 'e:' || product_id FROM products UNION ALL SELECT 'MISSING_REQUIRED_SOURCE', 'HOUSEHOLD:questions'
  UNION ALL SELECT 'READINESS_MISMATCH', 'F02' UNION ALL SELECT 'DIAGNOSIS_MISMATCH', 'F01' UNION ALL SELECT 'CONFLICTING_FINDING_ID', '11' UNION ALL SELECT 'MISSING_FINDING_ID', '12' UNION ALL SELECT 'DUPLICATE_FINDING_ID', 'F03'
  UNION ALL SELECT 'UNKNOWN_EVIDENCE', 'AGG-NONE' UNION ALL SELECT 'INVALID_F03_EVIDENCE', evidence_id FROM gaps WHERE product_id = 'BUILDING' AND type_id <> '1-URGENT' UNION ALL SELECT 'UNKNOWN_EVIDENCE', 'AGG-TYPE-BUILDING-1-URGENT' FROM range(2)
  UNION ALL SELECT 'INELIGIBLE_COMPETITOR_EVIDENCE', evidence_id FROM tstat WHERE product_id = 'MACHINERY' AND topic_id <> 'q8' AND product_id NOT IN (SELECT product_id FROM elig WHERE questions >= 90) UNION ALL SELECT 'UNKNOWN_EVIDENCE', 'AGG-QUESTION-MACHINERY-q8'
  UNION ALL SELECT 'INVALID_FINDING_EVIDENCE', unnest(['F02', 'F03']) UNION ALL SELECT 'INVALID_FINDING_EVIDENCE', finding_id FROM ready WHERE finding_id = 'F01' AND status = 'unavailable'
  UNION ALL SELECT v.code, v.id FROM (VALUES ('CONFLICTING_ACTION_REFERENCE', 'a1'), ('MISSING_ACTION_FINDING', 'a2'), ('MISSING_ACTION_EVIDENCE', 'a3'), ('UNKNOWN_FINDING', 'a4'), ('UNKNOWN_EVIDENCE', 'a5'), ('EVIDENCE_NOT_IN_FINDING', 'a6'),
    ('REASON_FINDING_MISMATCH', 'a7'), ('REASON_EVIDENCE_MISMATCH', 'a8'), ('MISSING_ACTION_EVIDENCE', 'a9'), ('TOO_MANY_ACTIONS', '9'), ('DUPLICATE_FINDING_ACTION', 'F01')) v(code, id)"""


@query("validate_report", f"WITH {RQ.DOMAIN}, {RQ.GAPS}, {RQ.TSTAT} {WHOLE}")
def _(s, d):
    return I.validate_report(*tables_of(Report(s, d)))


# Report tables: all columns of the six tables. Columns that the benchmark tables lack are filled by rule.


def full_reviews(r):
    b = F.lit("")
    date = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), F.col("rank")), "yyyy-MM-dd")
    return r.reviews.select(
        "product_id", "sort", "rank", "source_id", (F.col("rank") + 1).alias("source_row"), "row_id", date.alias("date"), F.concat(F.lit("=sku "), "rank").alias("sku"), F.concat(F.lit("text of "), "row_id").alias("initial_text"),
        b.alias("followup_text"), "type_id", F.lit("initial").alias("evidence_source"), F.when(F.col("rank") % 2 == 0, F.concat(F.lit("quote "), "rank")).alias("evidence_quote"),
    )


REVIEW_ROWS = f"""SELECT r.product_id, sort, rank, source_id, CAST(rank + 1 AS INTEGER) AS source_row, row_id, strftime(DATE '2024-01-01' + CAST(rank AS INTEGER), '%Y-%m-%d') AS date, chr(39) || '=sku ' || rank AS sku, 'text of ' || row_id AS initial_text, '' AS followup_text,
  r.type_id, r.type_id AS type_name, CASE WHEN rank % 2 = 0 THEN 'initial：quote ' || rank ELSE '' END AS type_evidence, g.default_count, {P1('g.default_share')} AS default_share, g.recent_count, {P1('g.recent_share')} AS recent_share,
  {P1('g.difference')} AS difference, evidence_id FROM reviews r LEFT JOIN gaps g ON g.product_id = r.product_id AND g.type_id = r.type_id"""


@query("report_tables_reviews", f"WITH {RO}, {TYP}, {RQ.GAPS} {REVIEW_ROWS}")
def _(s, d):
    r = Report(s, d)
    return R.reviews_table(full_reviews(r), r.gaps)


@query("detail_with_aggregate", f"WITH {RO}, {TYP}, {RQ.GAPS} SELECT r.row_id, g.evidence_id, g.default_count, g.recent_count, g.difference FROM reviews r LEFT JOIN gaps g ON g.product_id = r.product_id AND g.type_id = r.type_id")
def _(s, d):
    r = Report(s, d)
    return r.reviews.join(r.gaps.hint("merge"), ["product_id", "type_id"], "left").select("row_id", "evidence_id", "default_count", "recent_count", "difference")


@query("report_tables_dimensions", f"WITH {RO}, {AS}, {RQ.COVER} SELECT a.product_id, review_id AS row_id, a.product_id || ':default_reviews' AS source_id, CAST(rank + 1 AS INTEGER) AS source_row, CAST(rank AS INTEGER) AS rank, CAST(count(*) FILTER (present) OVER (PARTITION BY review_id) AS INTEGER) AS score, a.dimension, present, CASE WHEN present THEN a.dimension || ':' || review_id ELSE '' END AS evidence, hit_count, total_count, {P1('coverage')} AS coverage, evidence_id FROM assessed a LEFT JOIN cover c ON c.product_id = a.product_id AND c.dimension = a.dimension")
def _(s, d):
    r = Report(s, d)
    return R.dimensions_table(r.assessments, full_reviews(r), r.coverage)


@query("report_tables_questions", f"WITH {RQ.DOMAIN}, {RQ.TSTAT} SELECT q.product_id, rank, q.product_id || ':questions' AS source_id, CAST(rank + 1 AS INTEGER) AS source_row, row_id, '' AS date, question, answer, q.topic_id, {named('q.topic_id', TOPICS)} AS topic_name, left(question, 5) AS topic_evidence, count, {P1('share')} AS share, array_to_string(representative_ids, '、') AS representatives, evidence_id FROM questions q LEFT JOIN tstat t ON t.product_id = q.product_id AND t.topic_id = q.topic_id")
def _(s, d):
    r = Report(s, d)
    q = r.questions.withColumns({"source_row": F.col("rank") + 1, "date": F.lit(""), "topic_evidence": F.left("question", F.lit(5))})
    return R.questions_table(q, r.topics)


METRICS = f"""(SELECT type_id FROM gaps WHERE product_id = 'BUILDING' ORDER BY abs(difference) DESC, type_id LIMIT 1) AS f01_type, (SELECT {P1('abs(difference)', 'pp')} FROM gaps WHERE product_id = 'BUILDING' ORDER BY abs(difference) DESC, type_id LIMIT 1) AS f01_difference"""


def metrics(r):
    return R.report_metrics(r.findings, r.actions, r.reviews, r.questions, r.gaps, r.own)


@query("report_metrics", f"WITH {ACTED} SELECT (SELECT count(*) FROM findings) AS finding_count, (SELECT count(*) FROM actions) AS action_count, (SELECT count(*) FROM reviews) AS used_reviews, (SELECT count(*) FROM questions) AS used_questions, {METRICS}")
def _(s, d):
    return metrics(Report(s, d))


query("used_rows", f"WITH {RQ.DOMAIN} SELECT source_id, count(*) AS rows FROM (SELECT source_id FROM reviews UNION ALL SELECT product_id || ':questions' FROM questions) GROUP BY 1")(lambda s, d: (lambda r: R.used_rows(r.reviews, r.questions))(Report(s, d)))


@query("report_tables_findings", f"WITH {FOUND}, {DETAILED}, t AS ({TITLED}), m AS (SELECT {METRICS}) SELECT f.finding_id, status, has_problem, CASE WHEN has_problem THEN f.finding_id || '_PROBLEM' ELSE '' END AS problem_code, title, detail, array_to_string(evidence_ids, '、') AS evidence, CASE WHEN f.finding_id = 'F01' THEN f01_type ELSE '' END AS f01_type, CASE WHEN f.finding_id = 'F01' THEN f01_difference ELSE '' END AS f01_difference FROM detailed f JOIN t ON t.finding_id = f.finding_id AND outcome = CASE WHEN status = 'unavailable' THEN status WHEN has_problem THEN 'problem' ELSE 'none' END, m")
def _(s, d):
    r = Report(s, d)
    return R.findings_table(told(r), metrics(r))


def told(r):
    return FN.finding_titles(detailed(r)).withColumn("problem_code", F.when(F.col("has_problem"), F.concat("finding_id", F.lit("_PROBLEM"))).otherwise(""))


query("report_tables_actions", f"WITH {ACTED} SELECT action_id, priority, action, reason, array_to_string(finding_ids, '、') AS findings, array_to_string(evidence_ids, '、') AS evidence FROM actions")(lambda s, d: R.actions_table(Report(s, d).actions))


@query("report_json", f"""WITH {ACTED} SELECT 'products' AS part, product_id AS key, '{{"productId":"' || product_id || '","role":"' || role || '"}}' AS entry FROM products
  UNION ALL SELECT 'taxonomy', product_id || ':' || type_id, '{{"productId":"' || product_id || '","typeId":"' || type_id || '","defaultCount":' || default_count || ',"recentCount":' || recent_count || ',"evidenceId":"' || evidence_id || '"}}' FROM gaps
  UNION ALL SELECT 'dimensions', product_id || ':' || dimension, '{{"productId":"' || product_id || '","dimension":"' || dimension || '","hitCount":' || hit_count || ',"totalCount":' || total_count || ',"evidenceId":"' || evidence_id || '"}}' FROM cover
  UNION ALL SELECT 'topics', product_id || ':' || topic_id, '{{"productId":"' || product_id || '","topicId":"' || topic_id || '","count":' || count || ',"representativeQuestionIds":[' || CASE WHEN len(representative_ids) = 0 THEN '' ELSE '"' || array_to_string(representative_ids, '","') || '"' END || ']}}' FROM tstat
  UNION ALL SELECT 'findings', finding_id, '{{"findingId":"' || finding_id || '","status":"' || status || '","evidenceIds":["' || array_to_string(evidence_ids, '","') || '"]}}' FROM findings
  UNION ALL SELECT 'actions', action_id, '{{"actionId":"' || action_id || '","priority":"' || priority || '","action":"' || action || '","reason":"' || reason || '"}}' FROM actions
  UNION ALL SELECT 'questions', row_id, '{{"productId":"' || product_id || '"}}' FROM questions""")
def _(s, d):
    r = Report(s, d)
    parts = {
        "products": (r.products, {"productId": "product_id", "role": "role"}, ["product_id"]),
        "taxonomy": (r.gaps, {"productId": "product_id", "typeId": "type_id", "defaultCount": "default_count", "recentCount": "recent_count", "evidenceId": "evidence_id"}, ["product_id", "type_id"]),
        "dimensions": (r.coverage, {"productId": "product_id", "dimension": "dimension", "hitCount": "hit_count", "totalCount": "total_count", "evidenceId": "evidence_id"}, ["product_id", "dimension"]),
        "topics": (r.topics, {"productId": "product_id", "topicId": "topic_id", "count": "count", "representativeQuestionIds": "representative_ids"}, ["product_id", "topic_id"]),
        "findings": (r.findings, {"findingId": "finding_id", "status": "status", "evidenceIds": "evidence_ids"}, ["finding_id"]),
        "actions": (r.actions, {"actionId": "action_id", "priority": "priority", "action": "action", "reason": "reason"}, ["action_id"]),
        "questions": (r.questions, {"productId": "product_id"}, ["row_id"]),
    }
    return R.report_document({k: v[:2] for k, v in parts.items()}, {k: v[2] for k, v in parts.items()})


ENTRIES = {
    "meta": "SELECT 'report' AS key, 'readyRows' AS field, '90' AS text, 90.0 AS number UNION ALL SELECT 'report', 'sourceCap', '100', 100.0",
    "products": "SELECT product_id, unnest(['productId', 'role', 'name']), unnest([product_id, role, upper(product_id[1]) || lower(product_id[2:])]), unnest([NULL, NULL, NULL]::DOUBLE[]) FROM products",
    "completeness": "SELECT 'DATA-' || product_id || '-' || kind, unnest(['evidenceId', 'productId', 'kind', 'expectedRows', 'validRows', 'usedRows', 'excludedOverLimit', 'status', 'blocking']), unnest(['DATA-' || product_id || '-' || kind, product_id, role || '_' || kind, '', '', '', '', status, CASE WHEN used_rows < 90 THEN 'true' ELSE 'false' END]), unnest([NULL, NULL, NULL, 100, used_rows, used_rows, 0, NULL, NULL]::DOUBLE[]) FROM sources JOIN products USING (product_id)",
    "typeCatalog": "SELECT type_id, unnest(['id', 'name']), unnest([type_id, type_id]), unnest([NULL, NULL]::DOUBLE[]) FROM types",
    "topicCatalog": f"SELECT topic_id, unnest(['id', 'name']), unnest([topic_id, {named('topic_id', TOPICS)}]), unnest([NULL, NULL]::DOUBLE[]) FROM topics",
    "taxonomy": "SELECT product_id || ':' || type_id, unnest(['productId', 'typeId', 'defaultCount', 'defaultShare', 'recentCount', 'recentShare', 'difference', 'evidenceId']), unnest([product_id, type_id, '', '', '', '', '', evidence_id]), unnest([NULL, NULL, default_count, default_share, recent_count, recent_share, difference, NULL]::DOUBLE[]) FROM gaps",
    "dimensions": "SELECT product_id || ':' || dimension, unnest(['productId', 'dimension', 'hitCount', 'totalCount', 'coverage', 'evidenceId']), unnest([product_id, dimension, '', '', '', evidence_id]), unnest([NULL, NULL, hit_count, total_count, coverage, NULL]::DOUBLE[]) FROM cover",
    "topics": "SELECT product_id || ':' || topic_id, unnest(['productId', 'topicId', 'count', 'share', 'representativeQuestionIds', 'evidenceId']), unnest([product_id, topic_id, '', '', array_to_string(representative_ids, ','), evidence_id]), unnest([NULL, NULL, count, share, NULL, NULL]::DOUBLE[]) FROM tstat",
    "findings": "SELECT f.finding_id, unnest(['findingId', 'status', 'title', 'detail', 'evidenceIds']), unnest([f.finding_id, status, title, detail, array_to_string(evidence_ids, ',')]), unnest([NULL, NULL, NULL, NULL, NULL]::DOUBLE[]) FROM detailed f JOIN t ON t.finding_id = f.finding_id AND outcome = CASE WHEN status = 'unavailable' THEN status WHEN has_problem THEN 'problem' ELSE 'none' END",
    "actions": "SELECT action_id, unnest(['actionId', 'priority', 'action', 'reason', 'findingIds', 'evidenceIds']), unnest([action_id, priority, action, reason, array_to_string(finding_ids, ','), array_to_string(evidence_ids, ',')]), unnest([NULL, NULL, NULL, NULL, NULL, NULL]::DOUBLE[]) FROM actions",
    "questions": "SELECT row_id, 'productId', product_id, NULL FROM questions",
    "reviewTags": "SELECT product_id || ':' || name, unnest(['sourceId', 'productId', 'name', 'count']), unnest([product_id || ':review_tags', product_id, name, '']), unnest([NULL, NULL, NULL, count]::DOUBLE[]) FROM (SELECT lang AS product_id, source AS name, sum(n_chars) AS count FROM documents GROUP BY ALL)",
    "errors": "SELECT finding_id, unnest(['code', 'message']), unnest(['SYNTHESIS_EVIDENCE_REJECTED', finding_id]), unnest([NULL, NULL]::DOUBLE[]) FROM findings WHERE finding_id <> 'F01'",
    "warnings": "SELECT product_id || ':' || name, unnest(['code', 'message']), unnest(['TAG', product_id || ':' || name]), unnest([NULL, NULL]::DOUBLE[]) FROM (SELECT DISTINCT lang AS product_id, source AS name FROM documents)",
    "excludedRows": "SELECT source_id || ':' || row_no, unnest(['rowId', 'sourceId', 'reason']), unnest([source_id || ':' || row_no, source_id, reason]), unnest([NULL, NULL, NULL]::DOUBLE[]) FROM judged WHERE reason <> 'USED'",
}


def whole_report(s, d):
    """Every part of a report's document with all of its fields: (part, key, field, text, number)."""
    r = Report(s, d)
    tags = R.tag_totals(s.createDataFrame([], "product_id string, completeness string"), B.table(s, d, "documents").select(F.col("lang").alias("product_id"), F.col("source").alias("name"), F.col("n_chars").alias("count")))[0]
    tags = tags.withColumn("source_id", F.concat("product_id", F.lit(":review_tags")))
    excluded = RQ.judged(s, d).where("reason <> 'USED'").select(F.concat_ws(":", "source_id", "row_no").alias("row_id"), "source_id", "reason")
    warnings = tags.select(F.lit("TAG").alias("code"), F.concat_ws(":", "product_id", "name").alias("message"))
    types = r.types.withColumn("name", F.col("type_id"))
    parts = R.report_parts(
        meta=s.createDataFrame([("report", 90, 100)], "key string, ready_rows int, source_cap int"), products=r.products, completeness=r.completeness, types=types, topics=catalog(s, TOPICS, "topic_id"), gaps=r.gaps, coverage=r.coverage,
        topic_stats=r.topics, findings=told(r), actions=r.actions, questions=r.questions, tags=tags, errors=proposed(r)[1].select("code", F.col("finding_id").alias("message")), warnings=warnings, excluded=excluded,
    )
    return R.report_fields(R.report_document({k: v[:2] for k, v in parts.items()}, {k: v[2] for k, v in parts.items()}))


query("report_document", f"WITH {ACTED}, {RQ.SOURCES}, {DETAILED}, t AS ({TITLED}), {B.GRID_DOCS} " + " UNION ALL ".join(f"SELECT '{part}' AS part, CAST(key AS VARCHAR) AS key, field, text, number FROM ({sql}) x(key, field, text, number)" for part, sql in ENTRIES.items()))(whole_report)


def notes(s, d):
    title = T.strip(F.when(F.col("event_id") % 5 == 0, "  ").otherwise(F.concat(F.lit(" "), "event_type", F.lit(" "))))
    return B.table(s, d, "events").select(F.col("event_id").alias("note_id"), "ts", title.alias("title"), F.when(F.col("event_id") % 3 == 0, F.col("event_type")).alias("content"))


query("scan_recent_notes", "SELECT event_id AS note_id, ts, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 20")(lambda s, d: R.recent_notes(B.table(s, d, "events").select(F.col("event_id").alias("note_id"), "ts", "event_type")))


@query("append_note", "SELECT event_id AS note_id, ts, event_type AS title, CASE WHEN event_id % 3 = 0 THEN event_type ELSE '' END AS content FROM events WHERE event_id % 5 <> 0")
def _(s, d):
    """Notes appended in two goes, and read back."""
    path, n = scratch_path(s), notes(s, d)
    R.append_notes(n.where("note_id % 2 = 0"), path)
    return R.append_notes(n.where("note_id % 2 = 1"), path)


TAGS = "tags AS (SELECT lang AS product_id, source AS name, CASE WHEN doc_id % 9 <> 0 THEN n_chars END AS count, doc_id FROM documents)"


def tagged(s, d):
    """Screenshots' results: a document's source is a tag of its language, its characters the count, which each ninth lacks."""
    t = B.table(s, d, "documents").select(F.col("lang").alias("product_id"), F.array(F.struct(F.col("source").alias("name"), F.when(F.col("doc_id") % 9 != 0, F.col("n_chars")).alias("count"))).alias("tags"))
    results = s.createDataFrame([("en", "complete"), ("de", "partial"), ("fr", "unavailable"), ("es", "complete")], "product_id string, completeness string")
    return R.tag_totals(results, R.flatten_tags(t))


query("review_tag_totals", f"WITH {TAGS} SELECT product_id, name, CAST(sum(count) AS BIGINT) AS count FROM tags WHERE count IS NOT NULL GROUP BY ALL ORDER BY product_id, name")(lambda s, d: tagged(s, d)[0])
query("order_tags", f"WITH {TAGS} SELECT product_id, name, row_number() OVER (PARTITION BY product_id ORDER BY name) AS n FROM (SELECT DISTINCT product_id, name FROM tags WHERE count IS NOT NULL)")(
    lambda s, d: tagged(s, d)[0].select("product_id", "name", F.row_number().over(Window.partitionBy("product_id").orderBy("name")).cast("long").alias("n"))
)


def named_by_words(s, d):
    """Tags named by the first word of each document, as it is written: capitals, accents and marks."""
    word = F.regexp_extract("text", r"([^\s]+)", 1)
    t = B.table(s, d, "documents").select(F.col("lang").alias("product_id"), word.alias("name"), F.col("n_chars").alias("count"))
    return R.tag_totals(s.createDataFrame([], "product_id string, completeness string"), t, "UNICODE")[0]


WORDS = "words AS (SELECT lang AS product_id, regexp_extract(text, '([^\\s]+)', 1) AS name, CAST(sum(n_chars) AS BIGINT) AS count FROM documents GROUP BY ALL)"
query("order_tags_by_locale", f"WITH {WORDS} SELECT product_id, name, count, row_number() OVER (PARTITION BY product_id ORDER BY name COLLATE en, name) AS n FROM words")(
    lambda s, d: numbered(named_by_words(s, d).withColumn("_name", F.collate("name", "UNICODE")), ["product_id"], ["_name", "name"]).select("product_id", "name", "count", "n")
)


@query("top_words_by_locale", f"WITH {WORDS} SELECT product_id, topic_id, share FROM (SELECT product_id, name AS topic_id, 0.5::DOUBLE AS share FROM words) QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY share DESC, topic_id COLLATE en, topic_id) = 1")
def _(s, d):
    """The first word of each language where all have the same share: the order of the locale decides."""
    t = named_by_words(s, d).select("product_id", F.col("name").alias("topic_id"), F.lit(0.5).alias("share"))
    return A.top_topic_per_product(t, t.select("product_id").distinct(), "UNICODE").select("product_id", "topic_id", "share")


query("tag_warnings", f"WITH {TAGS} SELECT 'SCREENSHOT_TAG_COUNT_UNAVAILABLE' AS code, product_id, name FROM tags WHERE count IS NULL UNION ALL SELECT 'SCREENSHOT_METADATA_PARTIAL', 'de', '' UNION ALL SELECT 'SCREENSHOT_METADATA_UNAVAILABLE', 'fr', ''")(lambda s, d: tagged(s, d)[1])
query("long_cells", "SELECT 'CELL_TOO_LONG' AS code, doc_id || ':text' AS object_id FROM documents WHERE length(text) + len(regexp_extract_all(text, '[\\x{10000}-\\x{10FFFF}]')) > 5000")(lambda s, d: R.long_cells(B.table(s, d, "documents"), "doc_id", ["text", "source"], 5000))

# Cells.

def cells(name, sql, column):
    query(name, f"SELECT event_id, {sql} AS cell FROM events")(lambda s, d: B.table(s, d, "events").select("event_id", column().alias("cell")))


cells("percent1", P1("(CAST(event_id % 4001 AS DOUBLE) - 1000) / 2000"), lambda: T.percent1((F.col("event_id") % 4001 - 1000).cast("double") / 2000))
cells("safe_cell", "CASE WHEN event_id % 2 = 0 THEN chr(39) || '  =' || event_type ELSE event_type END", lambda: T.safe_cell(F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("  ="), "event_type")).otherwise(F.col("event_type"))))
cells("clean_xml_text", "event_type || chr(65533) || 'x'", lambda: T.clean_xml_text(F.concat("event_type", F.lit("\x01x"))))
cells("cell_length_check", "CAST(2 + length(event_type) AS INTEGER)", lambda: T.cell_units(F.concat(F.lit("\U0001F600"), "event_type")))
cells("sanitize_text", "substr(event_type || ' a', 1, 6)", lambda: T.sanitize_text(F.concat(F.lit("\x00 "), "event_type", F.lit("\t\x01 a ")), 6))
cells("text_value", "CASE WHEN event_id % 3 = 0 THEN '' ELSE event_type END", lambda: T.text_value(F.when(F.col("event_id") % 3 == 0, None).otherwise(F.concat(F.lit("　"), "event_type", F.lit(" ")))))
cells("date_value", "strftime(ts, '%Y-%m-%d')", lambda: T.date_value(F.col("ts")))
cells("normalize_header", "'SKU' || event_type", lambda: T.normalize_header(F.concat(F.lit(" ＳＫＵ"), "event_type", F.lit("　"))))
cells("beijing_minute", "CASE WHEN event_id % 4 = 0 THEN '时间未知' ELSE strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M') || '（北京时间）' END", lambda: T.beijing_minute(F.when(F.col("event_id") % 4 == 0, "x").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))))
STATUS = f"CASE event_id % 7 {' '.join(f'WHEN {i} THEN $${v}$$' for i, v in enumerate(STATUS_LABELS.values()))} ELSE 'x' END"
cells("label_names", STATUS, lambda: T.label_name(F.element_at(F.array(*[F.lit(k) for k in [*STATUS_LABELS, "x"]]), (F.col("event_id") % 7 + 1).cast("int")), STATUS_LABELS))
KIND = f"CASE event_id % 4 {' '.join(f'WHEN {i} THEN $${v}$$' for i, v in enumerate(KIND_LABELS.values()))} END"
cells("catalog_lookup", KIND, lambda: T.label_name(F.element_at(F.array(*[F.lit(k) for k in KIND_LABELS]), (F.col("event_id") % 4 + 1).cast("int")), KIND_LABELS))


# The completeness table.


@query("report_tables", f"WITH {RQ.DENSE} SELECT p.product_id, upper(p.product_id[1]) || lower(p.product_id[2:]) AS product, role, role || '_' || kind AS kind, source_id, kind || ' list' AS note, 100 AS expected_rows, used_rows AS valid_rows, used_rows, CAST(0 AS BIGINT) AS excluded_over_limit, status, used_rows < 90 AS blocking, 'DATA-' || p.product_id || '-' || kind AS evidence_id FROM sources s JOIN products p ON p.product_id = s.product_id")
def _(s, d):
    r = Report(s, d)
    return R.completeness_table(r.completeness, r.products, r.sources.withColumn("note", F.concat("kind", F.lit(" list"))))


@query("source_anchor_check", f"WITH {RQ.DOMAIN} SELECT 'SOURCE_ANCHOR_MISMATCH' AS code, row_id AS object_id FROM reviews WHERE o_orderkey % 41 = 0 UNION ALL SELECT 'SOURCE_ANCHOR_MISMATCH', row_id FROM questions WHERE rank % 10 = 0 UNION ALL SELECT 'SOURCE_ANCHOR_MISMATCH', 'MACHINERY:questions'")
def _(s, d):
    r = Report(s, d)
    moved = r.reviews.withColumn("source_id", F.when(F.col("o_orderkey") % 41 == 0, F.concat("product_id", F.lit(":questions"))).otherwise(F.col("source_id")))
    asked = r.questions.withColumn("source_id", F.when(F.col("rank") % 10 == 0, F.lit("nowhere")).otherwise(F.col("source_id")))
    sources = r.sources.union(r.sources.where("source_id = 'MACHINERY:questions'"))
    return I.anchor_checks(moved, asked, r.reviews.limit(0).select("row_id", "source_id"), sources)
