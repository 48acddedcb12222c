"""Integrity checks: each gives the objects that break a rule as (code, object_id)."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.text import extract_refs, is_blank
from larkspur.operators.aggregates import dimension_coverage, problem_flags, readiness, topic_stats, type_share_gap
from larkspur.operators.joins import join_written, small
from larkspur.operators.validate_rows import completeness, status_of
from larkspur.plans.spill import written
from larkspur.schemas import FINDINGS


def _hit(rows: DataFrame, code: str, object_id) -> DataFrame:
    return rows.select(F.lit(code).alias("code"), (F.col(object_id) if isinstance(object_id, str) else object_id).cast("string").alias("object_id"))


def repeated(rows: DataFrame, key: str, code: str) -> DataFrame:
    """Keys that occur more than once."""
    return _hit(rows.groupBy(key).agg(F.count(F.lit(1)).alias("_times")).where("_times > 1"), code, key)


def unknown(rows: DataFrame, known: DataFrame, on: list[str], code: str, object_id) -> DataFrame:
    """Rows that the known ones do not have; not shuffled where those are few."""
    return _hit(join_written(rows, known.select(*on).distinct(), on, "left_anti"), code, object_id)


def where(rows: DataFrame, condition: Column, code: str, object_id) -> DataFrame:
    return _hit(rows.where(condition), code, object_id)


def ids_equal(left: Column, right: Column) -> Column:
    """Whether two lists hold the same ids, whatever their order and repeats."""
    return F.array_sort(F.array_distinct(left)) == F.array_sort(F.array_distinct(right))


def reconcile(actual: DataFrame, expected: DataFrame, key: list[str]) -> DataFrame:
    """(key..., fault): rows that are missing, extra, repeated or differ in any other column. Nulls equal nulls."""
    others = [c for c in expected.columns if c not in key]
    many = actual.groupBy(*key).agg(F.count(F.lit(1)).alias("times"), F.first(F.struct(*others)).alias("a"))
    both = many.join(expected.select(*key, F.struct(*others).alias("e")), key, "full_outer")
    differs = reduce(lambda x, c: x | ~F.col(f"a.{c}").eqNullSafe(F.col(f"e.{c}")), others, F.lit(False))
    fault = F.when(F.col("times").isNull(), "MISSING").when(F.col("e").isNull(), "EXTRA").when(F.col("times") > 1, "REPEATED").when(differs, "DIFFERENT")
    return both.select(*key, fault.alias("fault")).where("fault IS NOT NULL")


def catalog_reconcile(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """Rows of either catalog that the other has not, place included."""
    side = lambda a, b, name: a.exceptAll(b).withColumn("side", F.lit(name))
    return side(actual, expected, "extra").unionByName(side(expected, actual, "missing"))


def evidence_union(*families: DataFrame) -> DataFrame:
    """All evidence ids, each once."""
    return reduce(DataFrame.unionByName, [f.select("evidence_id") for f in families]).distinct()


def invalid_top(assessments: DataFrame, reviews: DataFrame, top: int) -> DataFrame:
    """Assessments of rows that are no first default rows, and products whose number of assessments is wrong."""
    r = reviews.select(F.col("row_id").alias("review_id"), "product_id", "sort", F.col("rank").alias("row_rank"))
    x = assessments.select("review_id").join(r, "review_id")
    rows = _hit(x.where((F.col("sort") != "default") | ~F.col("row_rank").between(1, top)), "INVALID_TOP20_REVIEW", "review_id")
    due = reviews.groupBy("product_id").agg(F.when(F.count_if(F.col("sort") == "default") >= top, top).otherwise(0).alias("due"))
    n = x.groupBy("product_id").agg(F.count(F.lit(1)).alias("n"))
    return rows.union(_hit(due.join(n, "product_id", "left").where(F.coalesce("n", F.lit(0)) != F.col("due")), "INVALID_TOP20_REVIEW", "product_id"))


def invalid_dimension(assessments: DataFrame, dimensions) -> DataFrame:
    return _hit(assessments.where(F.exists("dimensions", lambda d: ~d["dimension"].isin(*dimensions))), "INVALID_DIMENSION", "review_id")


def source_anchor(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows whose source is not one of their product and kind."""
    return unknown(rows, sources, ["source_id", "product_id", "kind"], "SOURCE_ANCHOR_MISMATCH", "row_id")


def missing_required(products: DataFrame, kinds: DataFrame, sources: DataFrame) -> DataFrame:
    """Products that do not have exactly one source of a kind."""
    n = sources.groupBy("product_id", "kind").agg(F.count(F.lit(1)).alias("n"))
    dense = products.select("product_id").crossJoin(small(kinds)).join(n, ["product_id", "kind"], "left")
    return _hit(dense.where(F.coalesce("n", F.lit(0)) != 1), "MISSING_REQUIRED_SOURCE", F.concat_ws(":", "product_id", "kind"))


def finding_evidence(findings: DataFrame, evidence: DataFrame, own: DataFrame, eligible: DataFrame) -> DataFrame:
    """Findings whose evidence is unknown, of the wrong family, of a product that is not compared, or not own where it must be.

    evidence: (evidence_id, family, product_id), family type, dimension, question or data.
    """
    x = findings.select("finding_id", "status", F.explode_outer("evidence_ids").alias("evidence_id")).join(evidence.hint("merge"), "evidence_id", "left")
    x = x.join(own.select("product_id", F.lit(True).alias("own")).hint("merge"), "product_id", "left").join(eligible.select("product_id", F.lit(True).alias("compared")).hint("merge"), "product_id", "left")
    f3 = F.col("finding_id") == "F03"
    family = F.col("family")
    bad = [
        where(x, F.col("evidence_id").isNotNull() & family.isNull(), "UNKNOWN_EVIDENCE", "evidence_id"),
        where(x, f3 & family.isin("type", "dimension"), "INVALID_F03_EVIDENCE", "evidence_id"),
        where(x, f3 & (family == "question") & F.col("compared").isNull(), "INELIGIBLE_COMPETITOR_EVIDENCE", "evidence_id"),
    ]
    due = F.when(F.col("finding_id") == "F01", "type").when(F.col("finding_id") == "F02", "dimension").otherwise("question")
    g = x.groupBy("finding_id", "status").agg(
        F.coalesce(F.bool_and(family == "data"), F.lit(False)).alias("all_data"), F.coalesce(F.bool_or(family == due), F.lit(False)).alias("has_due"),
        F.coalesce(F.bool_or((family == "question") & F.col("own")), F.lit(False)).alias("has_own"),
    )
    wrong = F.when(F.col("status") == "unavailable", ~F.col("all_data")).otherwise(~F.col("has_due") | (f3 & ~F.col("has_own")))
    return reduce(DataFrame.union, [*bad, where(g, wrong, "INVALID_FINDING_EVIDENCE", "finding_id")])


def references(actions: DataFrame) -> DataFrame:
    """Actions with finding_ids and evidence_ids as they count: the list if there is one, else the single id beside it; and
    ``conflicts``, how many of the two pairs disagree. The single ids are columns finding_id and evidence_id, if there are any."""
    x = actions.withColumn("conflicts", F.lit(0))
    none = F.array().cast("array<string>")
    for many, one in (("finding_ids", "finding_id"), ("evidence_ids", "evidence_id")):
        single = F.col(one) if one in actions.columns else F.lit(None).cast("string")
        alone = F.when(single.isNotNull(), F.array(single)).otherwise(none)
        differ = single.isNotNull() & F.col(many).isNotNull() & ~ids_equal(alone, F.col(many))
        x = x.withColumn("conflicts", F.col("conflicts") + F.coalesce(differ, F.lit(False)).cast("int")).withColumn(many, F.coalesce(many, alone))
    return x


def action_checks(actions: DataFrame, findings: DataFrame, evidence: DataFrame, most: int = 8) -> DataFrame:
    """Faults of actions: too many, repeated findings, single and plural ids that disagree, missing references; then the first of
    unknown findings, unknown evidence and evidence of no cited finding; else reasons that name other ids.

    actions: action_id, finding_ids, evidence_ids, reason and perhaps finding_id and evidence_id.
    """
    actions = references(actions)
    f = findings.select("finding_id", F.col("evidence_ids").alias("found"))
    each = actions.select("action_id", F.explode_outer("finding_ids").alias("finding_id")).join(f.hint("merge"), "finding_id", "left")
    per = each.groupBy("action_id").agg(
        F.count_if(F.col("finding_id").isNotNull() & F.col("found").isNull()).alias("unknown_findings"), F.array_distinct(F.flatten(F.collect_list(F.coalesce("found", F.array().cast("array<string>"))))).alias("allowed")
    )
    known = actions.select("action_id", F.explode_outer("evidence_ids").alias("evidence_id")).join(evidence.select("evidence_id", F.lit(True).alias("known")).distinct().hint("merge"), "evidence_id", "left")
    per_known = known.groupBy("action_id").agg(F.count_if(F.col("evidence_id").isNotNull() & F.col("known").isNull()).alias("unknown_evidence"))
    x = actions.join(per.hint("merge"), "action_id").join(per_known.hint("merge"), "action_id")
    no_finding, no_evidence = F.size("finding_ids") == 0, F.size("evidence_ids") == 0
    cited = F.when(F.col("unknown_findings") > 0, "UNKNOWN_FINDING").when(F.col("unknown_evidence") > 0, "UNKNOWN_EVIDENCE").when(F.size(F.array_except("evidence_ids", "allowed")) > 0, "EVIDENCE_NOT_IN_FINDING")
    reasoned = F.array(
        F.when(~ids_equal(extract_refs(F.col("reason"), "finding"), F.col("finding_ids")), "REASON_FINDING_MISMATCH"),
        F.when(~ids_equal(extract_refs(F.col("reason"), "evidence"), F.col("evidence_ids")), "REASON_EVIDENCE_MISMATCH"),
    )
    late = F.when(no_finding | no_evidence, F.array().cast("array<string>")).when(cited.isNotNull(), F.array(cited)).otherwise(reasoned)
    early = F.concat(F.array_repeat(F.lit("CONFLICTING_ACTION_REFERENCE"), F.col("conflicts")), F.array(F.when(no_finding, "MISSING_ACTION_FINDING"), F.when(no_evidence, "MISSING_ACTION_EVIDENCE")))
    faults = x.select(F.explode(F.array_compact(F.concat(early, late))).alias("code"), F.col("action_id").alias("object_id"))
    many = actions.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)
    twice = actions.select(F.explode(F.array_distinct("finding_ids")).alias("finding_id"))
    return reduce(DataFrame.union, [faults, _hit(many, "TOO_MANY_ACTIONS", "n"), repeated(twice, "finding_id", "DUPLICATE_FINDING_ACTION")])


def catalog_checks(given: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """Entries of a catalog (key, name, position) that lack, are too many or differ."""
    return _hit(reconcile(given, expected, [key]), "CATALOG_MISMATCH", key)


def validate_facts(products: DataFrame, evidence: DataFrame, proposals: DataFrame, findings) -> DataFrame:
    """(code, object_id) of facts and proposals that cannot be used: repeated products, no own one, evidence of unknown products or
    given twice; proposals of other or repeated findings, or with evidence that there is not.

    products: product_id, role; evidence: evidence_id, product_id; proposals: finding_id, evidence_ids; findings: the ids there may be.
    """
    own = products.agg(F.count_if(F.col("role") == "self").alias("n")).where("n = 0")
    cited = proposals.select(F.explode("evidence_ids").alias("evidence_id")).distinct()
    return reduce(DataFrame.union, [
        repeated(products, "product_id", "REPEATED_PRODUCT"), _hit(own, "NO_OWN_PRODUCT", F.lit("products")), unknown(evidence, products, ["product_id"], "UNKNOWN_PRODUCT", "evidence_id"),
        repeated(evidence, "evidence_id", "REPEATED_EVIDENCE"), unknown(cited, evidence, ["evidence_id"], "UNKNOWN_EVIDENCE", "evidence_id"),
        where(proposals, ~F.col("finding_id").isin(*findings), "UNKNOWN_FINDING", "finding_id"), repeated(proposals, "finding_id", "REPEATED_FINDING"),
    ])


def validate_synthesis(readiness: DataFrame, readiness_edges: DataFrame, proposals: DataFrame, proposal_edges: DataFrame, evidence: DataFrame, findings=FINDINGS) -> DataFrame:
    """(code, object_id) of a synthesis that cannot be used: of its readiness table, then of what is proposed.

    readiness: finding_id, status, reason; proposals: finding_id, status; both with their evidence as edges (finding_id,
    evidence_id); evidence: evidence_id, product_id. Each finding has readiness once, with a reason and with evidence, none of it
    twice or unknown; ids are not blank. Each has a proposal once, with the status of its readiness and with evidence, none of it twice and all
    of it cited by its readiness. That there is an own product is not asked here.
    """
    names = readiness.sparkSession.createDataFrame([(f,) for f in findings], "finding_id string")
    pair = ["finding_id", "evidence_id"]

    def of(things: DataFrame, edges: DataFrame, code: str, repeated_code: str, missing: str) -> list[DataFrame]:
        times = edges.groupBy(*pair).agg(F.count(F.lit(1)).alias("times"))
        n = times.groupBy("finding_id").agg(F.max("times").alias("most"))
        cites = join_written(things.select("finding_id").distinct(), n, "finding_id", "left").where("most IS NULL OR most > 1")
        return [repeated(things, "finding_id", repeated_code), _hit(join_written(names, things.select("finding_id").distinct(), "finding_id", "left_anti"), missing, "finding_id"), _hit(cites, code, "finding_id")]

    key = F.concat_ws(":", *pair)
    known = readiness_edges.select(*pair).distinct()
    unknown_ids = known.join(evidence.select("evidence_id").distinct().hint("merge"), "evidence_id", "left_anti")
    states = join_written(proposals, readiness.select("finding_id", F.col("status").alias("_status")).distinct(), "finding_id", "left")
    beyond = proposal_edges.select(*pair).distinct().join(known.hint("merge"), pair, "left_anti")
    return reduce(DataFrame.union, [
        *of(readiness, readiness_edges, "READINESS_EVIDENCE", "REPEATED_READINESS", "MISSING_READINESS"), where(readiness, is_blank(F.col("reason")), "READINESS_WITHOUT_REASON", "finding_id"), _hit(unknown_ids, "UNKNOWN_EVIDENCE", key),
        _hit(evidence.where(is_blank(F.col("evidence_id"))), "BLANK_ID", F.lit("evidence")), where(states, ~F.col("status").eqNullSafe(F.col("_status")), "STATUS_DIFFERS", "finding_id"),
        *of(proposals, proposal_edges, "PROPOSAL_EVIDENCE", "REPEATED_PROPOSAL", "MISSING_PROPOSAL"), _hit(beyond, "EVIDENCE_NOT_ALLOWED", key),
    ])


def source_checks(sources: DataFrame, products: DataFrame, rows: DataFrame, excluded: DataFrame, ready: int, full: int) -> DataFrame:
    """COMPLETENESS_MISMATCH of sources that repeat, whose product is unknown or whose counts the rows do not bear out.

    sources: source_id, product_id, kind, rows_read, valid_rows, used_rows, excluded_rows, excluded_over_limit, status.
    rows: (source_id, product_id) of all used rows; excluded: (row_id, source_id, reason).
    """
    code = "COMPLETENESS_MISMATCH"
    used = rows.groupBy("source_id").agg(F.count(F.lit(1)).alias("_used"), F.min("product_id").alias("_low"), F.max("product_id").alias("_high"))
    out = excluded.groupBy("source_id").agg(F.count(F.lit(1)).alias("_out"), F.count_if(F.col("reason") == "OVER_LIMIT").alias("_over"))
    x = sources.join(used.hint("merge"), "source_id", "left").join(out.hint("merge"), "source_id", "left").join(products.select("product_id", F.lit(True).alias("_known")).hint("merge"), "product_id", "left")
    n, gone, over = (F.coalesce(c, F.lit(0)) for c in ("_used", "_out", "_over"))
    wrong = (
        (F.coalesce("_low", "product_id") != F.col("product_id")) | (F.coalesce("_high", "product_id") != F.col("product_id")) | (F.col("rows_read") != n + gone) | (F.col("valid_rows") != n + over)
        | (F.col("used_rows") != n) | (F.col("excluded_rows") != gone) | (F.col("excluded_over_limit") != over) | (F.col("status") != status_of(n, ready, full))
    )
    return where(x, F.col("_known").isNull() | wrong, code, "source_id").union(repeated(sources, "source_id", code))


def anchor_checks(reviews: DataFrame, questions: DataFrame, excluded: DataFrame, sources: DataFrame) -> DataFrame:
    """SOURCE_ANCHOR_MISMATCH: repeated sources; reviews and questions whose source is not one of their product and kind; excluded
    rows of unknown sources."""
    code = "SOURCE_ANCHOR_MISMATCH"
    rows = reviews.select("row_id", "source_id", "product_id", F.concat("sort", F.lit("_reviews")).alias("kind")).union(questions.select("row_id", "source_id", "product_id", F.lit("questions")))
    return repeated(sources, "source_id", code).union(source_anchor(rows, sources)).union(unknown(excluded, sources, ["source_id"], code, "row_id"))


def finding_ids(findings: DataFrame, row: str) -> tuple[DataFrame, DataFrame]:
    """(faults, findings that count) of findings with the two id fields finding_id and id; row names a finding whose ids do not."""
    one = F.coalesce("finding_id", "id")
    conflict = F.coalesce(F.col("finding_id") != F.col("id"), F.lit(False))
    good = findings.where(~conflict & one.isNotNull()).withColumn("finding_id", one)
    faults = where(findings, conflict, "CONFLICTING_FINDING_ID", row).union(where(findings, one.isNull(), "MISSING_FINDING_ID", row)).union(repeated(good, "finding_id", "DUPLICATE_FINDING_ID"))
    first = good.groupBy("finding_id").agg(F.min_by(F.struct(*[c for c in good.columns if c != "finding_id"]), F.col(row)).alias("f"))
    return faults, first.select("finding_id", "f.*")


@dataclass
class ReportTables:
    """What a report gives: rows, sources, aggregates, findings and actions, and the catalogs that it claims."""

    products: DataFrame  # product_id, role
    reviews: DataFrame  # row_id, source_id, product_id, sort, rank, type_id
    questions: DataFrame  # row_id, source_id, product_id, rank, topic_id
    excluded: DataFrame  # row_id, source_id, reason
    sources: DataFrame  # as source_checks() reads them
    completeness: DataFrame  # evidence_id, product_id, kind, valid_rows, used_rows, excluded_over_limit, status, blocking
    assessments: DataFrame  # review_id, rank, dimensions
    types: DataFrame  # type_id, name, position
    topics: DataFrame  # topic_id, name, position
    gaps: DataFrame
    topic_stats: DataFrame
    coverage: DataFrame
    readiness: DataFrame  # finding_id, status
    findings: DataFrame  # row_no, finding_id, id, status, has_problem, evidence_ids
    actions: DataFrame  # action_id, finding_id, finding_ids, evidence_id, evidence_ids, reason


def validate_report(t: ReportTables, types: DataFrame, topics: DataFrame, dimensions: DataFrame, ready: int = 90, full: int = 100, top: int = 20) -> DataFrame:
    """(code, object_id): every rule that a report breaks, recomputed from its rows against the catalogs (id, name, position).

    Aggregates, completeness, readiness and diagnoses are computed anew, each once, and compared; findings and actions may cite
    only what held in that comparison.
    """
    out = [repeated(t.reviews.select("row_id").union(t.questions.select("row_id")), "row_id", "DUPLICATE_ROW_ID"), catalog_checks(t.types, types, "type_id"), catalog_checks(t.topics, topics, "topic_id")]
    names = [r["dimension"] for r in dimensions.select("dimension").collect()]  # the catalog: six rows
    out += [
        unknown(t.assessments.withColumnRenamed("review_id", "row_id"), t.reviews, ["row_id"], "UNKNOWN_MODEL_ROW", "row_id"), repeated(t.assessments, "review_id", "DUPLICATE_MODEL_ROW"),
        invalid_top(t.assessments, t.reviews, top), invalid_dimension(t.assessments, names),
        unknown(t.reviews.where("type_id IS NOT NULL"), types, ["type_id"], "INVALID_TYPE_ID", "row_id"), unknown(t.questions.where("topic_id IS NOT NULL"), topics, ["topic_id"], "INVALID_TOPIC_ID", "row_id"),
    ]
    gaps, stats, cover = written(type_share_gap(t.reviews, types)), written(topic_stats(t.questions, topics)), written(dimension_coverage(t.assessments, t.reviews, dimensions))
    evidence = []
    for given, expected, key, family in ((t.gaps, gaps, "type_id", "type"), (t.topic_stats, stats, "topic_id", "question"), (t.coverage, cover, "dimension", "dimension")):
        faults = written(reconcile(given, expected, ["product_id", key]))
        out.append(_hit(faults, "AGGREGATE_MISMATCH", F.concat_ws(":", "product_id", key)))
        held = given.join(faults.hint("merge"), ["product_id", key], "left_anti")
        evidence.append(held.select("evidence_id", F.lit(family).alias("family"), "product_id"))
    rows = t.reviews.select("source_id", "product_id").union(t.questions.select("source_id", "product_id"))
    out += [source_checks(t.sources, t.products, rows, t.excluded, ready, full), anchor_checks(t.reviews, t.questions, t.excluded, t.sources)]
    kinds = t.products.sparkSession.createDataFrame([("default_reviews",), ("recent_reviews",), ("questions",)], "kind string")
    out.append(missing_required(t.products, kinds, t.sources))
    due = written(completeness(t.products, t.sources, full, ready).where("known").drop("known"))
    faults = written(reconcile(t.completeness, due, ["evidence_id"]))
    out.append(_hit(faults, "COMPLETENESS_MISMATCH", "evidence_id"))
    evidence.append(t.completeness.join(faults.hint("merge"), "evidence_id", "left_anti").select("evidence_id", F.lit("data").alias("family"), "product_id"))
    id_faults, found = finding_ids(t.findings, "row_no")
    found, evidence = written(found), written(reduce(DataFrame.union, evidence))
    out.append(id_faults)
    can = written(readiness(t.reviews, t.questions, t.products, ready))
    flags = problem_flags(can, gaps, cover, stats, t.products)
    state = lambda df: df.select("finding_id", "status")
    out += [_hit(reconcile(state(x), state(can), ["finding_id"]), "READINESS_MISMATCH", "finding_id") for x in (t.readiness, found)]
    out.append(_hit(reconcile(found.select("finding_id", "has_problem"), flags.select("finding_id", "has_problem"), ["finding_id"]), "DIAGNOSIS_MISMATCH", "finding_id"))
    own, enough = t.products.where("role = 'self'").select("product_id"), t.questions.groupBy("product_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= ready)
    out += [finding_evidence(found, evidence, own, enough), action_checks(t.actions, found, evidence)]
    return reduce(DataFrame.union, out)


def write_if_clean(df: DataFrame, violations: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite", partition_by: list[str] | None = None) -> None:
    """Write df if the checks, run now, find nothing; raise otherwise."""
    first = violations.limit(1).collect()
    if first:
        raise ValueError(f"not written: {first[0]['code']} {first[0]['object_id']}")
    w = df.write.format(fmt).mode(mode)
    (w.partitionBy(*partition_by) if partition_by else w).save(path)
