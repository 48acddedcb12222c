"""Findings and actions from aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.text import label_name, percent1
from larkspur.operators.aggregates import lowest_coverage, top_gap_type, top_own_topic, top_topic_per_product
from larkspur.operators.joins import join_written
from larkspur.plans.spill import written
from larkspur.schemas import DIMENSIONS, FINDINGS, READY_ROWS, TOPICS, TYPES

# Titles, actions and reasons by finding and outcome.
TITLES = [
    ("F01", "problem", "评价展示倾向问题"), ("F02", "problem", "默认评价六维覆盖信号"), ("F03", "problem", "问大家高频决策主题"),
    ("F01", "unavailable", "评价展示数据不足"), ("F02", "unavailable", "六维诊断数据不足"), ("F03", "unavailable", "问大家诊断数据不足"),
    ("F01", "none", "未发现可证明的评价展示倾向问题"), ("F02", "none", "未发现可证明的六维内容问题"), ("F03", "none", "未发现可证明的问大家决策问题"),
]
ACTIONS = [
    ("F01", "P1", "校正评价展示内容结构", "按评价展示证据校正内容结构"), ("F02", "P1", "优化邀评问题与六维内容引导", "按六维覆盖信号优化邀评问题与内容引导"),
    ("F03", "P1", "围绕高频问题补充问答与详情页证据", "按问大家高频主题补充决策信息证据"), ("F01", "P0", "补齐默认与时间排序评价数据", "补齐默认与时间排序评价至诊断门槛"),
    ("F02", "P0", "补齐默认排序评价数据", "补齐默认排序评价至诊断门槛"), ("F03", "P0", "补齐问大家数据", "补齐问大家至诊断门槛"),
]
MORE_COMPETITORS = ("补齐我方问大家与可比竞品数据", "补齐我方问大家与可比竞品至诊断门槛")


def outcome() -> Column:
    return F.when(F.col("status") == "unavailable", "unavailable").when(F.col("has_problem"), "problem").otherwise("none")


def finding_titles(findings: DataFrame) -> DataFrame:
    """Adds the title for the finding's status and outcome."""
    t = findings.sparkSession.createDataFrame(TITLES, "finding_id string, outcome string, title string")
    return findings.withColumn("outcome", outcome()).join(F.broadcast(t), ["finding_id", "outcome"], "left").drop("outcome")


# What a finding says, by outcome; %s stands for figures in their order.
DETAILS = {
    ("F01", "unavailable"): "默认排序 %s 条、时间排序 %s 条，未同时达到各 90 条门槛，无法形成正式展示倾向诊断。",
    ("F01", "none"): "我方「%s」的默认与时间排序占比差绝对值为 %s，低于 10.0%% 异常阈值，当前数据未形成可证明的问题。",
    ("F01", "problem"): "我方「%s」在默认排序为 %s 条（%s），时间排序为 %s 条（%s），占比差绝对值为 %s，达到 10.0%% 异常阈值，形成评价展示倾向问题。",
    ("F02", "few"): "默认排序只有 %s 条，未达到 20 条明细保留门槛，不形成六维覆盖明细。",
    ("F02", "unavailable"): "已保留默认前 20 条逐条六维明细，但默认排序总样本只有 %s 条，未达到 90 条正式诊断门槛。",
    ("F02", "none"): "默认前 20 条中，六维最低覆盖率为 %s，不低于 60.0%% 观察线，当前数据未形成需跟进的覆盖信号。",
    ("F02", "problem"): "默认前 20 条中，「%s」命中 %s 条，覆盖率 %s，低于 60.0%% 观察线，说明样本中该类信息较少，形成评价内容覆盖信号；这不等同于产品缺陷。",
    ("F03", "unavailable"): "我方问大家只有 %s 条，未达到 90 条正式诊断门槛。",
    ("F03", "none"): "我方问大家最高主题占比为 %s，低于 30.0%% 集中观察线，当前未形成需跟进的高频主题信号。%s",
    ("F03", "problem"): "%s。我方最高主题占比达到 30.0%% 集中观察线，说明该主题是高频决策关注点；该数据不直接证明信息缺口。%s",
}
TOPIC_CLAUSE = "%s最集中的主题是「%s」：%s 条（%s）"
OWN_NAME = "我方"
COMPETITORS = {"none": "未上传竞品，本分区只做我方诊断。", "few": "竞品问大家均未达到 90 条，本分区只做我方诊断。", "some": "已纳入 %s 个问大家不少于 90 条的竞品。"}


def finding_details(findings: DataFrame, ready: DataFrame, products: DataFrame, eligible: DataFrame, gaps: DataFrame, coverage: DataFrame, topics: DataFrame, few: int = 20) -> DataFrame:
    """Adds ``detail``: what the figures behind a finding say. findings: finding_id, status, has_problem.

    ready has the own rows' counts (one row is read); the figures of each finding are one row: the own type of the largest gap,
    the least covered own dimension, and the top topic of each product that is compared.
    """
    own = products.where("role = 'self'").select("product_id")
    one = lambda df, name, *columns: df.agg(F.first(F.struct(*columns)).alias(name))
    clause = F.format_string(TOPIC_CLAUSE, F.when(F.col("role") == "self", OWN_NAME).otherwise(F.col("name")), label_name(F.col("topic_id"), TOPICS), F.col("count"), percent1(F.col("share")))
    tops = top_topic_per_product(topics, eligible.where(f"questions >= {READY_ROWS}")).join(products.hint("merge"), "product_id")
    said = F.array_sort(F.collect_list(F.struct((F.col("role") != "self").alias("other"), "product_id", clause.alias("c"))))
    compared = eligible.agg(F.count_if(F.col("role") == "competitor").alias("n"), F.count_if((F.col("role") == "competitor") & (F.col("questions") >= READY_ROWS)).alias("compared"))
    figures = [
        one(ready, "rows", "default_rows", "recent_rows", "question_rows"),
        one(top_gap_type(gaps, own), "gap", "type_id", "default_count", "default_share", "recent_count", "recent_share", "difference"),
        one(lowest_coverage(coverage, own), "low", "dimension", "hit_count", "coverage"),
        one(top_own_topic(topics, own), "topic", "share"),
        tops.agg(F.array_join(F.transform(said, lambda x: x["c"]), "；").alias("clauses")),
        one(compared, "others", "n", "compared"),
    ]
    x = findings
    for f in figures:  # one row each
        x = x.crossJoin(F.broadcast(f))
    note = F.when(F.col("others.n") == 0, COMPETITORS["none"]).when(F.col("others.compared") == 0, COMPETITORS["few"]).otherwise(F.format_string(COMPETITORS["some"], "others.compared"))
    type_name, gap = label_name(F.col("gap.type_id"), TYPES), percent1(F.abs("gap.difference"))
    given = {
        ("F01", "unavailable"): ("rows.default_rows", "rows.recent_rows"),
        ("F01", "none"): (type_name, gap),
        ("F01", "problem"): (type_name, "gap.default_count", percent1(F.col("gap.default_share")), "gap.recent_count", percent1(F.col("gap.recent_share")), gap),
        ("F02", "few"): ("rows.default_rows",),
        ("F02", "unavailable"): ("rows.default_rows",),
        ("F02", "none"): (percent1(F.col("low.coverage")),),
        ("F02", "problem"): (label_name(F.col("low.dimension"), DIMENSIONS), "low.hit_count", percent1(F.col("low.coverage"))),
        ("F03", "unavailable"): ("rows.question_rows",),
        ("F03", "none"): (percent1(F.col("topic.share")), note),
        ("F03", "problem"): (F.col("clauses"), note),
    }
    kind = F.when((F.col("finding_id") == "F02") & (outcome() == "unavailable") & (F.col("rows.default_rows") < few), "few").otherwise(outcome())
    detail = F.lit(None).cast("string")
    for (finding, how), columns in given.items():
        detail = F.when((F.col("finding_id") == finding) & (kind == how), F.format_string(DETAILS[finding, how], *columns)).otherwise(detail)
    return x.withColumn("detail", detail).select(*findings.columns, "detail")


def data_evidence(completeness: DataFrame, need: int) -> DataFrame:
    """(finding_id, evidence_ids): the evidence of unavailable findings, by kind; F01 and F02 without any get the first own one."""
    k = F.col("kind")
    mine = F.array_compact(
        F.array(
            F.when(k.isin("self_default_reviews", "self_recent_reviews"), "F01"), F.when(k == "self_default_reviews", "F02"),
            F.when((k == "self_questions") | ((k == "competitor_questions") & (F.col("used_rows") < need)), "F03"),
        )
    )
    found = completeness.select(F.explode(mine).alias("finding_id"), "evidence_id").groupBy("finding_id").agg(F.array_sort(F.collect_list("evidence_id")).alias("ids"))
    first = completeness.where(F.startswith(k, F.lit("self_"))).agg(F.min("evidence_id").alias("first"))
    names = completeness.sparkSession.createDataFrame([(f,) for f in FINDINGS], "finding_id string")
    # One row is broadcast; the lists of ids grow with the products and are measured.
    x = join_written(names, found, "finding_id", "left").crossJoin(F.broadcast(first))
    ids = F.coalesce("ids", F.when((F.col("finding_id") != "F03") & F.col("first").isNotNull(), F.array("first")))
    return x.select("finding_id", F.coalesce(ids, F.array().cast("array<string>")).alias("evidence_ids"))


def data_citations(completeness: DataFrame, need: int) -> DataFrame:
    """(finding_id, evidence_id): what data_evidence() has in arrays, as edges."""
    k = F.col("kind")
    mine = F.array_compact(
        F.array(
            F.when(k.isin("self_default_reviews", "self_recent_reviews"), "F01"), F.when(k == "self_default_reviews", "F02"),
            F.when((k == "self_questions") | ((k == "competitor_questions") & (F.col("used_rows") < need)), "F03"),
        )
    )
    found = written(completeness.select(F.explode(mine).alias("finding_id"), "evidence_id"))
    first = completeness.where(F.startswith(k, F.lit("self_"))).agg(F.min("evidence_id").alias("evidence_id")).where("evidence_id is not null")
    due = completeness.sparkSession.createDataFrame([(f,) for f in FINDINGS if f != "F03"], "finding_id string")
    # Two rows, and one: small by their nature.
    lacking = due.join(F.broadcast(found.select("finding_id").distinct()), "finding_id", "left_anti").crossJoin(F.broadcast(first))
    return found.unionByName(lacking)


def gate_findings(proposed: DataFrame, ready: DataFrame, allowed: DataFrame, data: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(findings, errors) of proposals (finding_id, status, evidence_ids): a proposal counts if its status is the one found and
    all of its evidence is allowed, without repeats; else the finding is unavailable, cites ``data`` (of data_evidence) and has an
    error row (code, finding_id). allowed: finding_id, evidence_ids. findings: finding_id, status, accepted, evidence_ids."""
    p = proposed.select("finding_id", F.col("status").alias("_status"), F.col("evidence_ids").alias("_ids"))
    x = ready.select("finding_id", "status").join(p.hint("merge"), "finding_id", "left").join(allowed.select("finding_id", F.col("evidence_ids").alias("_allowed")).hint("merge"), "finding_id", "left")
    ok = (F.col("_status") == F.col("status")) & (F.size("_ids") > 0) & (F.size(F.array_distinct("_ids")) == F.size("_ids")) & (F.size(F.array_except("_ids", "_allowed")) == 0)
    x = x.withColumn("accepted", F.coalesce(ok, F.lit(False)))
    none = F.array().cast("array<string>")
    if data is None:
        x = x.withColumn("_data", none)
    else:
        x = x.join(data.select("finding_id", F.col("evidence_ids").alias("_data")).hint("merge"), "finding_id", "left")
    gated = x.select("finding_id", F.when(F.col("accepted"), F.col("status")).otherwise("unavailable").alias("status"), "accepted", F.coalesce(F.when(F.col("accepted"), F.col("_allowed")).otherwise(F.col("_data")), none).alias("evidence_ids"))
    return gated, x.where("NOT accepted").select(F.lit("SYNTHESIS_EVIDENCE_REJECTED").alias("code"), "finding_id")


def build_actions(findings: DataFrame, eligible: DataFrame) -> DataFrame:
    """(action_id, priority, action, reason, finding_ids, evidence_ids): nothing for a finding that is available without a
    problem; numbered in the order of findings, of which there are three. eligible: whether a competitor has too few questions."""
    t = findings.sparkSession.createDataFrame(ACTIONS, "finding_id string, priority string, action string, cause string")
    x = findings.where((F.col("status") == "unavailable") | F.col("has_problem")).withColumn("priority", F.when(F.col("status") == "unavailable", "P0").otherwise("P1"))
    short = eligible.agg(F.coalesce(F.bool_or((F.col("role") == "competitor") & ~F.col("eligible")), F.lit(False)).alias("_short"))
    x = x.join(F.broadcast(t), ["finding_id", "priority"]).crossJoin(F.broadcast(short))
    other = F.col("_short") & (F.col("finding_id") == "F03") & (F.col("priority") == "P0")
    n = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("finding_id"))
    reason = F.concat("finding_id", F.lit("｜"), F.array_join("evidence_ids", "、"), F.lit("："), F.when(other, MORE_COMPETITORS[1]).otherwise(F.col("cause")))
    return x.select(
        F.concat(F.lit("A"), F.lpad(n.cast("string"), 2, "0")).alias("action_id"), "priority", F.when(other, MORE_COMPETITORS[0]).otherwise(F.col("action")).alias("action"),
        reason.alias("reason"), F.array("finding_id").alias("finding_ids"), "evidence_ids",
    )


def finding_evidence_rows(findings: DataFrame, evidence: DataFrame) -> DataFrame:
    """(finding_id, evidence_id, family): every reference of a finding with the family of its evidence, null if unknown."""
    x = findings.select("finding_id", F.explode("evidence_ids").alias("evidence_id"))
    return x.join(evidence.select("evidence_id", "family").hint("merge"), "evidence_id", "left").select("finding_id", "evidence_id", "family")


def action_lineage(actions: DataFrame, evidence: DataFrame) -> DataFrame:
    """(action_id, finding_id, evidence_id, known): every reference of an action, with whether its evidence exists."""
    x = actions.select("action_id", F.explode("finding_ids").alias("finding_id"), "evidence_ids").select("action_id", "finding_id", F.explode("evidence_ids").alias("evidence_id"))
    return x.join(evidence.select("evidence_id", F.lit(True).alias("known")).distinct().hint("merge"), "evidence_id", "left").select("action_id", "finding_id", "evidence_id", F.coalesce("known", F.lit(False)).alias("known"))


def source_rows(lineage: DataFrame, gaps: DataFrame, coverage: DataFrame, topics: DataFrame, reviews: DataFrame, assessments: DataFrame, questions: DataFrame) -> DataFrame:
    """(action_id, evidence_id, row_id): the rows that the aggregates cited by an action count: reviews of a type, reviews that
    have a dimension, questions of a topic."""
    e = lineage.select("action_id", "evidence_id").distinct()
    hits = assessments.select(F.col("review_id").alias("row_id"), F.explode(F.filter("dimensions", lambda x: x["present"])).alias("x")).select("row_id", F.col("x.dimension").alias("dimension"))
    hits = hits.join(reviews.select("row_id", "product_id").hint("merge"), "row_id")
    out = None
    for cited, key, rows in ((gaps, "type_id", reviews), (coverage, "dimension", hits), (topics, "topic_id", questions)):
        of = e.join(cited.select("evidence_id", "product_id", key).hint("merge"), "evidence_id").join(rows.select("product_id", key, "row_id").hint("merge"), ["product_id", key])
        of = of.select("action_id", "evidence_id", "row_id")
        out = of if out is None else out.union(of)
    return out


def refs_merge(one: Column, many: Column) -> Column:
    """A singular and a plural id field as one list without repeats or nulls."""
    return F.array_distinct(F.array_compact(F.concat(F.coalesce(many, F.array().cast("array<string>")), F.array(one))))
