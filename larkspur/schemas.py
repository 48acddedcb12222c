"""Catalogs and limits of the review and question domain."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Ids and names of review types, question topics and dimensions.
TYPES = {
    "t1": "纯功效陈述",
    "t2": "人群场景+痛点+效果",
    "t3": "痛点+效果",
    "t4": "人群场景+效果",
    "t5": "体验细节",
    "t6": "未使用待观察",
    "t7": "泛化无信息",
    "t8": "服务物流",
}
TOPICS = {
    "q1": "效果验证",
    "q2": "适用人群与症状",
    "q3": "规格价格与活动",
    "q4": "使用体验与安全顾虑",
    "q5": "无关或低信息提问",
    "q6": "成分与配方",
    "q7": "品牌与信任资质",
    "q8": "使用方法与见效周期",
}
DIMENSIONS = {"persona": "人群身份", "scene": "使用场景", "painPoint": "核心痛点", "detail": "体验细节", "effect": "效果反馈", "delight": "意外惊喜"}
STATUS_LABELS = {"complete": "完整", "provisional": "基本完整", "insufficient": "数据不足", "missing": "缺失", "available": "可诊断", "unavailable": "数据不足"}
KIND_LABELS = {"default_reviews": "默认排序评价", "recent_reviews": "时间排序评价", "questions": "问大家", "review_tags": "评价页截图"}
FINDINGS = ("F01", "F02", "F03")
KINDS = ("default_reviews", "recent_reviews", "questions")

# Rows used of a source, rows a diagnosis needs, rows a coverage needs, problem thresholds.
SOURCE_CAP, READY_ROWS, TOP_ROWS = 100, 90, 20
SHARE_GAP, LOW_COVERAGE, TOPIC_SHARE = 0.1, 0.6, 0.3


def catalog(spark: SparkSession, names: dict[str, str], key: str) -> DataFrame:
    """(key, name, position) of a catalog; a few rows, to be broadcast."""
    return spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate(names.items())], f"{key} string, name string, position int")


def values(names) -> str:
    """A catalog as SQL rows."""
    return ", ".join(f"('{k}', '{v}')" for k, v in names.items())

