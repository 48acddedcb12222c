"""Tables, figures and the document of a report, and notes beside it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.text import cell_units, clean_xml_text, in_order, label_name, percent1, safe_cell, strip
from larkspur.operators.aggregates import top_gap_type
from larkspur.operators.joins import join_written
from larkspur.schemas import TOPICS, TYPES

#: UTF-16 units that a cell holds at most.
CELL_UNITS = 32_767


def _cell(c: str) -> Column:
    return safe_cell(clean_xml_text(F.coalesce(F.col(c).cast("string"), F.lit("")))).alias(c)


def long_cells(rows: DataFrame, key: str, columns: list[str], longest: int = CELL_UNITS) -> DataFrame:
    """(code, object_id): rows with a cell that a spreadsheet cannot hold, the column after the key."""
    faults = F.array_compact(F.array(*[F.when(cell_units(F.coalesce(c, F.lit(""))) > longest, F.concat_ws(":", F.col(key).cast("string"), F.lit(c))) for c in columns]))
    return rows.select(F.explode(faults).alias("object_id")).select(F.lit("CELL_TOO_LONG").alias("code"), "object_id")


def completeness_table(completeness: DataFrame, products: DataFrame, sources: DataFrame) -> DataFrame:
    """The 13 columns of the table of data completeness. sources: source_id, product_id, kind, note."""
    x = completeness.withColumn("_kind", F.regexp_replace("kind", "^(self|competitor)_", ""))
    s = sources.select("product_id", F.col("kind").alias("_kind"), "source_id", "note")
    x = x.join(products.select("product_id", "name", "role").hint("merge"), "product_id", "left").join(s.hint("merge"), ["product_id", "_kind"], "left")
    return x.select(
        _cell("product_id"), F.coalesce("name", "product_id").alias("product"), F.coalesce("role", F.lit("")).alias("role"), _cell("kind"), _cell("source_id"), _cell("note"),
        "expected_rows", "valid_rows", "used_rows", "excluded_over_limit", _cell("status"), "blocking", _cell("evidence_id"),
    )


def reviews_table(reviews: DataFrame, gaps: DataFrame) -> DataFrame:
    """The 19 columns of the table of labelled reviews. reviews: product_id, sort, rank, source_id, source_row, row_id, date, sku,
    initial_text, followup_text, type_id, evidence_source, evidence_quote."""
    g = gaps.drop("difference").withColumn("_gap", F.col("recent_share") - F.col("default_share"))
    x = join_written(reviews, g, ["product_id", "type_id"], "left")
    quote = F.when(F.col("evidence_quote").isNotNull(), F.concat_ws("：", "evidence_source", "evidence_quote")).otherwise("")
    share = lambda c: F.coalesce(percent1(F.col(c)), F.lit(""))
    return x.withColumn("type_evidence", quote).select(
        _cell("product_id"), _cell("sort"), "rank", _cell("source_id"), "source_row", _cell("row_id"), _cell("date"), _cell("sku"), _cell("initial_text"), _cell("followup_text"),
        _cell("type_id"), label_name(F.coalesce("type_id", F.lit("")), TYPES).alias("type_name"), _cell("type_evidence"), "default_count", share("default_share").alias("default_share"),
        "recent_count", share("recent_share").alias("recent_share"), share("_gap").alias("difference"), _cell("evidence_id"),
    )


def dimensions_table(assessments: DataFrame, reviews: DataFrame, coverage: DataFrame) -> DataFrame:
    """The 13 columns of the table of six dimensions, a row for each dimension of an assessment."""
    a = assessments.select("review_id", "rank", "score", F.explode("dimensions").alias("d")).select("review_id", "rank", "score", "d.*")
    r = reviews.select(F.col("row_id").alias("review_id"), "product_id", "source_id", "source_row")
    x = join_written(a.join(r.hint("merge"), "review_id", "left"), coverage, ["product_id", "dimension"], "left")
    return x.select(
        _cell("product_id"), F.col("review_id").alias("row_id"), _cell("source_id"), "source_row", "rank", "score", "dimension", "present", _cell("evidence"),
        "hit_count", "total_count", F.coalesce(percent1(F.col("coverage")), F.lit("")).alias("coverage"), _cell("evidence_id"),
    )


def questions_table(questions: DataFrame, topics: DataFrame) -> DataFrame:
    """The 15 columns of the table of labelled questions. questions: product_id, rank, source_id, source_row, row_id, date, question,
    answer, topic_id, topic_evidence."""
    x = join_written(questions, topics, ["product_id", "topic_id"], "left")
    return x.withColumn("representatives", F.array_join("representative_ids", "、")).select(
        _cell("product_id"), "rank", _cell("source_id"), "source_row", _cell("row_id"), _cell("date"), _cell("question"), _cell("answer"), _cell("topic_id"),
        label_name(F.coalesce("topic_id", F.lit("")), TOPICS).alias("topic_name"), _cell("topic_evidence"), "count", F.coalesce(percent1(F.col("share")), F.lit("")).alias("share"),
        _cell("representatives"), _cell("evidence_id"),
    )


def findings_table(findings: DataFrame, metrics: DataFrame) -> DataFrame:
    """The nine columns of the table of findings. findings: finding_id, status, has_problem, problem_code, title, detail,
    evidence_ids; metrics: of report_metrics(), one row."""
    x = findings.crossJoin(F.broadcast(metrics.select("f01_type", "f01_difference")))
    first = F.col("finding_id") == "F01"
    return x.withColumn("evidence", F.array_join("evidence_ids", "、")).select(
        _cell("finding_id"), _cell("status"), "has_problem", _cell("problem_code"), _cell("title"), _cell("detail"), _cell("evidence"),
        F.when(first, F.col("f01_type")).otherwise("").alias("f01_type"), F.when(first, F.col("f01_difference")).otherwise("").alias("f01_difference"),
    )


def actions_table(actions: DataFrame) -> DataFrame:
    """The six columns of the table of actions."""
    x = actions.withColumn("findings", F.array_join("finding_ids", "、")).withColumn("evidence", F.array_join("evidence_ids", "、"))
    return x.select(_cell("action_id"), _cell("priority"), _cell("action"), _cell("reason"), _cell("findings"), _cell("evidence"))


def report_metrics(findings: DataFrame, actions: DataFrame, reviews: DataFrame, questions: DataFrame, gaps: DataFrame, own: DataFrame) -> DataFrame:
    """One row: findings, actions, used rows of both kinds, and the own type of the largest gap with its absolute difference."""
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    top = top_gap_type(gaps, own).agg(F.first("type_id").alias("f01_type"), F.first(percent1(F.abs("difference"), "pp")).alias("f01_difference"))
    out = count(findings, "finding_count")
    for one in (count(actions, "action_count"), count(reviews, "used_reviews"), count(questions, "used_questions"), top):  # one row each
        out = out.crossJoin(F.broadcast(one))
    return out


def used_rows(reviews: DataFrame, questions: DataFrame) -> DataFrame:
    """(source_id, rows): used rows of every source."""
    return reviews.select("source_id").union(questions.select("source_id")).groupBy("source_id").agg(F.count(F.lit(1)).alias("rows"))


def report_document(parts: dict[str, tuple[DataFrame, dict[str, str]]], keys: dict[str, list[str]]) -> DataFrame:
    """(part, key, entry): the report as JSON objects, one a row, from which a page or a file is put together.

    parts: name -> (rows, {name in JSON: column}); keys: the columns that name an entry of a part. A document of any size so stays
    a table; angle brackets and line separators are escaped, as for a script inside a page.
    """
    out = None
    for name, (rows, fields) in parts.items():
        entry = F.to_json(F.struct(*[F.col(c).alias(k) for k, c in fields.items()]), {"ignoreNullFields": "false"})
        for sign in ("<", chr(0x2028), chr(0x2029)):
            entry = F.replace(entry, F.lit(sign), F.lit(f"\\u{ord(sign):04x}"))
        part = rows.select(F.lit(name).alias("part"), F.concat_ws(":", *keys[name]).alias("key"), entry.alias("entry"))
        out = part if out is None else out.unionByName(part)
    return out


def report_parts(
    meta: DataFrame, products: DataFrame, completeness: DataFrame, types: DataFrame, topics: DataFrame, gaps: DataFrame, coverage: DataFrame, topic_stats: DataFrame, findings: DataFrame, actions: DataFrame,
    questions: DataFrame, tags: DataFrame, errors: DataFrame, warnings: DataFrame, excluded: DataFrame,
) -> dict[str, tuple[DataFrame, dict[str, str], list[str]]]:
    """The parts of a report's document with the names of their fields and their keys, as report_document() takes them.

    meta: key, ready_rows, source_cap; types and topics: catalogs with name; findings: with title and detail; tags: source_id,
    product_id, name, count; errors and warnings: code, message; excluded: row_id, source_id, reason; others as their operators give them.
    """
    same = lambda *names: {_camel(n): n for n in names}
    return {
        "meta": (meta, same("ready_rows", "source_cap"), ["key"]),
        "products": (products, same("product_id", "role", "name"), ["product_id"]),
        "completeness": (completeness, same("evidence_id", "product_id", "kind", "expected_rows", "valid_rows", "used_rows", "excluded_over_limit", "status", "blocking"), ["evidence_id"]),
        "typeCatalog": (types, {"id": "type_id", "name": "name"}, ["type_id"]),
        "topicCatalog": (topics, {"id": "topic_id", "name": "name"}, ["topic_id"]),
        "taxonomy": (gaps, same("product_id", "type_id", "default_count", "default_share", "recent_count", "recent_share", "difference", "evidence_id"), ["product_id", "type_id"]),
        "dimensions": (coverage, same("product_id", "dimension", "hit_count", "total_count", "coverage", "evidence_id"), ["product_id", "dimension"]),
        "topics": (topic_stats, same("product_id", "topic_id", "count", "share", "evidence_id") | {"representativeQuestionIds": "representative_ids"}, ["product_id", "topic_id"]),
        "findings": (findings, same("finding_id", "status", "title", "detail", "evidence_ids"), ["finding_id"]),
        "actions": (actions, same("action_id", "priority", "action", "reason", "finding_ids", "evidence_ids"), ["action_id"]),
        "questions": (questions, same("product_id"), ["row_id"]),
        "reviewTags": (tags, same("source_id", "product_id", "name", "count"), ["product_id", "name"]),
        "errors": (errors, same("code", "message"), ["message"]),
        "warnings": (warnings, same("code", "message"), ["message"]),
        "excludedRows": (excluded, same("row_id", "source_id", "reason"), ["row_id"]),
    }


def _camel(name: str) -> str:
    first, *rest = name.split("_")
    return first + "".join(x.capitalize() for x in rest)


def report_fields(document: DataFrame) -> DataFrame:
    """(part, key, field, text, number) of a report's document: each member of its entries, numbers as such and lists joined by commas."""
    members = F.from_json("entry", "map<string,variant>")
    x = document.select("part", "key", F.explode(members).alias("field", "v")).withColumn("kind", F.schema_of_variant("v"))
    number = F.when((F.col("kind").isin("BIGINT", "DOUBLE", "FLOAT")) | F.startswith(F.col("kind"), F.lit("DECIMAL")), F.try_variant_get("v", "$", "double"))
    text = F.when(F.startswith(F.col("kind"), F.lit("ARRAY")), F.array_join(F.try_variant_get("v", "$", "array<string>"), ",")).otherwise(F.try_variant_get("v", "$", "string"))
    return x.select("part", "key", "field", F.when(number.isNotNull() & (F.col("part") != "meta"), "").otherwise(text).alias("text"), number.alias("number"))


def tag_totals(results: DataFrame, tags: DataFrame, collation: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(totals, warnings) of screenshots' tags. results: (product_id, completeness); tags: (product_id, name, count).

    totals: (product_id, name, count) in order; a tag without a count adds nothing and has a warning, as has a product whose
    result is not complete. warnings: (code, product_id, name).
    """
    partial = results.where("completeness <> 'complete'").select(F.concat(F.lit("SCREENSHOT_METADATA_"), F.upper("completeness")).alias("code"), "product_id", F.lit("").alias("name"))
    blank = tags.where("count IS NULL").select(F.lit("SCREENSHOT_TAG_COUNT_UNAVAILABLE").alias("code"), "product_id", "name")
    totals = tags.where("count IS NOT NULL").groupBy("product_id", "name").agg(F.sum("count").alias("count")).orderBy(*in_order("product_id", collation), *in_order("name", collation))
    return totals, partial.union(blank)


def flatten_tags(results: DataFrame) -> DataFrame:
    """(product_id, name, count) of results (product_id, tags), tags an array of (name, count)."""
    return results.select("product_id", F.explode("tags").alias("t")).select("product_id", "t.name", "t.count")


def notes_to_keep(notes: DataFrame) -> DataFrame:
    trimmed = [strip(F.coalesce(c, F.lit(""))).alias(c) for c in ("title", "content")]
    return notes.select("note_id", "ts", *trimmed).where("title <> ''")


def append_notes(notes: DataFrame, path: str) -> DataFrame:
    """Append notes (note_id, ts, title, content) to a table and return the table: titles and contents are trimmed, a title must not
    be empty, a null content is."""
    good = notes_to_keep(notes)
    good.write.mode("append").parquet(path)
    return notes.sparkSession.read.schema(good.schema).parquet(path)


def recent_notes(notes: DataFrame, most: int = 20) -> DataFrame:
    """The latest notes, by time, then id: a limit that is the feature, and a sort of ``most`` rows a task."""
    return notes.orderBy(F.desc("ts"), F.desc("note_id")).limit(most)
