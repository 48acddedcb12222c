"""Header cells bound to fields, and grids of cells as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.functions.text import is_blank, normalize_exact, normalize_header, text_value
from larkspur.operators.joins import join_checked
from larkspur.operators.numbering import numbered

# Names under which exports have each field.
REVIEW_ALIASES = {
    "rank": ("序号", "排名"),
    "nickname": ("用户昵称", "旺旺号", "买家昵称", "昵称"),
    "date": ("评价时间", "初评时间", "评论时间"),
    "reviewType": ("评价类型", "评论类型"),
    "sku": ("SKU", "商品规格", "规格"),
    "initialText": ("初评内容", "初评", "评价内容", "评论内容"),
    "followupText": ("追评内容", "追评", "追加评价", "追加评论"),
}
QUESTION_ALIASES = {"rank": ("序号", "排名"), "nickname": ("昵称",), "date": ("时间", "提问时间"), "questionText": ("问题",), "answer": ("回答", "问答")}


def alias_table(spark: SparkSession, aliases: dict[str, tuple[str, ...]]) -> DataFrame:
    return spark.createDataFrame([(name, field) for field, names in aliases.items() for name in names], "name string, field string")


def trim_blank_headers(headers: DataFrame) -> DataFrame:
    """Header cells (source_id, col_no, name) up to the last one that is not blank; blank ones before it stay."""
    last = F.max(F.when(F.col("name") != "", F.col("col_no"))).over(Window.partitionBy("source_id"))
    return headers.withColumn("last", last).where(F.col("col_no") <= F.col("last")).drop("last")


def map_headers(headers: DataFrame, aliases: DataFrame, required: list[str], ignore_unknown: bool = False) -> tuple[DataFrame, DataFrame]:
    """(mapping, diagnostics) of header cells (source_id, col_no, name).

    mapping: (source_id, field, col_no), the first column of each field. diagnostics: (source_id, code, detail): no header at
    all, columns without a field, a second column of a field, required fields without a column.
    """
    named = trim_blank_headers(headers.withColumn("name", normalize_header(F.col("name"))))
    x = join_checked(named, aliases, "name", "left")
    x = x.withColumn("n", F.when(F.col("field").isNotNull(), F.row_number().over(Window.partitionBy("source_id", "field").orderBy("col_no"))))
    mapping = x.where("n = 1").select("source_id", "field", "col_no")
    code = F.when(F.col("field").isNull(), "IGNORED_COLUMN" if ignore_unknown else "UNKNOWN_COLUMN").when(F.col("n") > 1, "DUPLICATE_COLUMN")
    faults = x.select("source_id", code.alias("code"), F.col("name").alias("detail")).where("code IS NOT NULL")
    sources = headers.select("source_id").distinct()
    empty = sources.join(named.select("source_id").hint("merge"), "source_id", "left_anti").select("source_id", F.lit("MISSING_HEADER").alias("code"), F.lit("").alias("detail"))
    due = sources.join(empty.hint("merge"), "source_id", "left_anti").select("source_id", F.explode(F.array(*[F.lit(r) for r in required])).alias("field"))
    lacking = due.join(mapping.hint("merge"), ["source_id", "field"], "left_anti").select("source_id", F.lit("MISSING_COLUMN").alias("code"), F.col("field").alias("detail"))
    return mapping, faults.union(empty).union(lacking)


def pivot_cells(cells: DataFrame, mapping: DataFrame, faults: DataFrame, fields: list[str]) -> DataFrame:
    """Cells (source_id, row_no, col_no, value, is_formula) as rows with one column per field, and whether the rank is a
    formula; a source with an error gives no rows."""
    bad = faults.where("code <> 'IGNORED_COLUMN'").select("source_id").distinct()
    x = cells.join(mapping.hint("merge"), ["source_id", "col_no"]).join(bad.hint("merge"), "source_id", "left_anti")
    columns = [F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in fields]
    formula = F.coalesce(F.bool_or((F.col("field") == "rank") & F.col("is_formula")), F.lit(False)).alias("is_formula")
    return x.groupBy("source_id", "row_no").agg(*columns, formula)


# Fixed value: the header of questions that have no rank of their own.
RANKLESS_QUESTIONS = ("昵称", "时间", "问题", "问答")


def question_profile(headers: DataFrame, exact=RANKLESS_QUESTIONS) -> DataFrame:
    """(source_id, profile): whether a source's headers are exactly the given ones without a rank, have a rank, or neither.

    For the first, blanks within a name count as little as around it; a rank is named as map_headers() binds it. A source whose
    header has neither has the fault of its profile, whatever else is wrong with it.
    """
    h = trim_blank_headers(headers.withColumn("given", F.col("name")).withColumn("name", normalize_header(F.col("name"))))
    in_order = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("col_no", c))), lambda x: x[c])
    g = h.withColumn("plain", normalize_exact(text_value(F.col("given")))).groupBy("source_id").agg(in_order("name").alias("names"), in_order("plain").alias("plain"))
    rank = F.arrays_overlap("names", F.array(*[F.lit(n) for n in QUESTION_ALIASES["rank"]]))
    return g.select("source_id", F.when(F.col("plain") == F.array(*[F.lit(e) for e in exact]), "by_order").when(rank, "by_rank").otherwise("INVALID_QUESTION_HEADER_PROFILE").alias("profile"))


def rank_by_order(rows: DataFrame) -> DataFrame:
    """Adds rank: the place of each row (source_id, row_no) in its source, for sheets that have no rank of their own."""
    n = numbered(rows.select("source_id", "row_no"), ["source_id"], ["row_no"], "rank")
    return rows.join(n.hint("merge"), ["source_id", "row_no"])


def preflight_gate(packs: DataFrame, faults: DataFrame, parsed: DataFrame, warnings: DataFrame) -> DataFrame:
    """(source_id, why, ready, warnings): whether a pack may be sent on, and the first reason why not: it has no name, its header
    has faults, nothing was parsed, or it was not confirmed. Warnings are counted and stop nothing.

    packs: source_id, name, confirmed; faults: of map_headers(); parsed: source_id of packs with rows; warnings: source_id of each.
    """
    bad = faults.where("code <> 'IGNORED_COLUMN'").select("source_id", F.lit(True).alias("_bad")).distinct()
    has = parsed.select("source_id", F.lit(True).alias("_parsed")).distinct()
    count = warnings.groupBy("source_id").agg(F.count(F.lit(1)).alias("_warnings"))
    x = packs
    for t in (bad, has, count):
        x = x.join(t.hint("merge"), "source_id", "left")
    why = F.when(is_blank(F.col("name")), "NAME_MISSING").when(F.col("_bad"), "HEADER_FAULT").when(F.col("_parsed").isNull(), "NOTHING_PARSED").when(~F.coalesce("confirmed", F.lit(False)), "NOT_CONFIRMED")
    return x.select("source_id", why.alias("why"), why.isNull().alias("ready"), F.coalesce("_warnings", F.lit(0)).cast("int").alias("warnings"))
