"""Queries over header cells and grids: documents' sources as sheets whose headers vary by rule."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.operators import integrity as I
from larkspur.operators import report as R
from larkspur.operators import validate_rows as V
from larkspur.operators.numbering import numbered
from larkspur.plans import bindings as B
from larkspur.plans import review_queries as RQ
from larkspur.plans.registry import query
from larkspur.plans.spill import written
from larkspur.schemas import FINDINGS
from larkspur.sources import headers as H
from larkspur.sources import workbooks as W


def sheets(s, d):
    return B.table(s, d, "documents").select(F.col("source").alias("source_id"), F.regexp_extract("source", "([0-9]+)$", 1).cast("int").alias("k")).distinct()


def pages(s, d):
    """Every document as a sheet of its own."""
    return B.table(s, d, "documents").select(F.col("doc_id").cast("string").alias("source_id"), F.col("doc_id").alias("k"))


def headers(given):
    """A header row per sheet: every third has a second text column, every fourth an unknown one and no date, each fifth blanks."""
    k = F.col("k")
    names = F.array(
        F.lit(" 序号"), F.when(k % 4 == 0, "备注").otherwise("评价时间"), F.lit("ＳＫＵ"), F.lit("初评内容"), F.when(k % 3 == 0, "评价内容").otherwise(""), F.lit("　"),
    )
    return given.select("source_id", F.posexplode(names).alias("p", "name")).select("source_id", (F.col("p") + 1).alias("col_no"), "name")


def mapped(s, given):
    return H.map_headers(headers(given), H.alias_table(s, H.REVIEW_ALIASES), ["rank", "initialText", "date"])


PAGES = "sheets AS (SELECT CAST(doc_id AS VARCHAR) AS source_id, doc_id AS k FROM documents)"
SHEETS = "sheets AS (SELECT DISTINCT source AS source_id, CAST(regexp_extract(source, '([0-9]+)$', 1) AS INTEGER) AS k FROM documents)"
query("trim_blank_headers", f"WITH {PAGES} SELECT source_id, CAST(CASE WHEN k % 3 = 0 THEN 5 ELSE 4 END AS BIGINT) AS n FROM sheets")(
    lambda s, d: H.trim_blank_headers(headers(pages(s, d)).withColumn("name", F.regexp_replace("name", "　", ""))).groupBy("source_id").agg(F.count(F.lit(1)).alias("n"))
)
query("map_headers", f"WITH {PAGES} SELECT source_id, field, CAST(col_no AS INTEGER) AS col_no FROM sheets, (VALUES ('rank', 1), ('date', 2), ('sku', 3), ('initialText', 4)) v(field, col_no) WHERE field <> 'date' OR k % 4 <> 0")(lambda s, d: mapped(s, pages(s, d))[0])
query("header_diagnostics", f"WITH {PAGES} SELECT source_id, 'UNKNOWN_COLUMN' AS code, '备注' AS detail FROM sheets WHERE k % 4 = 0 UNION ALL SELECT source_id, 'MISSING_COLUMN', 'date' FROM sheets WHERE k % 4 = 0 UNION ALL SELECT source_id, 'DUPLICATE_COLUMN', '评价内容' FROM sheets WHERE k % 3 = 0")(
    lambda s, d: mapped(s, pages(s, d))[1]
)


@query("pivot_cells", f"WITH {SHEETS}, n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) + 1 AS row_no FROM documents) SELECT source AS source_id, CAST(row_no AS INTEGER) AS row_no, CAST(doc_id AS VARCHAR) AS rank, lang AS sku, md5(text) AS \"initialText\", doc_id % 17 = 0 AS is_formula FROM n JOIN sheets ON source = source_id WHERE k % 12 NOT IN (0, 3, 4, 6, 8, 9)")
def _(s, d):
    doc = B.table(s, d, "documents").select("doc_id", "source", "lang", "text")
    doc = doc.join(numbered(doc.select("source", "doc_id"), ["source"], ["doc_id"], "n").select("doc_id", (F.col("n") + 1).cast("int").alias("row_no")).hint("merge"), "doc_id")
    values = F.array(*[F.struct(F.lit(c).alias("col_no"), v.alias("value"), f.alias("is_formula")) for c, v, f in (
        (1, F.col("doc_id").cast("string"), F.col("doc_id") % 17 == 0), (3, F.col("lang"), F.lit(False)), (4, F.md5("text"), F.lit(False)))])
    cells = doc.select(F.col("source").alias("source_id"), "row_no", F.explode(values).alias("c")).select("source_id", "row_no", "c.*")
    mapping, faults = mapped(s, sheets(s, d))
    return H.pivot_cells(cells, mapping, faults, ["rank", "sku", "initialText"])


query("question_profile", f"WITH {PAGES} SELECT source_id, CASE k % 4 WHEN 0 THEN 'by_order' WHEN 1 THEN 'by_rank' ELSE 'INVALID_QUESTION_HEADER_PROFILE' END AS profile FROM sheets")(
    lambda s, d: H.question_profile(
        pages(s, d).select("source_id", F.posexplode(
            F.when(F.col("k") % 4 == 0, F.array(*map(F.lit, ("昵 称", "时间　", "问题", "问答", "")))).when(F.col("k") % 4 == 1, F.array(*map(F.lit, (" 序号", "问题", "回答"))))
            .when(F.col("k") % 4 == 2, F.array(*map(F.lit, ("昵称", "时间", "问题", "回答")))).otherwise(F.array(*map(F.lit, ("问题", "回答"))))
        ).alias("col_no", "name"))
    )
)
query("row_and_source_ids", "SELECT source || ':default_reviews' AS source_id, source || ':default_reviews:' || (row_number() OVER (PARTITION BY source ORDER BY doc_id) + 1) AS row_id FROM documents")(
    lambda s, d: V.with_row_ids(B.grid_docs(s, d), "default_reviews", "source_id").select("source_id", "row_id")
)
query("select_sheet", "SELECT source AS path, doc_id, lang AS sheet FROM documents WHERE lang = 'en'")(
    lambda s, d: W.select_sheet(B.table(s, d, "documents").select(F.col("source").alias("path"), "doc_id", F.col("lang").alias("sheet"), F.lit(None).cast("int").alias("sheet_no")), "en").select("path", "doc_id", "sheet")
)
PACKS = "packs AS (SELECT CAST(doc_id AS VARCHAR) AS product_id, doc_id % 8 AS m FROM documents)"


def packs(s, d):
    """Documents as packs: with files of their own for the lists, one of them temporary or missing; with a file for both that lacks a
    sheet, has them in the wrong order or is missing; with a file that has no sheet at all."""
    m, k = F.col("doc_id") % 8, F.col("doc_id").cast("string")
    name = lambda part: F.concat(F.lit("up/"), k, F.lit(f"_{part}.xlsx"))
    p = B.table(s, d, "documents").select(
        k.alias("product_id"), F.when(m.isin(0, 2), name("a")).when(m == 1, F.concat(F.lit("up/~$"), k, F.lit(".xlsx"))).alias("default_file"), F.when(m.isin(0, 1), name("b")).alias("recent_file"), F.when(m.isin(3, 4, 5, 7), name("c")).alias("review_file"), m.alias("m")
    )
    first, second = W.REVIEW_SHEETS.values()
    sheets_of = lambda path, array: p.select(path.alias("path"), F.posexplode(array).alias("sheet_no", "sheet")).where("path IS NOT NULL")
    m = F.col("m")
    names = F.when(m == 3, F.array(F.lit("x"), F.lit(first), F.lit(second))).when(m == 4, F.array(F.lit(second), F.lit(first))).when(m == 5, F.array(F.lit(first), F.lit("y")))
    sheets = sheets_of(F.col("default_file"), F.array(F.lit("s0"), F.lit("s1"))).unionByName(sheets_of(F.col("recent_file"), F.array(F.lit("t0")))).unionByName(sheets_of(F.col("review_file"), names))
    return W.choose_sheets(p.drop("m"), sheets.where("path NOT LIKE '%~$%'"))


FIRST_SHEET, SECOND_SHEET = W.REVIEW_SHEETS.values()
query("choose_sheets", f"""WITH {PACKS} SELECT product_id, 'default_reviews' AS kind, 'up/' || product_id || '_a.xlsx' AS path, 's0' AS sheet FROM packs WHERE m IN (0, 2) UNION ALL SELECT product_id, 'recent_reviews', 'up/' || product_id || '_b.xlsx', 't0' FROM packs WHERE m IN (0, 1)
  UNION ALL SELECT product_id, 'default_reviews', 'up/' || product_id || '_c.xlsx', '{FIRST_SHEET}' FROM packs WHERE m IN (3, 4, 5) UNION ALL SELECT product_id, 'recent_reviews', 'up/' || product_id || '_c.xlsx', '{SECOND_SHEET}' FROM packs WHERE m IN (3, 4)""")(lambda s, d: packs(s, d)[0])
query("sheet_faults", f"""WITH {PACKS} SELECT product_id, CASE m WHEN 1 THEN 'default_reviews' WHEN 2 THEN 'recent_reviews' ELSE '' END AS kind, 'MISSING_REVIEW_FILE' AS code FROM packs WHERE m IN (1, 2, 6) UNION ALL SELECT product_id, '', 'RANK_ORDER_CONFLICT' FROM packs WHERE m = 4
  UNION ALL SELECT product_id, 'recent_reviews', 'MISSING_REVIEW_SHEET' FROM packs WHERE m IN (5, 7) UNION ALL SELECT product_id, 'default_reviews', 'MISSING_REVIEW_SHEET' FROM packs WHERE m = 7""")(lambda s, d: packs(s, d)[1])
query("sheet_warnings", f"WITH {PACKS} SELECT product_id, 'up/~$' || product_id || '.xlsx' AS detail FROM packs WHERE m = 1")(lambda s, d: packs(s, d)[2])
query("sheet_conflicts", f"WITH {PAGES} SELECT source_id, CASE WHEN k % 5 = 0 THEN 'MISSING_REVIEW_SHEET' ELSE 'RANK_ORDER_CONFLICT' END AS code FROM sheets WHERE k % 5 = 0 OR k % 2 = 1")(
    lambda s, d: _conflicts(s, d)
)


def _conflicts(s, d):
    k = F.col("k")
    names = F.when(k % 5 == 0, F.array(F.lit("default"))).when(k % 2 == 1, F.array(F.lit("recent"), F.lit("default"))).otherwise(F.array(F.lit("default"), F.lit("recent")))
    cells = pages(s, d).select(F.col("source_id").alias("path"), F.posexplode(names).alias("sheet_no", "sheet"))
    return W.sheet_conflicts(cells, "default", "recent").withColumnRenamed("path", "source_id")


@query("preflight_gate", f"""WITH {SHEETS}, used AS (SELECT source AS source_id, count(*) AS n FROM documents GROUP BY 1) SELECT source_id, CASE WHEN k % 7 = 0 THEN 'NAME_MISSING' WHEN k % 4 = 0 OR k % 3 = 0 THEN 'HEADER_FAULT' WHEN n < 5 THEN 'NOTHING_PARSED' WHEN k % 5 = 0 THEN 'NOT_CONFIRMED' END AS why,
  NOT (k % 7 = 0 OR k % 4 = 0 OR k % 3 = 0 OR n < 5 OR k % 5 = 0) AS ready, CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END AS warnings FROM sheets JOIN used USING (source_id)""")
def _(s, d):
    """Sources as packs: some without a name, with faults in their header, with too few rows or not confirmed; some with warnings."""
    k = F.col("k")
    packs = sheets(s, d).select("source_id", F.when(k % 7 == 0, " ").otherwise(F.col("source_id")).alias("name"), (k % 5 != 0).alias("confirmed"))
    used = B.table(s, d, "documents").groupBy(F.col("source").alias("source_id")).agg(F.count(F.lit(1)).alias("n")).where("n >= 5").select("source_id")
    warnings = sheets(s, d).where(k % 2 == 0).select("source_id")
    return H.preflight_gate(packs, mapped(s, sheets(s, d))[1], used, warnings)


@query("by_order_ranks", "SELECT source AS source_id, doc_id AS row_no, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS BIGINT) AS rank FROM documents")
def _(s, d):
    return H.rank_by_order(B.table(s, d, "documents").select(F.col("source").alias("source_id"), F.col("doc_id").alias("row_no"), "text")).select("source_id", "row_no", "rank")


query("union_packs", "SELECT product_id, count(*) AS n, count(extra) AS extras FROM (SELECT lang AS product_id, NULL AS extra FROM documents UNION ALL SELECT source, doc_id FROM documents) GROUP BY 1")(
    lambda s, d: V.union_packs(B.table(s, d, "documents").select(F.col("lang").alias("product_id")), B.table(s, d, "documents").select(F.col("source").alias("product_id"), F.col("doc_id").alias("extra")))
    .groupBy("product_id").agg(F.count(F.lit(1)).alias("n"), F.count("extra").alias("extras"))
)
query("screenshot_tags_flatten", "SELECT role AS product_id, x AS name, len(x) AS count FROM (SELECT role, unnest(regexp_extract_all(text, '[a-z]+')) AS x FROM conversations)")(
    lambda s, d: R.flatten_tags(B.table(s, d, "conversations").select(F.col("role").alias("product_id"), F.transform(F.regexp_extract_all("text", F.lit("[a-z]+"), 0), lambda x: F.struct(x.alias("name"), F.length(x).cast("long").alias("count"))).alias("tags")))
)
query("cross_catalog", f"WITH {B.PRODUCTS_ORDERS}, {B.PRIORITIES} SELECT product_id, type_id FROM products, types")(lambda s, d: V.every_pair(B.products_orders(s, d), written(B.priorities(s, d)), "type_id"))


@query("gate_then_write", f"WITH {RQ.DENSE} SELECT source_id, used_rows FROM sources")
def _(s, d):
    """Sources that are written only because the check of their anchors finds nothing, and read back."""
    from larkspur.plans.spill import scratch_path

    rows = RQ.all_sources(s, d).select("source_id", "used_rows")
    path = scratch_path(s)
    I.write_if_clean(rows, I.repeated(rows, "source_id", "SOURCE_ANCHOR_MISMATCH"), path)
    return s.read.schema(rows.schema).parquet(path)


FACTS = f"""SELECT 'REPEATED_PRODUCT' AS code, product_id AS object_id FROM products WHERE product_id = 'MACHINERY' UNION ALL SELECT 'NO_OWN_PRODUCT', 'products' UNION ALL SELECT 'UNKNOWN_PRODUCT', 'x:' || product_id FROM products
  UNION ALL SELECT 'REPEATED_EVIDENCE', 'AGG:BUILDING' UNION ALL SELECT 'UNKNOWN_EVIDENCE', 'AGG:none' UNION ALL SELECT 'UNKNOWN_FINDING', 'F09' UNION ALL SELECT 'REPEATED_FINDING', 'F02'"""


@query("validate_facts", f"WITH {B.PRODUCTS_ORDERS} {FACTS}")
def _(s, d):
    """Facts and a proposal with a fault of each kind."""
    p = B.products_orders(s, d).select("product_id", F.lit("competitor").alias("role"))
    given = p.union(p.where("product_id = 'MACHINERY'"))
    cited = p.select("product_id", F.concat(F.lit("AGG:"), "product_id").alias("evidence_id"))
    cited = cited.union(cited.where("product_id = 'BUILDING'")).union(p.select(F.concat(F.lit("x:"), "product_id"), F.concat(F.lit("x:"), "product_id")))
    proposals = s.createDataFrame([("F01", ["AGG:BUILDING"]), ("F02", ["AGG:none"]), ("F02", []), ("F09", ["AGG:BUILDING"])], "finding_id string, evidence_ids array<string>")
    return I.validate_facts(given, cited, proposals, FINDINGS)
