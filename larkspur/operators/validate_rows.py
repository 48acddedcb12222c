"""Rows of a sheet, used or excluded with a reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.text import is_blank, rank_value
from larkspur.operators.joins import join_written, small
from larkspur.schemas import READY_ROWS, SOURCE_CAP


def status_of(used: Column, ready: int = READY_ROWS, full: int = SOURCE_CAP) -> Column:
    return F.when(used == 0, "missing").when(used < ready, "insufficient").when(used < full, "provisional").otherwise("complete")


def early_reason(rows: DataFrame, empty: list[tuple[str, str]]) -> DataFrame:
    """Adds rank and the first of the reasons that a row shows by itself; empty: (column, reason) in order."""
    reason = F.when(F.col("is_formula"), "FORMULA_RANK").when(F.col("rank").isNull(), "MISSING_RANK")
    for column, code in empty:
        reason = reason.when(is_blank(F.col(column)), code)
    return rows.withColumn("rank", rank_value(F.col("rank_text"))).withColumn("early", reason)


def exclude_rows(rows: DataFrame, empty: list[tuple[str, str]], cap: int = SOURCE_CAP) -> DataFrame:
    """Adds ``reason``: USED or the first exclusion that holds.

    A rank belongs to its first row that passes the earlier tests; the first ``cap`` such rows of a source are used. What comes
    after the last of them is OVER_LIMIT, also a repeat of such a rank; other repeats are DUPLICATE_RANK. Rows that show their
    reason by themselves, as those without a rank, take no part in the join. Only narrow columns are sorted: first rows per
    rank by an aggregate, the cut of a source by a limited window over those.
    """
    e = early_reason(rows, empty)
    due = e.where("early IS NULL")
    firsts = due.groupBy("source_id", "rank").agg(F.min("row_no").alias("first_row"))
    order = Window.partitionBy("source_id").orderBy("first_row")
    cuts = firsts.withColumn("n", F.row_number().over(order)).where(F.col("n") <= cap).groupBy("source_id").agg(F.max("first_row").alias("cut"))
    joined = due.join(firsts.join(cuts.hint("merge"), "source_id").hint("merge"), ["source_id", "rank"])
    late = F.when(F.col("first_row") > F.col("cut"), "OVER_LIMIT").when(F.col("row_no") > F.col("first_row"), "DUPLICATE_RANK").otherwise("USED")
    done = e.where("early IS NOT NULL").withColumn("reason", F.col("early"))
    return done.drop("early").unionByName(joined.withColumn("reason", late).drop("early", "first_row", "cut"))


def with_row_ids(rows: DataFrame, kind: str, product: str = "product_id") -> DataFrame:
    """Adds source_id (product:kind) and row_id (product:kind:row number)."""
    return rows.withColumns({"source_id": F.concat_ws(":", product, F.lit(kind)), "row_id": F.concat_ws(":", product, F.lit(kind), "row_no")})


def of_list(rows: DataFrame, products: DataFrame, sort: str, role: str) -> DataFrame:
    """Rows of one list of the products of one role; rows are shuffled only if the products are many."""
    return join_written(rows.where(F.col("sort") == sort), products.where(F.col("role") == role).select("product_id"), "product_id", "left_semi")


def union_packs(*packs: DataFrame) -> DataFrame:
    """Rows of several products' packs, columns by name, those that a pack lacks as nulls."""
    out = packs[0]
    for p in packs[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def every_pair(products: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """Each product with each id of a catalog; that is broadcast if it is small."""
    return products.select("product_id").crossJoin(small(names.select(key)))


def known_products(rows: DataFrame, products: DataFrame) -> DataFrame:
    """Adds whether the row's product is one of the given ones."""
    k = products.select("product_id", F.lit(True).alias("known")).distinct()
    return join_written(rows, k, "product_id", "left").withColumn("known", F.coalesce("known", F.lit(False)))


def without_products(rows: DataFrame, gone: DataFrame) -> DataFrame:
    return join_written(rows, gone.select("product_id"), "product_id", "left_anti")


def first_by_rank(rows: DataFrame) -> DataFrame:
    """(source_id, rank, row_no): the first row of each rank among rows that pass the early tests."""
    return rows.where("early IS NULL").groupBy("source_id", "rank").agg(F.min("row_no").alias("row_no"))


def sample_cap(rows: DataFrame, cap: int) -> DataFrame:
    """The first rows of each source, by row number."""
    order = Window.partitionBy("source_id").orderBy("row_no")
    return rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= cap).drop("n")


def source_summary(judged: DataFrame, ready: int, full: int) -> DataFrame:
    """Counts of each source: rows read, valid, used, excluded, over the limit, and its status."""
    used, over = F.count_if(F.col("reason") == "USED"), F.count_if(F.col("reason") == "OVER_LIMIT")
    s = judged.groupBy("source_id").agg(F.count(F.lit(1)).alias("rows_read"), used.alias("used_rows"), over.alias("excluded_over_limit"))
    return s.select(
        "source_id", "rows_read", (F.col("used_rows") + F.col("excluded_over_limit")).alias("valid_rows"), "used_rows",
        (F.col("rows_read") - F.col("used_rows")).alias("excluded_rows"), "excluded_over_limit", status_of(F.col("used_rows"), ready, full).alias("status"),
    )


def exclusion_counts(judged: DataFrame) -> DataFrame:
    return judged.where("reason <> 'USED'").groupBy("source_id", "reason").agg(F.count(F.lit(1)).alias("n"))


def densify_sources(products: DataFrame, kinds: DataFrame, counts: DataFrame) -> DataFrame:
    """A source row for every product and kind; one without rows is missing. counts: (product_id, kind, used_rows)."""
    n = F.coalesce("used_rows", F.lit(0)).cast("long")
    dense = products.select("product_id").crossJoin(small(kinds)).join(counts, ["product_id", "kind"], "left")
    return dense.select(F.concat_ws(":", "product_id", "kind").alias("source_id"), "product_id", "kind", n.alias("used_rows"), status_of(n).alias("status"))


def completeness(products: DataFrame, summary: DataFrame, expected: int = SOURCE_CAP, ready: int = READY_ROWS) -> DataFrame:
    """One evidence row per source (product_id, kind, counts); sources of unknown products come with known = false."""
    known = products.select("product_id", "role")
    kind = F.concat_ws("_", "role", "kind")
    return summary.join(known, "product_id", "left").select(
        F.concat_ws("-", F.lit("DATA"), "product_id", "kind").alias("evidence_id"), "product_id", kind.alias("kind"), F.lit(expected).alias("expected_rows"),
        "valid_rows", "used_rows", "excluded_over_limit", "status", (F.col("used_rows") < ready).alias("blocking"), F.col("role").isNotNull().alias("known"),
    )
