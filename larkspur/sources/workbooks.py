"""Workbooks and archives as tables: one row per cell, one row per member."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions.paths import is_temporary

# Bytes of a workbook file; members, bytes of one and of all members of an archive.
MOST_FILE, MOST_MEMBERS, MOST_MEMBER, MOST_ALL = 10 * 1024 * 1024, 120, 15 * 1024 * 1024, 60 * 1024 * 1024
CELLS = "path string, sheet_no int, sheet string, row_no int, col_no int, value string, is_formula boolean, error string"
MEMBERS = "path string, member string, size long, error string"
_CELL = re.compile(r"([A-Z]+)([0-9]+)")


def _name(tag: str) -> str:
    return tag.rpartition("}")[2]


def _column(letters: str) -> int:
    n = 0
    for c in letters:
        n = n * 26 + ord(c) - 64
    return n


def workbook_cells(content: bytes) -> Iterator[tuple]:
    """(sheet_no, sheet, row_no, col_no, value, is_formula) of every cell of a spreadsheet file."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        read = lambda n: ElementTree.fromstring(z.read(n))
        names = set(z.namelist())
        shared = ["".join(t.text or "" for t in x.iter() if _name(t.tag) == "t") for x in read("xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in names else []
        targets = {x.get("Id"): x.get("Target", "").lstrip("/").removeprefix("xl/") for x in read("xl/_rels/workbook.xml.rels")}
        sheets = [x for x in read("xl/workbook.xml").iter() if _name(x.tag) == "sheet"]
        for no, sheet in enumerate(sheets):
            rid = next((v for k, v in sheet.attrib.items() if _name(k) == "id"), "")
            for c in read(f"xl/{targets[rid]}").iter():
                at = _CELL.fullmatch(c.get("r", "")) if _name(c.tag) == "c" else None
                if not at:
                    continue
                parts = {_name(x.tag): x for x in c}
                value = parts["v"].text if "v" in parts else None
                if c.get("t") == "s" and value is not None:
                    value = shared[int(value)]
                elif c.get("t") == "inlineStr" and "is" in parts:
                    value = "".join(t.text or "" for t in parts["is"].iter() if _name(t.tag) == "t")
                yield no, sheet.get("name", ""), int(at[2]), _column(at[1]), value, "f" in parts


def scan_workbook_cells(spark: SparkSession, path: str, most: int = MOST_FILE) -> DataFrame:
    """Cells of all workbook files below a path; a file that is too large or cannot be read is one row with an error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "content")

    def cells(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [x.split()[0] for x in CELLS.split(", ")]
        for part in parts:
            for p, length, content in zip(part["path"], part["length"], part["content"], strict=True):
                try:
                    if length > most:
                        raise ValueError("FILE_TOO_LARGE")
                    rows = [(p, *c, None) for c in workbook_cells(content)]
                except (ValueError, KeyError, IndexError, zipfile.BadZipFile, ElementTree.ParseError) as e:
                    rows = [(p, None, None, None, None, None, None, str(e) if str(e) == "FILE_TOO_LARGE" else "UNREADABLE_FILE")]
                yield pd.DataFrame(rows, columns=columns)

    return files.mapInPandas(cells, CELLS)


def select_sheet(cells: DataFrame, name: str | None = None) -> DataFrame:
    """The cells of a file's first sheet, or of the sheet of that name."""
    return cells.where(F.col("sheet_no") == 0 if name is None else F.col("sheet") == name)


# The sheets of a workbook with both lists of reviews, in their order.
REVIEW_SHEETS = {"default_reviews": "默认排序评价", "recent_reviews": "时间排序评价"}


def choose_sheets(packs: DataFrame, sheets: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(chosen, faults, warnings) of packs of files (product_id, default_file, recent_file, review_file) and the sheets (path, sheet, sheet_no) in them.

    A pack with a file of its own for either list has the first sheet of each; else the lists are the two sheets of the review file
    that have their names, whose order must be that of the lists. Temporary files count as none and have a warning. chosen:
    (product_id, kind, path, sheet); faults: (product_id, kind, code), MISSING_REVIEW_FILE, MISSING_REVIEW_SHEET or
    RANK_ORDER_CONFLICT, kind blank where both lists are meant; warnings: (product_id, detail).
    """
    names = ["default_file", "recent_file", "review_file"]
    temporary = {n: F.coalesce(is_temporary(F.element_at(F.split(n, "/"), -1)), F.lit(False)) for n in names}
    warnings = packs.select("product_id", F.explode(F.array_compact(F.array(*[F.when(temporary[n], F.col(n)) for n in names]))).alias("detail"))
    x = packs.select("product_id", (F.col("default_file").isNotNull() | F.col("recent_file").isNotNull()).alias("apart"), *[F.when(~temporary[n], F.col(n)).alias(n) for n in names])
    wish = lambda kind, path, sheet: F.struct(F.lit(kind).alias("kind"), path.alias("path"), sheet.alias("name"))
    alone = F.array(*[wish(k, F.col(n), F.lit(None).cast("string")) for k, n in zip(REVIEW_SHEETS, names, strict=False)])
    both = F.array(*[wish(k, F.col("review_file"), F.lit(s)) for k, s in REVIEW_SHEETS.items()])
    wanted = x.select("product_id", "apart", F.explode(F.when(F.col("apart"), alone).otherwise(both)).alias("w")).select("product_id", "apart", "w.*")
    no_file = wanted.where("path IS NULL").select("product_id", F.when(F.col("apart"), F.col("kind")).otherwise("").alias("kind"), F.lit("MISSING_REVIEW_FILE").alias("code")).distinct()
    found = sheets.select("path", "sheet", "sheet_no").distinct()
    here = wanted.where("path IS NOT NULL").join(found.hint("merge"), "path", "left")
    fits = F.coalesce(F.when(F.col("name").isNull(), F.col("sheet_no") == 0).otherwise(F.col("sheet") == F.col("name")), F.lit(False))
    first = here.groupBy("product_id", "kind", "path", "apart").agg(F.min(F.when(fits, F.struct("sheet_no", "sheet"))).alias("s"))
    chosen = first.where("s IS NOT NULL").select("product_id", "kind", "path", "s.sheet")
    no_sheet = first.where("s IS NULL").select("product_id", "kind", F.lit("MISSING_REVIEW_SHEET").alias("code"))
    at = {k: F.min(F.when(F.col("kind") == k, F.col("s.sheet_no"))) for k in REVIEW_SHEETS}
    turned = first.where("NOT apart").groupBy("product_id").agg((at["default_reviews"] > at["recent_reviews"]).alias("turned")).where("turned").select("product_id", F.lit("").alias("kind"), F.lit("RANK_ORDER_CONFLICT").alias("code"))
    return chosen, no_file.unionByName(no_sheet).unionByName(turned), warnings


def sheet_conflicts(cells: DataFrame, first: str, second: str) -> DataFrame:
    """(path, code) of files that lack one of two sheets or have them in the wrong order."""
    s = cells.groupBy("path").agg(F.min(F.when(F.col("sheet") == first, F.col("sheet_no"))).alias("a"), F.min(F.when(F.col("sheet") == second, F.col("sheet_no"))).alias("b"))
    code = F.when(F.col("a").isNull() | F.col("b").isNull(), "MISSING_REVIEW_SHEET").when(F.col("a") > F.col("b"), "RANK_ORDER_CONFLICT")
    return s.select("path", code.alias("code")).where("code IS NOT NULL")


def list_archive_entries(spark: SparkSession, path: str) -> DataFrame:
    """Members of all archives below a path, without folders and system files; names that are not UTF-8 are taken as GBK.
    An archive beyond the limits, encrypted or unreadable is one row with an error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def one(p: str, content: bytes) -> list[tuple]:
        try:
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                infos = [i for i in z.infolist() if not re.search(r"/$|(?:^|/)__MACOSX/|(?:^|/)\.DS_Store$", i.filename)]
                if any(i.flag_bits & 1 for i in infos):
                    return [(p, None, None, "ENCRYPTED")]
                if len(infos) > MOST_MEMBERS or sum(i.file_size for i in infos) > MOST_ALL or any(i.file_size > MOST_MEMBER for i in infos):
                    return [(p, None, None, "OVER_LIMIT")]
                return [(p, i.filename if i.flag_bits & 0x800 else i.filename.encode("cp437").decode("gbk", "replace"), i.file_size, None) for i in infos]
        except (zipfile.BadZipFile, UnicodeError, ValueError):
            return [(p, None, None, "UNREADABLE_FILE")]

    def members(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for p, content in zip(part["path"], part["content"], strict=True):
                yield pd.DataFrame(one(p, content), columns=["path", "member", "size", "error"])

    return files.mapInPandas(members, MEMBERS)


