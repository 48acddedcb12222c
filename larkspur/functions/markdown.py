"""Markdown cells and headings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from larkspur.functions.text import SPACE, strip

ESCAPED = "\x00"


def clean_cell(cell: Column) -> Column:
    """A table cell as plain text: line breaks, bold and code marks, entities."""
    c = F.regexp_replace(strip(cell), r"(?i)<br\s*/?>", "\n")
    for pattern, to in ((r"\*\*(.*?)\*\*", "$1"), (r"__(.*?)__", "$1"), (r"`([^`]*)`", "$1"), ("(?i)&nbsp;", " "), ("(?i)&amp;", "&"), ("(?i)&lt;", "<"), ("(?i)&gt;", ">"), ("(?i)&quot;", '"'), ("(?i)&#39;", "'")):
        c = F.regexp_replace(c, pattern, to)
    return c


def split_row(line: Column) -> Column:
    """Cells of a table line, null without a pipe; an escaped pipe belongs to its cell, outer pipes go."""
    plain = strip(line)
    inner = F.regexp_replace(F.regexp_replace(plain, r"^\|", ""), r"\|$", "")
    cells = F.split(F.replace(inner, F.lit("\\|"), F.lit(ESCAPED)), r"\|", -1)
    return F.when(F.contains(plain, F.lit("|")), F.transform(cells, lambda c: clean_cell(F.replace(c, F.lit(ESCAPED), F.lit("|")))))


def is_separator(cells: Column) -> Column:
    return F.coalesce((F.size(cells) > 0) & F.forall(cells, lambda c: F.regexp_replace(c, SPACE, "").rlike("^:?-{3,}:?$")), F.lit(False))


def clean_heading(text: Column) -> Column:
    h = F.regexp_replace(F.regexp_replace(text, r"\*\*(.*?)\*\*", "$1"), r"`([^`]*)`", "$1")
    return strip(F.regexp_replace(h, f"^[一二三四五六七八九十0-9]+[、.．]{SPACE}*", ""))


def fit_width(cells: Column, width: Column) -> Column:
    """Cells cut or filled up with empty ones."""
    return F.slice(F.concat(cells, F.array_repeat(F.lit(""), width.cast("int"))), F.lit(1), width.cast("int"))
