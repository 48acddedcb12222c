"""Exact duplicates and matches between two lists."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.functions.text import SPACE, is_ascii, normalize_exact
from larkspur.operators.aggregates import share
from larkspur.operators.numbering import numbered
from larkspur.plans.spill import written

#: Row ids that one row of a result holds at most.
IDS = 1000


def with_text_key(rows: DataFrame, text: str) -> DataFrame:
    """rows without their text, with ``key``: digest of the text's normal form; written, so that each text is read once.

    Only texts that are not ASCII alone go through the normalisation of Unicode in Python, one at a time; digests come back.
    """
    others = [c for c in rows.columns if c != text]
    plain = rows.where(is_ascii(F.col(text))).select(*others, F.md5(normalize_exact(F.col(text), False)).alias("key"))
    wide = rows.where(~is_ascii(F.col(text))).select(*others, text)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = re.compile(SPACE)
        for b in batches:
            keys = [hashlib.md5(space.sub("", unicodedata.normalize("NFKC", t.as_py())).encode()).hexdigest() for t in b.column(len(others))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(keys, pa.string())], [*others, "key"])

    return written(plain.unionByName(wide.mapInArrow(digests, plain.schema)))


def duplicate_groups(rows: DataFrame) -> DataFrame:
    """(source_id, key, size, part, row_ids in order) of keys that a source has more than once. rows: (source_id, key, row_id).

    A key of many rows is several parts of 1,000 row ids; ids are gathered after keys with one row are gone.
    """
    often = rows.groupBy("source_id", "key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    n = numbered(rows.select("source_id", "key", "row_id").join(often.hint("merge"), ["source_id", "key"]), ["source_id", "key"], ["row_id"])
    part = (F.floor((F.col("n") - 1) / IDS) + 1).alias("part")
    return n.groupBy("source_id", "key", "size", part).agg(F.array_sort(F.collect_list("row_id")).alias("row_ids"))


def occurrence_number(rows: DataFrame) -> DataFrame:
    """Adds n: this is the n-th row of its product, list and key. Keys are digests here, so wide texts are not sorted."""
    return numbered(rows, ["product_id", "sort", "key"], ["row_id"])


def multiset_match(rows: DataFrame) -> DataFrame:
    """(product_id, key, n, default_row, recent_row): the k-th default row of a text with the k-th recent one.

    Only keys that both lists have are numbered.
    """
    both = rows.groupBy("product_id", "key").agg(F.min("sort").alias("a"), F.max("sort").alias("b")).where("a < b").select("product_id", "key")
    n = occurrence_number(rows.select("product_id", "sort", "key", "row_id").join(both.hint("merge"), ["product_id", "key"], "left_semi"))
    left = n.where("sort = 'default'").select("product_id", "key", "n", F.col("row_id").alias("default_row"))
    right = n.where("sort = 'recent'").select("product_id", "key", "n", F.col("row_id").alias("recent_row"))
    return left.join(right.hint("merge"), ["product_id", "key", "n"])


def cross_list_overlap(rows: DataFrame, matches: DataFrame) -> DataFrame:
    """Per product: matched pairs, rows of both lists, the sources of each, share of the smaller one. Products without a match
    are kept. The row ids of the pairs are those of ``matches``."""
    side = lambda s: F.count_if(F.col("sort") == s).alias(f"{s}_rows")
    ids = lambda s: F.array_sort(F.collect_set(F.when(F.col("sort") == s, F.col("source_id")))).alias(f"{s}_sources")
    size = rows.groupBy("product_id").agg(side("default"), side("recent"), ids("default"), ids("recent"))
    n = matches.groupBy("product_id").agg(F.count(F.lit(1)).alias("pairs"))
    pairs = F.coalesce("pairs", F.lit(0))
    return size.join(n.hint("merge"), "product_id", "left").select(
        "product_id", pairs.alias("pairs"), "default_rows", "recent_rows", "default_sources", "recent_sources", share(pairs, F.least("default_rows", "recent_rows")).alias("overlap")
    )


def text_intersect_all(rows: DataFrame) -> DataFrame:
    """(product_id, pairs): size of the bag intersection of both lists' texts."""
    side = lambda s: rows.where(F.col("sort") == s).select("product_id", "key")
    return side("default").intersectAll(side("recent")).groupBy("product_id").agg(F.count(F.lit(1)).alias("pairs"))
