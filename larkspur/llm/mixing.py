"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.common import drop, join_checked, scratch, word_count

#: Documents in a bucket of a source's ranking, and the most buckets a source has.
BUCKET_DOCS, MAX_BUCKETS = 128, 1 << 20


def document_sizes(docs: DataFrame, *more: Column) -> DataFrame:
    """skey (the source, null as well), item (what names the document in its source), size (words) and class of every row.

    The class is the number of binary digits of the size: the measure that inclusion follows, so that a document of 1,000
    words is expected about twice as often as one of 30.
    """
    item = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.md5(F.coalesce("text", F.lit("")))))
    size = word_count(F.col("text"))
    return docs.select(*more, F.coalesce(F.concat(F.lit("="), "source"), F.lit("none")).alias("skey"), item.alias("item"), size.alias("size"), F.length(F.bin(size)).alias("class"))


def uniform(item: Column, seed: str) -> Column:
    """A number in (0, 1) from a document's name: 52 bits of a digest, the same in every run."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), item))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, weights=(5, 2, 1), share: float = 1.5, max_copies: int = 2) -> DataFrame:
    """(source, source_size, docs, target) from parts (source, size, docs): sources by code point, null last, weigh ``weights`` in turn.

    ``share`` times all sizes is shared by weight; what a source would get above ``max_copies`` times its size is shared
    again. In order of cap per weight, the level at which the rest of the sources take the rest of the words is a running
    sum, so no loop is needed. One row per source is sorted in one task.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())  # of one row per source
    by_ratio = Window.orderBy("ratio", "rn")
    every = Window.partitionBy()
    table = F.array(*[F.lit(int(w)).cast("long") for w in weights])
    t = (
        sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum("docs").alias("docs"))
        .withColumn("rn", F.row_number().over(by_name))
        .withColumn("w", F.element_at(table, ((F.col("rn") - 1) % len(weights) + 1).cast("int")))
        .withColumn("cap", F.col("source_size") * max_copies)
        .withColumn("ratio", F.col("cap").cast("double") / F.col("w"))
    )
    t = (
        t.withColumn("budget", F.sum("source_size").over(every).cast("double") * F.lit(float(share)))
        .withColumn("before", F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, 0)) - F.col("cap"))
        .withColumn("rest", F.sum("w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("at", (F.col("budget") - F.col("before")) / F.col("rest"))
        .withColumn("level", F.max(F.when(F.col("at") <= F.col("ratio"), F.col("at"))).over(every))
    )
    full = F.col("level").isNull() | (F.col("ratio") <= F.col("level"))
    return t.select("source", "source_size", "docs", F.when(full, F.col("cap").cast("double")).otherwise(F.col("w") * F.col("level")).alias("target"))


def expected_copies(strata: DataFrame, max_copies: int = 2) -> DataFrame:
    """strata (skey, class, words, target) with ``expected`` copies of each document of a class of a source.

    Expected copies are in proportion to the class, none above ``max_copies``, and the words they stand for add up to the
    target. From the largest class on, the factor that the classes not yet at the limit would have is a running sum; the
    largest that leaves its class within the limit holds. A source has few classes: digits of a word count.
    """
    by_class = Window.partitionBy("skey").orderBy(F.desc("class"))
    mass = F.col("class") * F.col("words")
    at = F.try_divide(
        F.col("target") - F.col("full_before") * float(max_copies),
        (F.sum(mass).over(Window.partitionBy("skey")) - F.sum(mass).over(by_class.rowsBetween(Window.unboundedPreceding, 0)) + mass).cast("double"),
    )
    t = strata.withColumn("full_before", F.sum("words").over(by_class.rowsBetween(Window.unboundedPreceding, 0)) - F.col("words")).withColumn("at", at)
    t = t.withColumn("factor", F.max(F.when(F.col("at") * F.col("class") <= max_copies, F.col("at"))).over(Window.partitionBy("skey")))
    expected = F.least(F.lit(float(max_copies)), F.coalesce(F.col("factor") * F.col("class"), F.lit(float(max_copies))))
    return t.withColumn("expected", F.when(F.col("target") > 0, expected).otherwise(F.lit(0.0))).drop("full_before", "at", "factor")


def _order_key(seed: str) -> Column:
    """Random odds over inclusion odds, brought into (0, 1) without changing the order."""
    u = uniform(F.col("item"), seed)
    q = (u / (1 - u)) / (F.col("p") / (1 - F.col("p")))
    return F.when(F.col("p") > 0, 1 - 1 / (1 + q)).otherwise(F.lit(1.0))


def mixing_plan(sizes: DataFrame, seed: str = "mix", **kw) -> DataFrame:
    """One row per source and class: target, certain whole copies, inclusion probability p of one more, and the ranking's cut.

    ``sizes``: of document_sizes(), a written table. The whole part of a document's expected copies is certain, what is left
    is its inclusion probability in a sample: the documents of a source are ranked by random odds over inclusion odds, and the
    ranking is cut where the words taken come nearest to the words wanted, so the sample's size is fixed in words. A source's
    ranking is dealt into buckets of about 128 documents; word sums of buckets find the bucket with the cut, and only that is
    sorted.
    """
    strata = scratch(sizes.groupBy("skey", "class").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("docs")))
    source = F.when(F.col("skey") != "none", F.substring("skey", 2, 1 << 30))
    targets = source_targets(strata.select(source.alias("source"), F.col("words").alias("size"), "docs"), **kw)
    targets = scratch(targets.select(F.coalesce(F.concat(F.lit("="), "source"), F.lit("none")).alias("skey"), "source_size", "docs", "target"))
    plan = expected_copies(join_checked(strata.drop("docs"), targets, "skey"), kw.get("max_copies", 2))
    plan = plan.withColumn("whole", F.floor("expected")).withColumn("p", F.col("expected") - F.col("whole"))
    certain = F.sum(F.col("whole") * F.col("words")).over(Window.partitionBy("skey"))
    plan = scratch(plan.withColumn("wanted", F.col("target") - certain).withColumn("buckets", F.least(F.greatest(F.floor(F.col("docs") / BUCKET_DOCS), F.lit(1)), F.lit(MAX_BUCKETS))))
    keyed = with_plan(sizes, scratch(plan.select("skey", "class", "p", "buckets")), seed).where("p > 0")
    up_to = Window.partitionBy("skey").orderBy("bucket")
    sums = keyed.groupBy("skey", "bucket").agg(F.sum("size").alias("words")).withColumn("upto", F.sum("words").over(up_to))
    wanted = scratch(plan.select("skey", "wanted").distinct())
    cut = (
        join_checked(sums, wanted, "skey").where(F.col("upto") > F.col("wanted")).groupBy("skey", "wanted")
        .agg(F.min_by(F.struct("bucket", (F.col("upto") - F.col("words")).alias("before")), "bucket").alias("c"))
    )
    cut = scratch(cut.select("skey", "wanted", F.col("c.bucket").alias("bucket"), F.col("c.before").alias("before")))
    inside = join_checked(keyed, cut, ["skey", "bucket"]).groupBy("skey", "wanted", "before", "key", "item").agg(F.sum("size").alias("size"))
    in_order = Window.partitionBy("skey").orderBy("key", "item")
    last = scratch(
        inside.withColumn("ahead", F.col("before") + F.sum("size").over(in_order) - F.col("size"))
        .where(F.col("ahead") * 2 + F.col("size") <= F.col("wanted") * 2)
        .groupBy("skey").agg(F.max(F.struct("key", "item")).alias("cut")).select("skey", F.col("cut.key").alias("cut_key"), F.col("cut.item").alias("cut_item"))
    )
    at = scratch(cut.select("skey", F.col("bucket").alias("cut_bucket")))
    out = join_checked(join_checked(plan, at, "skey", "left"), last, "skey", "left")
    out = scratch(out.select("skey", "class", "source_size", "target", "expected", "whole", "p", "buckets", "cut_bucket", "cut_key", "cut_item"))
    drop(strata, targets, plan, wanted, cut, last, at)
    return out


def with_plan(rows: DataFrame, plan: DataFrame, seed: str) -> DataFrame:
    """rows with the plan's columns of their source and class, ``key`` (place in the ranking) and ``bucket``."""
    return (
        join_checked(rows, plan, ["skey", "class"])
        .withColumn("key", _order_key(seed))
        .withColumn("bucket", F.least(F.floor(F.col("key") * F.col("buckets")), F.col("buckets") - 1))
    )


def copies() -> Column:
    """How often a row of with_plan() is taken."""
    below = F.col("bucket") < F.coalesce(F.col("cut_bucket"), F.col("buckets") + 1)
    at = (F.col("bucket") == F.col("cut_bucket")) & F.coalesce(F.struct("key", "item") <= F.struct("cut_key", "cut_item"), F.lit(False))
    more = (F.col("p") > 0) & (below | F.coalesce(at, F.lit(False)))
    return F.col("whole") + more.cast("long")


def pareto_mix(docs: DataFrame, seed: str = "mix", **kw) -> DataFrame:
    """(doc_id, source, size, source_size, target, expected, copies, taken) of every row of docs (doc_id, text, source).

    A null text has size 0; a null source is a source of its own, the last; documents without words may be taken too, with
    0 words. Rows that share doc_id, source and class share their place and are taken together; rows without an id are told
    apart by their texts. Other columns of docs are not read, whatever their names. An empty table gives an empty one.
    """
    sizes = scratch(document_sizes(docs, F.col("doc_id"), F.col("source")))
    out = with_plan(sizes, mixing_plan(sizes, seed, **kw), seed).withColumn("copies", copies())
    return out.select("doc_id", "source", "size", "source_size", "target", "expected", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixed_documents(docs: DataFrame, seed: str = "mix", **kw) -> DataFrame:
    """The mix itself: every column of docs, whatever their names, a row as often as it is taken."""
    sizes = scratch(document_sizes(docs))
    plan = mixing_plan(sizes, seed, **kw)
    drop(sizes)
    own = document_sizes(docs, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    taken = with_plan(own, plan, seed).withColumn("copies", copies()).where("copies > 0").select("row", F.explode(F.expr("sequence(1, copies)")))
    return taken.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(CAST(doc_id AS VARCHAR), 'text ' || md5(coalesce(text, ''))) AS item,
    CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rn FROM d GROUP BY source
), c AS (
  SELECT *, CAST([5, 2, 1][(rn - 1) % 3 + 1] AS BIGINT) AS w, source_size * 2 AS cap FROM s
), r AS (
  SELECT *, CAST(cap AS DOUBLE) / w AS ratio, CAST(sum(source_size) OVER () AS DOUBLE) * 1.5 AS budget FROM c
), l AS (
  SELECT *, (budget - CAST(sum(cap) OVER (ORDER BY ratio, rn ROWS UNBOUNDED PRECEDING) - cap AS DOUBLE))
    / CAST(sum(w) OVER (ORDER BY ratio, rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS fill FROM r
), v AS (
  SELECT *, max(CASE WHEN fill <= ratio THEN fill END) OVER () AS level FROM l
), t AS (
  SELECT source, source_size, CASE WHEN level IS NULL OR ratio <= level THEN CAST(cap AS DOUBLE) ELSE w * level END AS target FROM v
), h AS (
  SELECT t.source, source_size, target, length(bin(size)) AS class, CAST(sum(size) AS BIGINT) AS words
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source GROUP BY ALL
), m AS (
  SELECT *, (target - CAST(sum(words) OVER w - words AS DOUBLE) * 2) / nullif(CAST(sum(class * words) OVER (PARTITION BY source) - sum(class * words) OVER w + class * words AS DOUBLE), 0) AS fill
  FROM h WINDOW w AS (PARTITION BY source ORDER BY class DESC ROWS UNBOUNDED PRECEDING)
), x AS (
  SELECT *, max(CASE WHEN fill * class <= 2 THEN fill END) OVER (PARTITION BY source) AS factor FROM m
), e AS (
  SELECT *, CASE WHEN target > 0 THEN least(2.0::DOUBLE, coalesce(factor * class, 2.0::DOUBLE)) ELSE 0.0::DOUBLE END AS expected FROM x
), p AS (
  SELECT *, floor(expected) AS whole, expected - floor(expected) AS p, target - sum(floor(expected) * words) OVER (PARTITION BY source) AS wanted FROM e
), k AS (
  SELECT d.doc_id, d.item, d.size, p.*,
    (CAST(('0x' || substr(md5('mix:' || item), 1, 13)) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source AND length(bin(d.size)) = p.class
), q AS (
  SELECT *, CASE WHEN p > 0 THEN 1 - 1 / (1 + (u / (1 - u)) / (p / (1 - p))) ELSE 1.0 END AS key FROM k
), o AS (
  SELECT *, sum(size) OVER (PARTITION BY source, p > 0 ORDER BY key, item ROWS UNBOUNDED PRECEDING) - size AS ahead FROM q
)
SELECT doc_id, size, source_size, target,
  CAST(size * (whole + CASE WHEN p > 0 AND ahead * 2 + size <= wanted * 2 THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM o
"""
