"""Quality rules: figures of each text, and lines that too many documents of a host share. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import WORD, ascii_lower, drop, join_checked, scratch, without_lines

BLANK = r"[\x20\x09-\x0D]"
#: A document fails with fewer words, or with a larger percentage of words in repeated 3-word windows. A line goes if more
#: documents of its host have it; a document that keeps a smaller percentage of its words is depleted.
MIN_WORDS, MAX_REPEAT_PERCENT, MAX_LINE_DOCS, MIN_LEFT_PERCENT = 50, 50, 10, 50


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, BLANK + "+"), "")


def normal_text(text: Column) -> Column:
    """A-Z in lower case, digits as 0, one space for blanks within lines. Lower-casing is quicker on texts that are ASCII alone."""
    lower = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(ascii_lower(text))
    return F.regexp_replace(F.regexp_replace(lower, "[1-9]", "0"), r"[\x20\x09\x0B-\x0D]+", " ")


def line_key(source: Column, line: Column) -> Column:
    """Digest of a host and a normalised line."""
    return F.xxhash64(F.coalesce(F.concat(F.lit("="), source), F.lit("none")), line)


def repeat_words(df: DataFrame) -> DataFrame:
    """Adds n_repeat_words to rows with ``_words``: words that lie in a 3-word window that the text has twice or more.

    Windows are digests of 64 bits. A text whose windows all differ is done there; else windows are sorted, those equal to
    a neighbour give their places, and the places in order give the words they cover.
    """
    n = F.size("_words")
    df = df.withColumn("_grams", F.transform(F.slice("_words", F.lit(1), F.greatest(n - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get("_words", i + 1), F.get("_words", i + 2))))
    placed = F.transform("_grams", lambda g, i: F.struct(g.alias("g"), i.alias("i")))
    df = df.withColumn("_sorted", F.when(F.size(F.array_distinct("_grams")) < F.size("_grams"), F.sort_array(placed)))
    twice = F.filter("_sorted", lambda x, i: x["g"].eqNullSafe(F.get("_sorted", i - 1)["g"]) | x["g"].eqNullSafe(F.get("_sorted", i + 1)["g"]))
    df = df.withColumn("_places", F.sort_array(F.transform(twice, lambda x: x["i"])))
    reach = F.transform("_places", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("_places", i + 1) - p, F.lit(3))))
    covered = F.aggregate(reach, F.lit(0).cast("long"), lambda a, x: a + x)
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_grams", "_sorted", "_places")


def text_keys() -> list[Column]:
    """128 bits that tell apart rows of another host or text."""
    source = F.coalesce(F.concat(F.lit("="), "source"), F.lit("none"))
    return [F.xxhash64(F.lit(n), source, F.coalesce("text", F.lit(""))).alias(f"t{n}") for n in (1, 2)]


def figures(docs: DataFrame) -> DataFrame:
    """One row per row of docs with its figures, its keys of host and text and its lines as (key, words), written.

    key: digest of the host and the normalised line; null for a line without a word. copy: digest of all normalised lines.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.select("doc_id", "source", *text_keys(), text.alias("_text"))
    df = df.withColumn("_words", words_of(F.col("_text"))).withColumn("_lines", F.split("_text", "\n"))
    df = repeat_words(df).withColumn("_norm", F.transform(F.split(normal_text(F.col("_text")), "\n"), lambda x: F.trim(x)))
    key = lambda x: F.when(x != "", line_key(F.col("source"), x))
    count = lambda x: F.length(x) - F.length(F.replace(x, F.lit(" "))) + 1
    with_word = F.filter("_lines", lambda x: x.rlike(WORD))
    out = df.select(
        F.monotonically_increasing_id().alias("rid"),
        "doc_id", "t1", "t2",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size(with_word) - F.size(F.array_distinct(with_word))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        F.xxhash64(F.array_join(F.array_remove("_norm", ""), "\n")).alias("copy"),
        F.transform("_norm", lambda x: F.struct(key(x).alias("key"), count(x).alias("words"))).alias("lines"),
    )
    return scratch(out)


def frequent_lines(rated: DataFrame, max_line_docs: int = MAX_LINE_DOCS) -> DataFrame:
    """(key) of lines that more than ``max_line_docs`` documents of a host have; documents of one normalised text count once.

    Rows are counted first, added up before they are moved; only lines that so many rows have are counted by document.
    """
    keys = F.explode(F.array_distinct(F.transform("lines", lambda x: x["key"]))).alias("key")
    rows = rated.select(keys).where("key IS NOT NULL").groupBy("key").agg(F.count(F.lit(1)).alias("rows"))
    candidates = scratch(rows.where(F.col("rows") > max_line_docs).select("key"))
    each = join_checked(rated.select(keys, "copy"), candidates, "key").distinct()
    out = scratch(each.groupBy("key").agg(F.count(F.lit(1)).alias("docs")).where(F.col("docs") > max_line_docs).select("key"))
    drop(candidates)
    return out


def verdicts(rated: DataFrame, frequent: DataFrame, min_words=MIN_WORDS, max_repeat=MAX_REPEAT_PERCENT, min_left=MIN_LEFT_PERCENT) -> DataFrame:
    """rated without lines, with base_failed, words_left, dropped (places of its frequent lines) and kept; written."""
    lines = rated.select("rid", F.posexplode("lines").alias("at", "l")).where("l.key IS NOT NULL").select("rid", "at", "l.key", "l.words")
    lost = scratch(join_checked(lines, frequent, "key").groupBy("rid").agg(F.sum("words").alias("words_lost"), F.collect_list("at").alias("dropped")))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))
    left = F.col("n_words") - F.coalesce("words_lost", F.lit(0))
    out = scratch(
        join_checked(rated.drop("lines", "copy"), lost, "rid", "left")
        .withColumn("base_failed", failed)
        .withColumn("words_left", left)
        .withColumn("kept", ~failed & (100 * left >= min_left * F.col("n_words")))
    )
    drop(lost)
    return out


def _rated(docs: DataFrame, **kw) -> DataFrame:
    rated = figures(docs)
    frequent = frequent_lines(rated)
    out = verdicts(rated, frequent, **kw)
    drop(rated, frequent)
    return out


def quality(docs: DataFrame, **kw) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, words_left, kept of every row of docs.

    Rules: a text needs 50 words, at most half of them in repeated 3-word windows, and at least half of its words in lines
    that no more than 10 documents of its host (``source``) have. Lines are compared in lower case (A-Z) with digits alike;
    documents whose lines are all alike so are one document, other near copies are not.

    A null text has no words and fails; a null source is a host of its own; rows that share a doc_id get a row each, and
    their lines count by text. Other columns are not read. An empty table gives an empty result.
    """
    return _rated(docs, **kw).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "words_left", "kept")


def clean_documents(docs: DataFrame, **kw) -> DataFrame:
    """The kept documents with all their columns, whatever their names, their frequent lines taken out of the text.

    Rows of one host and text have one verdict, which finds them by digest; most rows stay as they are and have none.
    """
    rated = _rated(docs, **kw)
    changed = rated.where("NOT kept OR dropped IS NOT NULL").groupBy("t1", "t2").agg(F.first("kept").alias("kept"), F.first("dropped").alias("dropped"))
    found = scratch(changed)
    drop(rated)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *text_keys())
    rows = join_checked(rows, found, ["t1", "t2"], "left").where(F.coalesce("kept", F.lit(True)))
    rows = without_lines(rows, F.col("row.text"), F.col("dropped"))
    return rows.select(*[F.col("cleaned").alias("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
    [x FOR x IN string_split(text, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS lines FROM d
), g AS (
  SELECT rid, unnest([words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] FOR i IN range(1, greatest(len(words) - 1, 1))]) AS g,
    unnest(range(1, greatest(len(words) - 1, 1))) AS i FROM w
), twice AS (
  SELECT rid, i FROM g QUALIFY count(*) OVER (PARTITION BY rid, g) > 1
), covered AS (
  SELECT rid, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) o(k) GROUP BY rid
), c AS (
  SELECT rid, source, lines, [trim(regexp_replace(regexp_replace(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[1-9]', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g')) FOR x IN lines] AS norms FROM w
), n AS (
  SELECT rid, source, array_to_string(norms, chr(10)) AS copy, unnest(norms) AS norm, unnest([len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) FOR x IN lines]) AS words FROM c
), often AS (
  SELECT source, norm FROM n GROUP BY source, norm HAVING count(DISTINCT copy) > 10
), lost AS (
  SELECT rid, sum(n.words) AS words FROM n JOIN often o ON n.norm = o.norm AND n.source IS NOT DISTINCT FROM o.source GROUP BY rid
), f AS (
  SELECT doc_id, CAST(len(w.words) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
    CAST(len(w.words) - coalesce(lost.words, 0) AS BIGINT) AS words_left
  FROM w LEFT JOIN covered c USING (rid) LEFT JOIN lost USING (rid)
)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * words_left >= 50 * n_words AS kept FROM f
"""
