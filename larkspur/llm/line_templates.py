"""Line dedup by a log-template tree: lines are parsed to templates, and templates that recur across documents are dropped."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import UPPER_TO_LOWER, WORD, drop, join_checked, scratch, without_lines

#: Leading tokens on a path of the tree; equal positions (of 100) that bring a line to a template; documents from which a
#: template recurs; tokens of the lines that one task parses together; rounds without a merge after which a larger leaf is done;
#: templates that a line is simply compared with.
LEAD, SIMILAR, RECURS, PARSED, QUIET, FEW = 3, 70, 6, 1 << 20, 16, 64
WILD = b"<*>"
_VARIABLE = re.compile(rb"[^ ]*[0-9][^ ]*")


def masked(line: bytes) -> bytes:
    """A line in lower case, one space between tokens, tokens with a digit as wildcards; empty without a token."""
    out = b" ".join(line.translate(UPPER_TO_LOWER).split())
    return _VARIABLE.sub(WILD, out)


def key_of(data: bytes) -> int:
    return xxhash.xxh3_64_intdigest(data) >> 1


def leaf_of(line: bytes) -> int:
    """Digest of the path: number of tokens, then the first LEAD of them."""
    head = line.split(b" ", LEAD)
    return key_of(b"%d " % (line.count(b" ") + 1) + b" ".join(head[:LEAD]))


def near_key(data: bytes) -> int:
    """Digest of the extremes of the words' digests in two orders: texts that differ in a few words mostly share it."""
    words = set(data.split())
    one = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    two = one << np.uint64(32) | one >> np.uint64(32)
    return key_of(b"%d %d %d %d" % (one.min(), one.max(), two.min(), two.max())) if words else 0


def text_keys() -> list[Column]:
    """128 bits that tell texts apart."""
    return [F.xxhash64(F.lit(n), F.coalesce("text", F.lit(""))).alias(f"t{n}") for n in (1, 2)]


def keyed_texts(docs: DataFrame) -> DataFrame:
    """(t1, t2, keys) of every row of docs, written: keys of its text and (leaf, line) of every line."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaves, lines, offsets = [], [], [0]
            for text in batch.column(2):
                for x in map(masked, (text.as_py() or "").encode().split(b"\n")):
                    leaves.append(leaf_of(x) if x else None)
                    lines.append(key_of(x) if x else None)
                offsets.append(len(lines))
            keys = pa.StructArray.from_arrays([pa.array(leaves, pa.int64()), pa.array(lines, pa.int64())], ["leaf", "line"])
            keys = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), keys)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), keys], ["t1", "t2", "keys"])

    return scratch(docs.select(*text_keys(), "text").mapInArrow(parse, "t1 long, t2 long, keys array<struct<leaf:long,line:long>>"))


def _lines(keyed: DataFrame) -> DataFrame:
    """(t1, t2, at, leaf, line) of every line that has a token; at: its place in the text."""
    each = keyed.select("t1", "t2", F.posexplode("keys").alias("at", "k"))
    return each.select("t1", "t2", "at", "k.leaf", "k.line").where("line IS NOT NULL")


def near_keys(docs: DataFrame, copies: DataFrame) -> DataFrame:
    """(copy, near): ``near_key`` of the texts of a written table of copies; written."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [near_key((text.as_py() or "").encode()) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.int64())], ["copy", "near"])

    texts = join_checked(docs.select(text_keys()[0].alias("copy"), "text"), copies, "copy").select("copy", "text")
    return scratch(texts.mapInArrow(near, "copy long, near long").dropDuplicates(["copy"]))


def generalise(lines: list[bytes], similar: int = SIMILAR) -> tuple[list[int], list[bytes]]:
    """Bring lines of one leaf, in order, to the template with most equal positions, if enough are equal; where a line and
    its template differ, the template gets a wildcard. Returns each line's template number and the templates.

    A template with enough equal positions is equal at one of any ``rare`` positions at least, so where templates are many, only
    those that have one of the line's rarest tokens at its place are compared.
    """
    code: dict[bytes, int] = {WILD: 0}
    rows = np.array([[code.setdefault(t, len(code)) for t in x.split(b" ")] for x in lines], np.int32)
    templates, of, n, width = np.empty_like(rows), [], 0, rows.shape[1]
    rare = width - -(-similar * width // 100) + 1
    having: dict[tuple[int, int], list[int]] = {}
    for row in rows:
        keys = list(enumerate(row.tolist()))
        near = np.arange(n)
        if n > FEW:
            lists = sorted((having.get(k, ()) for k in keys), key=len)[:rare]
            near = np.array(sorted(set().union(*lists)), np.int64)
        if len(near):
            same = (templates[near] == row).sum(axis=1)
            best = int(near[same.argmax()])
            if 100 * same.max() >= similar * width:
                for p in np.flatnonzero((templates[best] != row) & (templates[best] != 0)).tolist():
                    having.setdefault((p, 0), []).append(best)
                    templates[best, p] = 0
                of.append(best)
                continue
        templates[n] = row
        for k in keys:
            having.setdefault(k, []).append(n)
        of.append(n)
        n += 1
    names = list(code)
    return of, [b" ".join(names[t] for t in x) for x in templates[:n]]


def dealt(lines: DataFrame, leaves: DataFrame, turn: int) -> DataFrame:
    """lines (leaf, id, text) with ``part``: those of a leaf of more than one part by their token at a place, the ``turn``-th after the
    leading ones, so that lines that agree there meet; a token of more lines than have room in a part is dealt by further places
    too, and by the text at last."""
    df = join_checked(lines, leaves.select("leaf", "parts", "room"), "leaf")
    if leaves.where("parts > 1").isEmpty():
        return df.withColumn("part", F.lit(0).cast("long"))
    tokens = F.split(F.col("text").cast("string"), " ")
    df = df.withColumn("deal", F.lit(0).cast("long")).withColumn("hot", F.when(F.col("parts") > 1, True))
    for more in range(LEAD):
        token = F.get(tokens, LEAD + F.pmod(F.lit(turn + more * 7), F.greatest(F.size(tokens) - LEAD, F.lit(1))))
        df = df.withColumn("deal", F.when(F.col("hot"), F.xxhash64("deal", token)).otherwise(F.col("deal"))).drop("hot")
        hot = scratch(df.where("parts > 1").groupBy("leaf", "deal", "room").agg(F.count(F.lit(1)).alias("n")).where("n > room").select("leaf", "deal", F.lit(True).alias("hot")))
        df = join_checked(df, hot, ["leaf", "deal"], "left")
    deal = F.when(F.col("hot"), F.xxhash64("deal", "text")).otherwise(F.col("deal"))
    return df.withColumn("part", F.pmod(F.xxhash64(deal, F.lit(turn)), "parts")).drop("deal", "hot", "room")


def templates_of(lines: DataFrame, similar: int = SIMILAR, parsed: int = PARSED) -> DataFrame:
    """(leaf, line, template) for the distinct lines (leaf, line, text) of leaves that may recur.

    A leaf of more than ``parsed`` tokens is parsed in parts; the templates of its parts are parsed again as lines, dealt by their
    token at the next place. Lines of n tokens that are similar differ at 30 % of the places at most, so of one place more they
    have met at one. A leaf is done once it is one part, or after so many rounds without a merge, QUIET at most: what has not met
    by then would be similar with a probability of 0.3 to the power of QUIET. No task ever holds a leaf that does not fit.
    """
    now = scratch(lines.select("leaf", F.col("line").alias("id"), "text"))
    mapping = now.select("leaf", F.col("id").alias("line"), F.col("id").alias("to"))
    places = F.size(F.split(F.col("text").cast("string"), " "))
    leaves = now.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), F.first(places).alias("places")).withColumn("quiet", F.lit(0))
    enough = F.least(F.floor(F.col("places") * (100 - similar) / 100) + 1, F.lit(QUIET))
    done, turn = [], 0
    while True:
        leaves = leaves.withColumn("room", F.greatest(F.floor(F.lit(parsed) / F.col("places")), F.lit(1)))
        leaves = scratch(leaves.withColumn("parts", F.ceil(F.col("n") / F.col("room"))))

        def parse(part: pa.Table) -> pa.Table:
            part = part.sort_by([("text", "ascending")])
            of, templates = generalise(part["text"].to_pylist(), similar)
            ids = [key_of(t) for t in templates]
            return pa.table({"leaf": part["leaf"], "id": part["id"], "to": pa.array([ids[i] for i in of], pa.int64()), "template": pa.array([templates[i] for i in of], pa.binary())})

        step = scratch(dealt(now, leaves, turn).groupBy("leaf", "part").applyInArrow(parse, "leaf long, id long, to long, template binary"))
        to = step.select("leaf", "id", "to")
        mapping = to.withColumnRenamed("id", "line") if turn == 0 else mapping.withColumnRenamed("to", "id").join(to.hint("merge"), ["leaf", "id"]).select("leaf", "line", "to")
        if leaves.where("parts > 1").isEmpty():
            done.append(mapping)
            break
        now = scratch(step.groupBy("leaf", F.col("to").alias("id")).agg(F.first("template").alias("text")))
        left = scratch(now.groupBy("leaf").agg(F.count(F.lit(1)).alias("left")))
        after = join_checked(leaves, left, "leaf").withColumn("quiet", F.when(F.col("left") < F.col("n"), 0).otherwise(F.col("quiet") + 1))
        after = scratch(after.withColumn("open", (F.col("parts") > 1) & (F.col("quiet") < enough)))
        leaves = after.where("open").select("leaf", F.col("left").alias("n"), "places", "quiet")
        if leaves.isEmpty():
            done.append(mapping)
            break
        mapping = scratch(join_checked(mapping, after.select("leaf", "open"), "leaf"))
        done.append(mapping.where("NOT open").select("leaf", "line", "to"))
        mapping = mapping.where("open").select("leaf", "line", "to")
        now = join_checked(now, scratch(leaves.select("leaf")), "leaf")
        turn += 1
    return reduce(DataFrame.union, done).select("leaf", "line", F.col("to").alias("template"))


def recurring_lines(docs: DataFrame, keyed: DataFrame, recurs: int = RECURS, similar: int = SIMILAR) -> DataFrame:
    """(line): digests of the lines whose template recurs in ``recurs`` documents or more; copies of a text count once.

    A template has no more documents than its leaf, so leaves are counted first, on digests alone; only lines of leaves with
    enough documents are read as text.

    Templates that so many different texts have are candidates. A document is told from others by its lines of no candidate,
    so a shared line does not decide; one that has only lines of candidates, as near copies of one text have, by ``near``.
    """
    lines = _lines(keyed).withColumnRenamed("t1", "copy")
    leaves = scratch(lines.select("leaf", "copy").distinct().groupBy("leaf").agg(F.count(F.lit(1)).alias("docs")).where(F.col("docs") >= recurs).select("leaf"))
    # Each distinct line once, with a text that shows it.
    shown = join_checked(lines, leaves, "leaf").groupBy("leaf", "line").agg(F.min(F.struct("copy", "t2")).alias("by"))
    wanted = scratch(shown.groupBy(F.col("by.copy").alias("t1"), F.col("by.t2").alias("t2")).agg(F.collect_set("line").alias("wanted")))
    texts = join_checked(docs.select(*text_keys(), "text"), wanted, ["t1", "t2"])

    def show(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[int, bytes] = {}
            for text, lines_ in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                wanted_ = set(lines_)
                for x in map(masked, (text.as_py() or "").encode().split(b"\n")):
                    if x and (k := key_of(x)) in wanted_:
                        out[k] = x
            yield pa.RecordBatch.from_arrays([pa.array([leaf_of(x) for x in out.values()], pa.int64()), pa.array(out, pa.int64()), pa.array(list(out.values()), pa.binary())], ["leaf", "line", "text"])

    distinct = texts.select("text", "wanted").mapInArrow(show, "leaf long, line long, text binary").dropDuplicates(["leaf", "line"])
    template = scratch(templates_of(distinct, similar))
    of = join_checked(lines.select("line", "copy"), template.select("line", "template"), "line").select("template", "copy").distinct()
    often = scratch(of.groupBy("template").agg(F.count(F.lit(1)).alias("docs")).where(F.col("docs") >= recurs).select("template"))
    shared = scratch(join_checked(template, often, "template").select("line", "template").distinct())
    hit = scratch(join_checked(lines.select("line", "copy"), shared, "line").select("template", "copy").distinct())
    copies = scratch(hit.select("copy").distinct())
    having = join_checked(lines.select("copy", "line"), copies, "copy", "left_semi")
    told = join_checked(having, scratch(shared.select("line", F.lit(True).alias("shared"))), "line", "left")
    own = F.collect_set(F.when(F.col("shared").isNull(), F.col("line")))
    told = scratch(told.groupBy("copy").agg(own.alias("own")).select("copy", F.when(F.size("own") > 0, F.xxhash64(F.lit(1), F.sort_array("own"))).alias("own")))
    near = near_keys(docs, scratch(told.where("own IS NULL").select("copy")))
    named = scratch(join_checked(told, near, "copy", "left").select("copy", F.coalesce("own", F.xxhash64(F.lit(2), "near")).alias("document")))
    each = join_checked(hit, named, "copy").select("template", "document").distinct()
    real = scratch(each.groupBy("template").agg(F.count(F.lit(1)).alias("docs")).where(F.col("docs") >= recurs).select("template"))
    out = scratch(join_checked(template, real, "template").select("line").distinct())
    drop(leaves, wanted, template, often, shared, hit, copies, told, near, named, real)
    return out


def with_drops(docs: DataFrame, **kw) -> DataFrame:
    """(row, text, dropped): every row of docs as one struct, its text and the places of the lines that it loses (null: none)."""
    keyed = keyed_texts(docs)
    recurring = recurring_lines(docs, keyed, **kw)
    # Copies of a text have the same lines at the same places.
    gone = scratch(join_checked(_lines(keyed).select("t1", "t2", "at", "line"), recurring, "line").groupBy("t1", "t2").agg(F.collect_set("at").alias("dropped")))
    drop(keyed, recurring)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text", *text_keys())
    return join_checked(rows, gone, ["t1", "t2"], "left").select("row", "text", "dropped")


def deduplicated(docs: DataFrame, **kw) -> DataFrame:
    """docs with the lines of recurring templates taken out of ``text``; all other columns, whatever their names, as they are."""
    rows = without_lines(with_drops(docs, **kw), F.col("text"), F.col("dropped"))
    return rows.select(*[F.col("cleaned").alias("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])


def line_report(docs: DataFrame, **kw) -> DataFrame:
    """doc_id, n_lines (with a token), n_dropped, kept_chars, kept_md5 (of the text that stays) of every row of docs.

    Lines are split at \\n. A template recurs if six documents or more have it, copies of one text counted once.
    A null text has no lines and stays null (kept_md5 null). Rows that share a doc_id get a row each. Other columns are
    carried by deduplicated() and not read. An empty table gives an empty result.
    """
    rows = without_lines(with_drops(docs.select("doc_id", "text"), **kw), F.col("text"), F.col("dropped"))
    n_lines = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: x.rlike(WORD)))
    return rows.select(
        "row.doc_id", n_lines.cast("long").alias("n_lines"), F.when(F.col("dropped").isNull(), 0).otherwise(F.size("dropped")).cast("long").alias("n_dropped"),
        F.length("cleaned").cast("long").alias("kept_chars"), F.md5("cleaned").alias("kept_md5"),
    )
