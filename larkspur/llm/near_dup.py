"""Near duplicates: bottom-k sketches from one hash function, exact Jaccard on word shingles, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import UPPER_TO_LOWER, components, drop, join_checked, scratch

#: Words of a shingle; retained hashes of a document; those of them that name inverted lists; a list with more documents is hot.
SHINGLE, SKETCH, LISTED, COLD_LIST = 5, 64, 40, 32
#: Hot lists of a document; documents compared with each other in one task; words whose hash a task keeps.
HOT_LISTS, BLOCK, CACHE_WORDS = 6, 512, 400_000
#: Links: 100 * intersection >= 75 * union. A sketch estimate has a standard deviation of 0.054 there; 0.25 below is 4.6 of them.
PERCENT, MARGIN = 75, 0.25
MULTIPLIER = 0x9E3779B97F4A7C15


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = h
        return h


def shingle_hashes(text: str | None, cache: WordHashes) -> np.ndarray:
    """Sorted distinct 63-bit hashes of a text's shingles; with fewer words, of all of them as one; none without words."""
    words = (text or "").encode().translate(UPPER_TO_LOWER).split()
    if not words:
        return np.empty(0, np.int64)
    w = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
    size = min(SHINGLE, len(w))
    h = np.full(len(w) - size + 1, size, np.uint64)
    for i in range(size):
        h = h * np.uint64(MULTIPLIER) + w[i : len(w) - size + 1 + i]
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(29)
    return np.unique((h >> np.uint64(1)).astype(np.int64))


def row_keys() -> list[Column]:
    """128 bits that tell apart rows of another doc_id or text."""
    doc = F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))
    return [F.xxhash64(F.lit(n), doc, F.coalesce("text", F.lit(""))).alias(f"r{n}") for n in (1, 2)]


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, r1 and r2 (row_keys), n_shingles, d1 and d2 (digest of the whole set) and the smallest hashes, of every row."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            n, d1, d2, low = [], [], [], []
            for text in batch.column(3):
                s = shingle_hashes(text.as_py(), cache)
                both = xxhash.xxh3_128_intdigest(s.tobytes())
                n.append(len(s))
                d1.append(both >> 65)
                d2.append((both & (1 << 64) - 1) >> 1)
                low.append(s[:SKETCH])
            columns = [*batch.columns[:3], pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(low, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "r1", "r2", "n_shingles", "d1", "d2", "low"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *row_keys(), "text")
    return rows.mapInArrow(of, "doc_id long, r1 long, r2 long, n_shingles long, d1 long, d2 long, low array<long>")


def classes_of(every: DataFrame) -> DataFrame:
    """One node for each set of shingles, written: node, d1, d2, n_shingles, low, rows, and doc_id, r1, r2 of the first row."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "r1", "r2")).alias("first")
    each = every.groupBy("d1", "d2").agg(F.max("n_shingles").alias("n_shingles"), F.first("low").alias("low"), F.count(F.lit(1)).alias("rows"), first)
    return scratch(each.select(F.monotonically_increasing_id().alias("node"), "d1", "d2", "n_shingles", "low", "rows", "first.doc_id", "first.r1", "first.r2"))


def candidate_lists(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cold, hot): rows (value, node) of the inverted lists of retained values.

    Cold lists have 2 to COLD_LIST nodes. Two nodes that are linked but share no cold value share hot ones only, so most of
    what both retain is hot: hot lists hold such nodes only, each in the lists of its smallest hot values.
    """
    listed = classes.select("node", F.slice("low", 1, LISTED).alias("v")).select("node", F.size("v").alias("m"), F.explode("v").alias("value"))
    often = scratch(listed.groupBy("value").agg(F.count(F.lit(1)).alias("df")).where("df > 1"))
    shared = scratch(listed.join(often.hint("merge"), "value"))
    cold = shared.where(F.col("df") <= COLD_LIST).select("value", "node")
    hot = (
        shared.where(F.col("df") > COLD_LIST).groupBy("node", "m").agg(F.sort_array(F.collect_list("value")).alias("v"))
        .where(F.size("v") * 2 >= F.col("m"))
        .select("node", F.explode(F.slice("v", 1, HOT_LISTS)).alias("value"), F.size("v").alias("n_hot"))
    )
    return cold, scratch(hot)


def pairs_of(cold: DataFrame, hot: DataFrame) -> DataFrame:
    """Candidate pairs (a, b), a < b: all of a cold list; in a hot list, every node with the node that has most hot values."""
    other = cold.select("value", F.col("node").alias("b"))
    near = cold.withColumnRenamed("node", "a").join(other.hint("merge"), "value").where("a < b").select("a", "b")
    hub = scratch(hot.groupBy("value").agg(F.max_by("node", F.struct("n_hot", F.xxhash64("node"))).alias("hub")))
    star = join_checked(hot, hub, "value").where("node <> hub").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b"))
    return near.union(star).distinct()


def estimated(pairs: DataFrame, classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs whose sizes allow a link and whose union's bottom-k sketch estimates no less than the threshold less MARGIN."""
    side = classes.select("node", "n_shingles", "low")
    a = side.select(F.col("node").alias("a"), F.col("n_shingles").alias("na"), F.col("low").alias("la"))
    b = side.select(F.col("node").alias("b"), F.col("n_shingles").alias("nb"), F.col("low").alias("lb"))
    both = pairs.join(a.hint("merge"), "a").join(b.hint("merge"), "b").where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    both = both.withColumn("u", F.slice(F.array_sort(F.array_union("la", "lb")), 1, SKETCH))
    hits = F.size(F.array_intersect("u", F.array_intersect("la", "lb")))
    return both.where(hits >= F.size("u") * (percent / 100 - MARGIN)).select("a", "b")


def full_sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, hashes as bytes) of the given nodes, from their texts; nodes: (node, r1, r2, d1, d2), a written table."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            sets = [shingle_hashes(t.as_py(), cache) for t in batch.column(1)]
            digests = [xxhash.xxh3_128_intdigest(s.tobytes()) for s in sets]
            right = [(d >> 65, (d & (1 << 64) - 1) >> 1) == x for d, x in zip(digests, zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True), strict=True)]
            for at in range(0, len(sets), 1000):
                keep = [i for i in range(at, min(at + 1000, len(sets))) if right[i]]
                columns = [batch.column(0).take(pa.array(keep, pa.int64())), pa.array([sets[i].tobytes() for i in keep], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["node", "hashes"])

    rows = join_checked(docs.select(*row_keys(), "text"), nodes, ["r1", "r2"])
    return rows.select("node", "text", "d1", "d2").mapInArrow(of, "node long, hashes binary").dropDuplicates(["node"])


def verified(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs whose whole sets have a Jaccard similarity of percent / 100 or more."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                p, q = np.frombuffer(x.as_buffer(), np.int64), np.frombuffer(y.as_buffer(), np.int64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                if 100 * both >= percent * (len(p) + len(q) - both):
                    keep.append(i)
            yield batch.select([0, 1]).take(pa.array(keep, pa.int64()))

    s = sets.select(F.col("node").alias("a"), F.col("hashes").alias("ha"))
    t = sets.select(F.col("node").alias("b"), F.col("hashes").alias("hb"))
    return pairs.join(s.hint("merge"), "a").join(t.hint("merge"), "b").select("a", "b", "ha", "hb").mapInArrow(check, "a long, b long")


def open_lists(hot: DataFrame, found: DataFrame) -> DataFrame:
    """(value, node, c) of the hot lists whose nodes are in more than one component c; written."""
    members = scratch(hot.select("value", "node").join(found.select("node", "component").hint("merge"), "node", "left").select("value", "node", F.coalesce("component", "node").alias("c")))
    apart = scratch(members.groupBy("value").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("value"))
    out = scratch(join_checked(members, apart, "value"))
    drop(members, apart)
    return out


def prefixes(nodes: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(node, c, h, df) of the nodes (node, c): the rarest shingles h of each set, so many that sets that are linked share one
    of them; without those that only one of the sets has. df: sets that have h. Written.

    Of n shingles, a link shares ceil(0.75 n) at least, so it shares one of any n - ceil(0.75 n) + 1 that come first in an
    order that all sets have in common: by rareness here.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                hashes = [np.frombuffer(x.as_buffer(), np.int64) for x in part.column(2)]
                size = np.array([len(x) for x in hashes])
                columns = [np.repeat(part.column(i).to_numpy(), size) for i in (0, 1)] + [np.repeat(size, size), np.concatenate(hashes)]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["node", "c", "n", "h"])

    every = nodes.join(sets.hint("merge"), "node").select("node", "c", "hashes").mapInArrow(each, "node long, c long, n long, h long")
    often = scratch(every.groupBy("h").agg(F.count(F.lit(1)).alias("df")).where("df > 1"))
    shared = every.join(often.hint("merge"), "h").groupBy("node", "c", "n").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("s"))
    first = F.expr(f"n - ({percent} * n + 99) div 100 + 1 - (n - size(s))")
    out = scratch(shared.select("node", "c", F.explode(F.slice("s", F.lit(1), F.greatest(first, F.lit(0)).cast("int"))).alias("x")).select("node", "c", "x.h", "x.df"))
    drop(often)
    return out


def links_by_prefix(lists: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b): links between components that meet in hot lists (value, node, c).

    Sets that share a rare shingle of their prefixes are compared in pairs. What is left shares only prefix shingles that many
    sets have, so most of either set is common to many: such nodes are compared in blocks.
    """
    rare = scratch(prefixes(scratch(lists.select("node", "c").distinct()), sets, percent))
    cold = rare.where(F.col("df") <= COLD_LIST).select("h", "node", "c")
    one, two = cold.select("h", F.col("node").alias("a"), F.col("c").alias("ca")), cold.select("h", F.col("node").alias("b"), F.col("c").alias("cb"))
    pairs = scratch(one.join(two.hint("merge"), "h").where("a < b AND ca <> cb").select("a", "b").distinct())
    common = scratch(rare.where(F.col("df") > COLD_LIST).select("node").distinct())
    blocks = links_in_blocks(join_checked(lists, common, "node"), sets, percent)
    out = scratch(verified(pairs, sets, percent).union(blocks))
    drop(rare, pairs, common)
    return out


def links_in_blocks(members: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Links between components that meet in a list (value, node, c): each node outside a list's largest component against the
    whole list. Lists are dealt into blocks of about BLOCK nodes, and the nodes outside into chunks as large; a task compares a chunk
    with a block on whole sets and returns one link of each node with each component. So no task grows with a list.
    """
    members = scratch(members)
    size = members.groupBy("value", "c").agg(F.count(F.lit(1)).alias("n"))
    lists = scratch(size.groupBy("value").agg(F.sum("n").alias("m"), F.max_by("c", F.struct("n", -F.col("c"))).alias("main"), F.count(F.lit(1)).alias("cs"), (F.sum("n") - F.max("n")).alias("out")).where("cs > 1"))
    rows = join_checked(members, lists, "value")
    blocks, chunks = F.ceil(F.col("m") / BLOCK), F.ceil(F.col("out") / BLOCK)
    deal = F.abs(F.xxhash64("node"))
    outside = rows.where("c <> main").select("value", "node", "c", (deal % chunks).alias("chunk"), F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("block"), F.lit(True).alias("out"))
    inside = rows.select("value", "node", "c", F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1)).alias("chunk"), (deal % blocks).alias("block"), F.lit(False).alias("out"))
    tasks = outside.unionByName(inside).join(sets.hint("merge"), "node")

    def compare(part: pa.Table) -> pa.Table:
        out = np.array(part["out"].to_pylist(), bool)
        node, c = part["node"].to_numpy(), part["c"].to_numpy()
        hashes = [np.frombuffer(x.as_buffer(), np.int64) for x in part["hashes"].combine_chunks()]
        size = np.array([len(h) for h in hashes])
        # Hashes that only one row has add to no intersection.
        every, inverse, count = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
        column = np.where(count > 1, np.cumsum(count > 1) - 1, -1)[inverse]
        row = np.repeat(np.arange(len(hashes)), size)
        shared, width = column >= 0, int((count > 1).sum())
        row, column = row[shared], column[shared]
        both = np.zeros((int(out.sum()), int((~out).sum())))
        rank = np.where(out, np.cumsum(out) - 1, np.cumsum(~out) - 1)
        for low in range(0, width, 4096):  # so many hashes at once
            at = (column >= low) & (column < low + 4096)
            dense = np.zeros((len(hashes), min(4096, width - low)), np.float32)
            dense[row[at], column[at] - low] = 1
            both += dense[out] @ dense[~out].T
        union = size[out][:, None] + size[~out][None, :] - both
        hit = (100 * both >= percent * union) & (c[out][:, None] != c[~out][None, :])
        links = {(int(c[out][i]), int(c[~out][j])) for i, j in zip(*np.nonzero(hit), strict=True)} if hit.any() else set()
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    return tasks.groupBy("value", "chunk", "block").applyInArrow(compare, "a long, b long")


def linked(docs: DataFrame, classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(node, component) of the nodes that have a link, written; component: the smallest node that links reach."""
    cold, hot = candidate_lists(classes)
    pairs = scratch(estimated(pairs_of(cold, hot), classes, percent))
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(hot.select("node")).distinct()
    nodes = scratch(classes.select("node", "r1", "r2", "d1", "d2").join(wanted.hint("merge"), "node"))
    sets = scratch(full_sets(docs, nodes))
    links = scratch(verified(pairs, sets, percent))
    drop(pairs, nodes)
    first = scratch(components(links))
    lists = open_lists(hot, first)
    more = links_by_prefix(lists, sets, percent)
    found = first if more.isEmpty() else scratch(components(links.union(more)))
    drop(hot, sets, links, lists, more)
    return found


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of docs (doc_id, text).

    Rows with equal sets are one node; nodes with a similarity of 0.75 or more are linked, and component_id is the smallest
    doc_id that links reach. kept: doc_id = component_id. A document without words (also a null text) has an empty set and is
    alone. A row with a null doc_id is left out of links: component_id null, kept true. Rows that share a doc_id belong
    together only if their texts do. Other columns are not read; an empty table gives none.
    """
    every = scratch(sketches(docs))
    classes = classes_of(every.where("n_shingles > 0 AND doc_id IS NOT NULL"))
    found = linked(docs, classes, percent)
    own = found.join(classes.select("node", "doc_id").hint("merge"), "node")
    least = scratch(own.groupBy("component").agg(F.min("doc_id").alias("least")))
    of = join_checked(found, least, "component").select("node", "least")
    named = classes.select("d1", "d2", "node", "doc_id").join(of.hint("merge"), "node", "left").select("d1", "d2", F.coalesce("least", "doc_id").alias("c"))
    alone = F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.col("c")).otherwise(F.col("doc_id"))
    return (
        every.select("doc_id", "n_shingles", "d1", "d2").join(named.hint("merge"), ["d1", "d2"], "left")
        .select("doc_id", "n_shingles", alone.alias("component_id"))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )


def one_of_each(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """docs with all columns, whatever their names, one row of each component: that of the smallest doc_id (null last).

    Rows that share doc_id and text are copies like any others; of these, any one stays. Documents without words all stay.
    """
    every = scratch(sketches(docs))
    classes = classes_of(every.where("n_shingles > 0"))
    found = linked(docs, classes, percent)
    # Only nodes with a link, or of two rows or more, lose rows.
    groups = classes.join(found.hint("merge"), "node", "left").where("rows > 1 OR component IS NOT NULL")
    groups = scratch(groups.select("d1", "d2", F.coalesce("component", "node").alias("c")))
    rows = scratch(join_checked(every.select("doc_id", "r1", "r2", "d1", "d2"), groups, ["d1", "d2"]).groupBy("c", "doc_id", "r1", "r2").agg(F.count(F.lit(1)).alias("copies")))
    best = scratch(rows.groupBy("c").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "r1", "r2")).alias("best")).select("c", F.col("best.r1").alias("b1"), F.col("best.r2").alias("b2")))
    fate = scratch(join_checked(rows, best, "c").select("r1", "r2", ((F.col("r1") == F.col("b1")) & (F.col("r2") == F.col("b2"))).cast("int").alias("stays"), "copies"))
    again = scratch(fate.where("stays = 1 AND copies > 1").select("r1", "r2"))
    drop(every, classes, found, groups, rows, best)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *row_keys())
    plain = join_checked(packed, fate, ["r1", "r2"], "left").where("stays IS NULL OR (stays = 1 AND copies = 1)").select("row")
    repeated = join_checked(packed, again, ["r1", "r2"]).groupBy("r1", "r2").agg(F.first("row").alias("row")).select("row")
    return plain.unionAll(repeated).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
