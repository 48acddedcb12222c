"""How the sources of a language differ in their terms: counts travel by fixed-width digests, texts join what is kept."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.common import UPPER_TO_LOWER, drop, join_checked, scratch

#: Documents of a language that a kept term has at least, and ranks of a group's terms.
KEEP_DOCS, TOP_TERMS = 3, 200
#: What a probability of 1 is as an integer.
SCALE = 1_000_000_000
#: Distinct terms and counts that a task holds before it passes them on; bytes of texts that are split at once.
HELD_TERMS, HELD_COUNTS, PIECE_BYTES = 600_000, 4_000_000, 4 << 20
#: Terms of a block and sources of a tile whose pairs one task compares.
BLOCK_TERMS, TILE_SOURCES = 16_384, 128

_NO_TERM = re.compile(rb"[^a-z\x80-\xff]")
#: 1 where a byte belongs to a term of a text in lower case.
_IN_TERM = bytes(97) + b"\1" * 26 + bytes(5) + b"\1" * 128
#: Terms of more bytes are told apart one by one. Bits of a document and of a term in the numbers that are sorted.
_LONG, _DOC_BITS, _TERM_BITS = 256, 16, 28
_MIX = np.uint64(0x9E3779B97F4A7C15)

Counts = tuple[np.ndarray, np.ndarray, np.ndarray]


def _pieces(data: bytes) -> Iterator[bytes]:
    """A text in pieces of about PIECE_BYTES that end where no term stands."""
    start = 0
    while len(data) - start > PIECE_BYTES:
        gap = _NO_TERM.search(data, start + PIECE_BYTES)
        end = gap.start() if gap else len(data)
        yield data[start:end]
        start = end
    yield data[start:]


def digest_of(term: bytes) -> int:
    """64 bits of a term."""
    return xxhash.xxh64_intdigest(term) - (1 << 63)


class _Words:
    """Eight bytes of a text from any place, as numbers; behind ``left`` bytes zeros, which no term has."""

    def __init__(self, data: bytes):
        self.words = np.frombuffer(data + bytes(16 + -len(data) % 8), "<u8")

    def at(self, places: np.ndarray, left: np.ndarray) -> np.ndarray:
        word, shift = places >> 3, ((places & 7) << 3).astype(np.uint64)
        low = self.words[word] >> shift
        high = (self.words[word + 1] << (np.uint64(63) - shift)) << np.uint64(1)
        spare = ((8 - np.minimum(left, 8)) << 3).astype(np.uint64)
        return (low | high) << spare >> spare


def _told_apart(data: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of its term for each place, a place of each term); terms are equal only if all their bytes are.

    Terms of at most 8 bytes are numbers themselves. Others go by a hash of their words, then each is held against a place of
    its number; should a hash have two terms, their bytes decide, as for very long terms.
    """
    length, words = ends - starts, _Words(data)
    number = np.empty(len(starts), np.int64)
    places: list[np.ndarray] = []
    known = 0

    def numbered(which: np.ndarray, keys) -> np.ndarray:
        nonlocal known
        codes, terms = pd.factorize(keys)
        first = np.empty(len(terms), np.int64)
        first[codes[::-1]] = which[::-1]
        number[which] = codes + known
        places.append(first)
        known += len(terms)
        return first[codes]

    short = np.flatnonzero(length <= 8)
    numbered(short, words.at(starts[short], length[short]))
    middle = np.flatnonzero((length > 8) & (length <= _LONG))
    hashed = np.zeros(len(middle), np.uint64)
    for k in range(0, _LONG, 8):
        on = np.flatnonzero(length[middle] > k)
        if not len(on):
            break
        at = middle[on]
        mixed = (hashed[on] ^ words.at(starts[at] + k, length[at] - k)) * _MIX
        hashed[on] = mixed ^ (mixed >> np.uint64(29))
    before = known
    held = numbered(middle, hashed)
    same = length[middle] == length[held]
    for k in range(0, _LONG, 8):
        on = np.flatnonzero(same & (length[middle] > k))
        if not len(on):
            break
        at, by = middle[on], held[on]
        same[on] = words.at(starts[at] + k, length[at] - k) == words.at(starts[by] + k, length[by] - k)
    by_bytes = [np.flatnonzero(length > _LONG)]
    if not same.all():
        places.pop()
        known = before
        by_bytes.append(middle)
    for which in by_bytes:
        terms = np.empty(len(which), object)
        terms[:] = [data[a:b] for a, b in zip(starts[which].tolist(), ends[which].tolist(), strict=True)]
        numbered(which, terms)
    return number, np.concatenate(places)


def _added(parts: list[Counts]) -> Counts:
    """Counts (key, n, docs) with one row a key."""
    key, n, docs = (np.concatenate(c) for c in zip(*parts, strict=True))
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    return key[first], *[np.add.reduceat(c[order], first) if len(first) else c for c in (n, docs)]


def _counted(data: bytes, doc_starts: np.ndarray, groups: np.ndarray, ids: dict[bytes, int]) -> Counts:
    """(group and term in one number, n, docs) of documents that begin at these bytes of a text in lower case; ``ids`` learns new terms."""
    inside = np.frombuffer(data.translate(_IN_TERM), bool)
    begins, closes = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    cuts = doc_starts[(doc_starts > 0) & (doc_starts < len(data))]
    begins[cuts] = inside[cuts]
    closes[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(closes) + 1
    if not len(starts):
        return tuple(np.empty(0, np.int64) for _ in range(3))
    number, places = _told_apart(data, starts, ends)
    terms = [data[a:b] for a, b in zip(starts[places].tolist(), ends[places].tolist(), strict=True)]
    new = set(terms).difference(ids)
    ids.update(zip(new, range(len(ids), len(ids) + len(new)), strict=True))
    term = np.fromiter(map(ids.__getitem__, terms), np.int64, len(terms))[number]
    doc = np.searchsorted(doc_starts, starts, "right") - 1
    key = np.sort((groups[doc] << _TERM_BITS | term) << _DOC_BITS | doc)
    by_doc = np.flatnonzero(np.diff(key, prepend=-1))
    pair = key[by_doc] >> _DOC_BITS
    first = np.flatnonzero(np.diff(pair, prepend=-1))
    return pair[first], np.diff(by_doc[first], append=len(key)), np.diff(first, append=len(by_doc))


def _portions(texts: pa.Array) -> Iterator[tuple[int, list[bytes], np.ndarray]]:
    """(first text, its pieces or the texts' bytes, where each begins) of consecutive texts of PIECE_BYTES in all, or one longer text."""
    size = pa.compute.binary_length(texts).to_numpy(zero_copy_only=False)
    at = 0
    while at < len(texts):
        below = int(np.searchsorted(np.cumsum(size[at : at + (1 << _DOC_BITS)]), PIECE_BYTES, "right"))
        many = texts.slice(at, max(below, 1))
        data = b"".join(many.to_pylist()).translate(UPPER_TO_LOWER)
        starts = np.concatenate([[0], np.cumsum(size[at : at + len(many) - 1])]).astype(np.int64)
        yield at, [data] if below else list(_pieces(data)), starts
        at += len(many)


def term_counts(docs: DataFrame, digest: Callable[[bytes], int] | None = digest_of) -> DataFrame:
    """(lang, source, digest, n, docs, term) of docs (text, lang, source): rows of two kinds, several for a key where tasks pass on in parts.

    Counts: occurrences n and documents of a term's digest, without its text; each group has a row without a digest as well, so
    that groups without terms are known. Texts: the terms of a language with their digests, no source and no counts. Without a
    ``digest`` counts have the term's text instead, and there are no texts. Within a task terms are numbers that stand for all
    their bytes, so what one task counts together is one term.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: dict[bytes, int] = {}
        groups: dict[tuple[str, str], int] = {}
        parts: list[Counts] = []
        rows, limit = 0, HELD_COUNTS // 2

        def batch_of(size: int, **columns) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(size, f.type)) for f in _COUNTS], schema=_COUNTS)

        def out():
            if not groups:
                return
            langs, sources = (pa.array(x, pa.string()) for x in zip(*groups, strict=True))
            none = pa.array(np.zeros(len(groups), np.int64))
            yield batch_of(len(groups), lang=langs, source=sources, n=none, docs=none)
            if not ids:
                return
            key, n, docs = _added(parts)
            group, term = key >> _TERM_BITS, key & ((1 << _TERM_BITS) - 1)
            texts = pa.array(ids, pa.binary()).view(pa.string())
            digests = np.fromiter(map(digest, ids), np.int64, len(ids)) if digest else None
            for a in range(0, len(key), HELD_TERMS):
                g, t = group[a : a + HELD_TERMS], term[a : a + HELD_TERMS]
                name = {"digest": pa.array(digests[t])} if digest else {"term": texts.take(pa.array(t))}
                yield batch_of(len(g), lang=langs.take(pa.array(g)), source=sources.take(pa.array(g)), n=pa.array(n[a : a + len(g)]), docs=pa.array(docs[a : a + len(g)]), **name)
            if digest:
                lang_of, names = pd.factorize(np.array(langs.to_pylist(), object))
                for lang, name in enumerate(names):
                    own = np.unique(term[lang_of[group] == lang])
                    if len(own):
                        yield batch_of(len(own), lang=pa.repeat(pa.scalar(name, pa.string()), len(own)), digest=pa.array(digests[own]), term=texts.take(pa.array(own)))

        for batch in batches:
            group = [groups.setdefault(g, len(groups)) for g in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            group = np.array(group, np.int64)
            for at, pieces, starts in _portions(batch.column(2).cast(pa.binary())):
                counts = [_counted(piece, starts, group[at:], ids) for piece in pieces]
                if len(counts) > 1:
                    key, n, _ = _added(counts)
                    counts = [(key, n, np.ones(len(key), np.int64))]
                parts += counts
                rows += len(counts[0][0])
                if rows > limit:
                    parts = [_added(parts)]
                    rows = len(parts[0][0])
                    limit = max(limit, 2 * rows)
                if len(ids) > HELD_TERMS or rows > HELD_COUNTS:
                    yield from out()
                    ids, parts, rows, limit = {}, [], 0, HELD_COUNTS // 2
            if len(groups) >= 1 << 18:
                yield from out()
                ids, groups, parts, rows, limit = {}, {}, [], 0, HELD_COUNTS // 2
        yield from out()

    given = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    return given.mapInArrow(count, "lang string, source string, digest long, n long, docs long, term string")


_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("digest", pa.int64()), ("n", pa.int64()), ("docs", pa.int64()), ("term", pa.string())])


def _share(n: Column, total: Column) -> Column:
    """1 + floor(SCALE * (n + 1) / total), by decimals where 64 bits do not hold the product; 1 where there is no total."""
    big = F.lit(SCALE).cast("decimal(10,0)") * (n + 1).cast("decimal(20,0)")
    small = F.call_function("div", F.lit(SCALE).cast("long") * (n + 1), total) + 1
    return F.when(total <= 0, F.lit(1)).when(n < (1 << 62) // SCALE, small).otherwise(F.floor(_whole_quotient(big, total)) + 1).cast("long")


def _whole_quotient(a: Column, b: Column) -> Column:
    """Integer division of whole decimals: the remainder is taken off first, so the quotient is a whole number."""
    d = b.cast("decimal(20,0)")
    return ((a - F.pmod(a, d)) / d).cast("decimal(30,0)")


def _gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q) of shares, whose squares 64 bits hold."""
    return F.call_function("div", (p - q) * (p - q), q)


def kept_terms(docs: DataFrame, rows: DataFrame, sums: DataFrame, keep: int) -> tuple[DataFrame, DataFrame]:
    """(kept, counts) of rows of term_counts() and their sums (lang, source, digest, n, docs), both written.

    kept: (lang, digest, part, term, lang_n); counts: (lang, source, digest, part, n, lang_n) of kept terms. Counts are shuffled
    by digest alone. A language's smallest and largest string of a digest tell whether terms collide; if any do, the terms of
    those digests are counted again by their text and told apart by ``part``, their place among the strings. No collision: part 0.
    """
    key = ["lang", "digest"]
    columns = ["lang", "source", "digest", "part", "n", "lang_n"]
    often = scratch(sums.where("digest is not null").groupBy(*key).agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n")).where(F.col("docs") >= keep).drop("docs"))
    strings = rows.where("term is not null").groupBy(*key).agg(F.min("term").alias("low"), F.max("term").alias("high"))
    found = scratch(join_checked(strings, often, key))
    drop(often)
    alone = found.where("low = high").select(*key, F.lit(0).alias("part"), F.col("low").alias("term"), "lang_n")
    mixed = found.where("low <> high").select(*key)
    if mixed.isEmpty():
        kept = scratch(alone)
        drop(found)
        return kept, join_checked(sums, kept.drop("term"), key).select(*columns)
    terms = scratch(join_checked(rows.where("term is not null").select(*key, "term").distinct(), scratch(mixed), key))
    again = term_counts(docs, None).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    texts = scratch(join_checked(again, terms, ["lang", "term"]))
    apart = texts.groupBy(*key, "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n")).where(F.col("docs") >= keep)
    apart = scratch(apart.withColumn("part", F.row_number().over(Window.partitionBy(*key).orderBy("term"))).select(*key, "part", "term", "lang_n"))
    kept = scratch(alone.unionByName(apart))
    plain = join_checked(sums, scratch(alone.drop("term")), key)
    split = join_checked(texts.drop("docs"), apart, [*key, "term"])
    return kept, plain.select(*columns).unionByName(split.select(*columns))


def _compare(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Sums of gaps of all pairs of sources of two tiles over the terms of a block that one of them has."""
    lang, left, right, _ = key
    sources = rows[rows["digest"].isna()].sort_values("i")
    i, rest = sources["i"].to_numpy(np.int64), sources["p"].to_numpy(np.int64)
    cells = rows[rows["digest"].notna()]
    term = cells.groupby(["digest", "part"], sort=False).ngroup().to_numpy() if len(cells) else np.empty(0, np.int64)
    n = int(term.max()) + 1 if len(term) else 0
    p = np.tile(rest, (n, 1))
    p[term, np.searchsorted(i, cells["i"].to_numpy(np.int64))] = cells["p"].to_numpy(np.int64)
    tile = i // TILE_SOURCES
    out = []
    for a, b in {(left, right), (right, left)}:
        others = np.flatnonzero(tile == b)
        q = p[:, others]
        for g in np.flatnonzero(tile == a):
            d = p[:, g, None] - q
            out.append(pd.DataFrame({"i": i[g], "j": i[others], "value": (d * d // q).sum(axis=0) if n else np.zeros(len(others), np.int64)}))
    pairs = pd.concat(out)
    pairs = pairs[pairs["i"] != pairs["j"]]
    return pairs.assign(lang=lang, terms=n)[["lang", "i", "j", "value", "terms"]]


def pair_gaps(groups: DataFrame, shares: DataFrame) -> DataFrame:
    """(lang, source, item, value) of all pairs of sources of a language.

    groups: (lang, source, i, v, rest) with i the number of the source in its language, v the kept terms and rest the share of a
    term that the group lacks; shares: (lang, i, digest, part, p, v) of terms that it has. Blocks of terms meet tiles of
    sources, so a task compares a bounded matrix; what both lack is reckoned at once. Written tables.
    """
    def placed(df: DataFrame) -> DataFrame:
        tiles = df.withColumn("_tile", F.floor(F.col("i") / TILE_SOURCES)).withColumn("_other", F.explode(F.expr("sequence(0L, tiles - 1)")))
        return tiles.withColumn("left", F.least("_tile", "_other")).withColumn("right", F.greatest("_tile", "_other"))

    blocks = F.greatest(F.ceil(F.col("v") / BLOCK_TERMS), F.lit(1))
    sources = placed(groups.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))))
    columns = ["lang", "left", "right", "block", "i", "p", "digest", "part"]
    sources = sources.select("lang", "left", "right", "block", "i", F.col("rest").alias("p"), F.lit(None).cast("long").alias("digest"), F.lit(None).cast("int").alias("part"))
    cells = placed(shares.withColumn("block", F.pmod(F.xxhash64("digest", "part"), blocks))).select(*columns)
    sums = (
        sources.unionByName(cells).groupBy("lang", "left", "right", "block").applyInPandas(_compare, "lang string, i long, j long, value long, terms long")
        .groupBy("lang", "i", "j").agg(F.sum("value").alias("value"), F.sum("terms").alias("terms"))
    )
    one = groups.select("lang", "source", "i", "v", "rest")
    other = scratch(groups.select("lang", F.col("source").alias("item"), F.col("i").alias("j"), F.col("rest").alias("other_rest")))
    named = join_checked(join_checked(sums, one, ["lang", "i"]), other, ["lang", "j"])
    value = F.col("value") + (F.col("v") - F.col("terms")) * _gap(F.col("rest"), F.col("other_rest"))
    return named.select("lang", "source", "item", value.alias("value"))


def top_terms(gaps: DataFrame, kept: DataFrame, top: int) -> DataFrame:
    """(lang, source, item, value, rank) of the first ``top`` terms of each group of gaps (lang, source, digest, part, value), written.

    The values alone give each group's last value; only terms at it or above get their text, which decides ties.
    """
    group = Window.partitionBy("lang", "source")
    last = (
        gaps.select("lang", "source", "value").withColumn("_n", F.row_number().over(group.orderBy(F.desc("value")))).where(F.col("_n") <= top)
        .groupBy("lang", "source").agg(F.min("value").alias("last"))
    )
    near = join_checked(gaps, scratch(last), ["lang", "source"]).where("value >= last").select("lang", "source", "digest", "part", "value")
    named = join_checked(near, kept, ["lang", "digest", "part"]).select("lang", "source", F.col("term").alias("item"), "value")
    return named.withColumn("rank", F.row_number().over(group.orderBy(F.desc("value"), "item"))).where(F.col("rank") <= top)


def divergence(docs: DataFrame, keep: int = KEEP_DOCS, top: int = TOP_TERMS, digest: Callable[[bytes], int] = digest_of) -> DataFrame:
    """(lang, source, part, item, value, rank): per group of docs (text, lang, source), parts ``pair`` and ``term``.

    ``pair``: the other sources of the language by how far the group's shares are from theirs, over all kept terms; ``term``:
    the terms that the group has more often than its language, by their gap. A null text, language or source is the empty
    string; rows are documents, so repeated rows count again; a group without terms has shares too; a language without kept
    terms has pairs of value 0. Ties go by the item's bytes. Other columns are not read. An empty table gives an empty one.
    """
    rows = scratch(term_counts(docs, digest))
    sums = scratch(rows.where("n is not null").groupBy("lang", "source", "digest").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    kept, counts = kept_terms(docs, rows, sums, keep)
    counts = scratch(counts)
    langs = scratch(kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("lang_n").alias("lang_total")))
    totals = scratch(counts.groupBy("lang", "source").agg(F.sum("n").alias("total")))
    groups = join_checked(join_checked(sums.select("lang", "source").distinct(), totals, ["lang", "source"], "left"), langs, "lang", "left")
    groups = groups.select("lang", "source", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("v", "lang_total", "total")])
    groups = groups.withColumn("i", F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long") - 1)
    tiles = F.floor((F.count(F.lit(1)).over(Window.partitionBy("lang")) - 1) / TILE_SOURCES) + 1
    groups = scratch(groups.withColumn("rest", _share(F.lit(0).cast("long"), F.col("total") + F.col("v"))).withColumn("tiles", tiles))
    drop(rows, sums, totals, langs)
    own = join_checked(counts, groups, ["lang", "source"])
    shares = scratch(
        own.select(
            "lang", "source", "i", "tiles", "v", "digest", "part",
            _share(F.col("n"), F.col("total") + F.col("v")).alias("p"), _share(F.col("lang_n"), F.col("lang_total") + F.col("v")).alias("q"),
        )
    )
    drop(counts)
    pairs = pair_gaps(groups, shares)
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(by_value))
    gaps = scratch(shares.where("p > q").select("lang", "source", "digest", "part", _gap(F.col("p"), F.col("q")).alias("value")))
    terms = top_terms(gaps, kept, top)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).select(*columns).unionByName(terms.withColumn("part", F.lit("term")).select(*columns))


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS found FROM documents
), t AS (
  SELECT id, lang, source, unnest(found) AS term FROM d
), k AS (
  SELECT lang, term, CAST(count(*) AS HUGEINT) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT id) >= 3
), v AS (
  SELECT lang, CAST(count(*) AS HUGEINT) AS v, CAST(sum(n) AS HUGEINT) AS total FROM k GROUP BY lang
), c AS (
  SELECT t.lang, t.source, t.term, CAST(count(*) AS HUGEINT) AS n FROM t JOIN k USING (lang, term) GROUP BY ALL
), g AS (
  SELECT x.lang, x.source, coalesce(v.v, 0) AS v, coalesce(v.total, 0) AS lang_total, CAST(coalesce(s.total, 0) AS HUGEINT) AS total
  FROM (SELECT DISTINCT lang, source FROM d) x LEFT JOIN v USING (lang) LEFT JOIN (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL) s ON s.lang = x.lang AND s.source = x.source
), p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000 * (coalesce(c.n, 0) + 1) // (g.total + g.v) AS p, 1 + 1000000000 * (k.n + 1) // (g.lang_total + g.v) AS q
  FROM g JOIN k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), s AS (
  SELECT a.lang, a.source, b.source AS item, CAST(sum((a.p - b.p) * (a.p - b.p) // b.p) AS BIGINT) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // q AS BIGINT) FROM p WHERE n > 0 AND p > q
), o AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM r
)
SELECT lang, source, part, item, value, rank FROM o WHERE part = 'pair' OR rank <= 200
"""
