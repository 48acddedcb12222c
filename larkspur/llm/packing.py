"""Packing documents into token windows by multiway differencing."""

from __future__ import annotations

import heapq
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import UPPER_TO_LOWER, scratch

#: Tokens of a window; of a piece of what is left of a document beside whole windows (smaller pieces balance better); id that
#: ends a document; windows that one group is packed into; words whose ids a task keeps.
WINDOW, REST, END_ID, GROUP_WINDOWS, CACHE_WORDS, CACHE_WORD_BYTES = 4096, 512, 2, 128, 300_000, 48

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, salt long"


_WORD_AND_MARKS = re.compile(rb"([a-z\x80-\xff]+)([!-/:-@\[-`{-~]+)")
#: Letters that need no normal form and have one small letter each; signs of a tokenizer's bytes.
_LATIN = re.compile("[a-zÀ-ÖØ-öø-ÿ]+")
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_LEVEL = dict(zip(sorted(set(range(256)) - set(_PLAIN)), range(256, 512)))


def packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class WordIds(dict):
    """Ids of a word as little-endian unsigned 32-bit numbers; a tokenizer that drops white space takes words one by one.

    Words are in lower case, as the tokenizer would make them. Letters and the marks after them are tokens apart, so each is
    kept by itself as well. What is not used while CACHE_WORDS words come new is forgotten.
    """

    def __init__(self, tokenizer_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.letters = self.tokenizer.model.tokenize
        self.old: dict[bytes, bytes] = {}

    def ids_of(self, word: bytes) -> bytes:
        if word.isalpha() and word.islower():
            return packed([t.id for t in self.letters(word.decode())])
        parts = _WORD_AND_MARKS.fullmatch(word)
        if parts and parts[1].decode()[-1].isalpha():
            return self[parts[1]] + self[parts[2]]
        text = word.decode()
        if _LATIN.fullmatch(text):
            return packed([t.id for t in self.letters(text.lower().encode().decode("latin-1").translate(_BYTE_LEVEL))])
        return packed(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids)

    def __missing__(self, word: bytes) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = self.ids_of(word)
        if len(word) <= CACHE_WORD_BYTES:
            if len(self) >= CACHE_WORDS:
                self.old = dict(self)
                self.clear()
            self[word] = ids
        return ids

    def of(self, text: str | None) -> bytes:
        data = (text or "").encode()
        if b"<|" not in data:  # names of special tokens are told by their case
            data = data.translate(UPPER_TO_LOWER)
        return b"".join(map(self.__getitem__, data.split()))


def token_pieces(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, rest: int = REST, keep_ids: bool = False) -> DataFrame:
    """Documents (doc_id, text) as pieces in order and without gaps: whole windows, then ``rest`` ids at most; a null text is empty.

    ``salt`` numbers the documents of a task. With ``keep_ids`` the ids themselves come along.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, end, salt = WordIds(tokenizer_path), np.array([END_ID], "<u4").tobytes(), 0
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                salt += 1
                ids = memoryview(cache.of(text.as_py()) + end)
                n = len(ids) // 4
                whole = n - n % window
                for start in [*range(0, whole, window), *range(whole, n, rest)]:
                    part = ids[start * 4 : min(start + (window if start < whole else rest), n) * 4]
                    row = (doc_id, start, len(part) // 4, zlib.crc32(part), n, salt)
                    rows.append((*row, np.frombuffer(part, "<u4").astype(np.int32)) if keep_ids else row)
                if len(rows) >= 20_000:
                    yield batch_of(rows)
                    rows = []
            yield batch_of(rows)

    names = [x.split()[0] for x in PIECE.split(", ")]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * (len(names) + keep_ids)
        arrays = [pa.array(x, pa.int64()) for x in columns[: len(names)]]
        if keep_ids:
            arrays.append(pa.array(list(columns[-1]), pa.list_(pa.int32())))
        return pa.RecordBatch.from_arrays(arrays, names + ["ids"] * keep_ids)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, PIECE + ", ids array<int>" * keep_ids)


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Karmarkar-Karp: deal items into k subsets of near-equal sums; returns the items of each subset.

    A partial partition is a list of (sum, items), largest first, with the empty subsets left out. The two partitions
    with the widest spread are merged again and again, the largest sums of one with the smallest of the other.
    """
    heap = [(-size, i, [(size, [i])]) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    tick = len(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        b.reverse()
        alone = min(len(a), k - len(b))
        both = len(a) - alone
        merged = a[:alone] + [(x[0] + y[0], x[1] + y[1]) for x, y in zip(a[alone:], b[:both], strict=True)] + b[both:]
        merged.sort(key=lambda x: -x[0])
        spread = merged[0][0] - (merged[-1][0] if len(merged) == k else 0)
        heapq.heappush(heap, (-spread, tick, merged))
        tick += 1
    return [items for _, items in heap[0][2]] if heap else []


def windows_for(sizes: list[int], window: int = WINDOW) -> list[list[int]]:
    """Items of each window; the number of windows rises while one of them is too full."""
    k = max(1, -(-sum(sizes) // window))
    while True:
        subsets = differencing(sizes, k)
        if all(sum(sizes[i] for i in s) <= window for s in subsets):
            return subsets
        k += 1


def pack(pieces: DataFrame, window: int = WINDOW, group_windows: int = GROUP_WINDOWS) -> DataFrame:
    """Give each piece of a written table its window and its place there.

    Whole windows stand alone. The others are dealt into groups of about ``group_windows`` windows by a hash of document and
    salt, so no group grows with the input, and each group is packed by itself.
    """
    total = pieces.agg(F.sum("length")).first()[0] or 0
    groups = max(1, round(total / (group_windows * window)))

    def place(key: tuple, part: pa.Table) -> pa.Table:
        part = part.sort_by([("doc_id", "ascending"), ("salt", "ascending"), ("start", "ascending")])
        sizes = part["length"].to_numpy()
        alone = np.flatnonzero(sizes >= window)
        shared = np.flatnonzero(sizes < window)
        sequence, offset = np.zeros(len(part), np.int64), np.zeros(len(part), np.int64)
        sequence[alone] = np.arange(len(alone))
        for n, items in enumerate(windows_for(sizes[shared].tolist(), window) if len(shared) else [], len(alone)):
            at = shared[sorted(items)]
            sequence[at] = n
            offset[at] = np.cumsum(sizes[at]) - sizes[at]
        sequence += key[0].as_py() << 32
        return part.drop_columns(["salt", "grp"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    keyed = pieces.withColumn("grp", F.pmod(F.xxhash64("doc_id", "salt"), F.lit(groups)))
    more = [f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema if f.name == "ids"]
    return keyed.groupBy("grp").applyInArrow(place, ", ".join([PIECE.replace(", salt long", ""), *more, "sequence_id long", "offset long"]))


def packed_documents(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, rest: int = REST, keep_ids: bool = False) -> DataFrame:
    """Pieces of every document (doc_id, text) with their windows: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is its end token alone. Rows that share a doc_id are documents of their own. Documents are cut at
    multiples of a window, and what is left at multiples of ``rest``. Other columns are not read; an empty table gives no pieces.
    """
    return pack(scratch(token_pieces(docs, tokenizer_path, window, rest, keep_ids)), window)
