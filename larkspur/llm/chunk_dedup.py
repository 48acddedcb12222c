"""Substring dedup: content-defined chunks by a gear rolling hash, compared by digest."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import join_checked, scratch

#: Bytes that the rolling hash sees; a boundary is where its low MASK_BITS bits are 0; least and most bytes of a chunk; least
#: bytes of a run of repeated chunks that counts as a repeated passage.
SEEN, MASK_BITS, LEAST, MOST, RUN = 16, 4, 16, 128, 120


def gear_table(seed: int = 1) -> np.ndarray:
    """A random 32-bit number for each byte."""
    return np.array([xxhash.xxh32_intdigest(bytes([b]), seed) for b in range(256)], np.uint32)


def gear_hashes(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    """At each byte, the sum over the last SEEN bytes of their gear shifted by their distance, by doubling."""
    h = table[data]
    width = 1
    while width < SEEN:
        h[width:] = h[width:] + (h[:-width] << np.uint32(width))
        width *= 2
    return h


def chunk_ends(data: bytes, table: np.ndarray) -> list[int]:
    """Ends of a text's chunks: at boundaries of the hash that are LEAST bytes or more from the last end, after MOST at last."""
    n = len(data)
    if not n:
        return []
    # The low bits of a shifted sum only see the last MASK_BITS bytes, so the high ones are taken.
    h = gear_hashes(np.frombuffer(data, np.uint8), table) >> np.uint32(SEEN - MASK_BITS)
    ends, last = [], 0
    for cut in (np.flatnonzero((h & np.uint32((1 << MASK_BITS) - 1)) == 0) + 1).tolist():
        while cut - last > MOST:
            last += MOST
            ends.append(last)
        if cut - last >= LEAST:
            ends.append(cut)
            last = cut
    while n - last > MOST:
        last += MOST
        ends.append(last)
    if last < n:
        ends.append(n)
    return ends


def chunks(docs: DataFrame) -> DataFrame:
    """(rid, doc_id, start, length, d1, d2): every chunk of every text, in bytes, with its 128-bit digest; written."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, rid = gear_table(), (TaskContext.get().partitionId() << 40) - 1
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
        names = ["rid", "doc_id", "start", "length", "d1", "d2"]
        for batch in batches:
            rows: list[list] = [[] for _ in kinds]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rid += 1
                data = (text.as_py() or "").encode()
                ends = chunk_ends(data, table)
                starts = [0, *ends[:-1]] if ends else []
                digests = [xxhash.xxh3_128_intdigest(data[a:b]) for a, b in zip(starts, ends, strict=True)]
                for column, values in zip(rows, ([rid] * len(ends), [doc_id] * len(ends), starts, [b - a for a, b in zip(starts, ends, strict=True)], [d >> 65 for d in digests], [(d & (1 << 64) - 1) >> 1 for d in digests]), strict=True):
                    column += values
                if len(rows[0]) >= 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(rows, kinds, strict=True)], names)
                    rows = [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(rows, kinds, strict=True)], names)

    schema = "rid long, doc_id long, start int, length int, d1 long, d2 long"
    return scratch(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, schema))


def repeated_chunks(every: DataFrame) -> DataFrame:
    """Chunks whose digest occurs twice or more, with ``first``: whether it is the first place (smallest doc_id, rid, start)."""
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid", "start")
    twice = scratch(every.groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("at")).where("n > 1").select("d1", "d2", "at.rid", "at.start"))
    t = twice.withColumnRenamed("rid", "first_rid").withColumnRenamed("start", "first_start")
    found = join_checked(every, t, ["d1", "d2"])
    return found.select("rid", "doc_id", "start", "length", ((F.col("rid") == F.col("first_rid")) & (F.col("start") == F.col("first_start"))).alias("first"))


def passages(every: DataFrame, run: int = RUN) -> DataFrame:
    """(rid, doc_id, start, end, dropped): runs of adjoining repeated chunks of ``run`` bytes or more; dropped: bytes of them
    whose first place is elsewhere. A text's repeated chunks are gathered as one array: three numbers for some 32 bytes of text."""
    own = repeated_chunks(every).groupBy("rid", "doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "length", "first"))).alias("c"))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            lists = batch.column(2)
            of = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
            start, length, first = (x.to_numpy(zero_copy_only=False) for x in lists.flatten().flatten())
            end = start + length
            head = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (start[1:] != end[:-1])]))
            tail = np.append(head[1:], len(of)) - 1
            dropped = np.add.reduceat(np.where(first, 0, length), head)
            long = end[tail] - start[head] >= run
            columns = [*(batch.column(i).take(pa.array(of[head[long]])) for i in (0, 1)), *(pa.array(x[long].astype(np.int64)) for x in (start[head], end[tail], dropped))]
            yield pa.RecordBatch.from_arrays(columns, ["rid", "doc_id", "start", "end", "dropped"])

    return own.select("rid", "doc_id", "c").mapInArrow(runs, "rid long, doc_id long, start long, end long, dropped long")


def repeats(docs: DataFrame, run: int = RUN) -> DataFrame:
    """doc_id, n_passages, repeated_bytes, dropped_bytes, passages ("start:end,..." in bytes) of each row with a repeated passage.

    A text is cut into chunks where a rolling hash of its last bytes says so, so an insertion moves no boundary but those
    next to it. Chunks are compared by digest over all texts, a text with itself as well; runs of repeated chunks are passages. What is not in a passage's first place is to be dropped: dropped_bytes.

    Null and empty texts have no chunks. Rows that share a doc_id are compared with each other like any rows; a null doc_id
    comes last in the order of places. Other columns are not read. An empty table gives an empty result.
    """
    found = passages(chunks(docs), run)
    text = F.concat_ws(":", "start", "end")
    ordered = F.array_sort(F.collect_list(F.struct("start", text.alias("t"))))
    out = found.groupBy("rid", "doc_id").agg(
        F.count(F.lit(1)).alias("n_passages"), F.sum(F.col("end") - F.col("start")).alias("repeated_bytes"), F.sum("dropped").alias("dropped_bytes"), ordered.alias("p")
    )
    return out.select("doc_id", "n_passages", "repeated_bytes", "dropped_bytes", F.array_join(F.transform("p", lambda x: x["t"]), ",").alias("passages"))
