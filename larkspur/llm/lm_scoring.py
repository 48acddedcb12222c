"""Language-model scores: marginal likelihood of a text over all subword segmentations of its words."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import UPPER_TO_LOWER, scratch

#: Words that every task holds, and bytes of the longest of them; rounds of re-estimation; words that a task counts before it
#: sends them on; bytes up to which words of one length are taken together; bytes of a longer one whose pieces are held at once.
HEAD_WORDS, HEAD_BYTES, ROUNDS, COUNTED_WORDS, SHORT, HELD = 200_000, 64, 2, 400_000, 64, 1 << 16
#: Documents whose crc32(id) leaves this remainder are held out.
FOLDS, HELD_FOLD = 7, 2
LOG10 = math.log(10)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_FOLD, F.lit(False))


class Lattice:
    """Unigram scores of subword pieces; forward and backward sums over the segmentations of many words at once.

    A word is a start mark and its UTF-8 bytes. The vocabulary has all single bytes, so every word can be segmented. Words of
    one length are the rows of a matrix; all of their pieces that begin at one byte are found together by hash. Longer words
    are taken alone, their pieces for many bytes at once; pieces are short, so time and memory are linear in a word's length.
    """

    MARK = b"\xff"  # no byte of UTF-8 text
    FACTOR = 0x9E3779B97F4A7C15

    def __init__(self, log_prob: dict[bytes, float]):
        self.pieces = list(log_prob)
        number = {piece: i for i, piece in enumerate(self.pieces)}
        begins = {piece[:k] for piece in self.pieces for k in range(1, len(piece) + 1)}
        hashed = sorted((self.hash_of(x), number.get(x, -1)) for x in begins)
        #: Hashes of pieces and of what pieces begin with; the piece's number or -1; scores, the last for -1.
        self.hashes = np.array([h for h, _ in hashed], np.uint64)
        self.number = np.array([i for _, i in hashed], np.int64)
        self.scores_of = np.array([*log_prob.values(), -np.inf])

    @classmethod
    def hash_of(cls, piece: bytes) -> int:
        h = 0
        for b in piece:
            h = (h * cls.FACTOR + b + 1) & (1 << 64) - 1
        return h

    def arcs(self, rows: np.ndarray) -> list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """(start, end, rows, pieces, scores) of all pieces in a matrix of bytes, by start."""
        out, n = [], rows.shape[1]
        data, last = rows.astype(np.uint64) + np.uint64(1), len(self.hashes) - 1
        for i in range(n):
            at, h = np.arange(len(rows)), np.zeros(len(rows), np.uint64)
            for j in range(i, n):
                h = h * np.uint64(self.FACTOR) + data[at, j]
                place = np.minimum(np.searchsorted(self.hashes, h), last)
                alive = self.hashes[place] == h
                at, h, piece = at[alive], h[alive], self.number[place[alive]]
                if not len(at):
                    break
                real = piece >= 0
                if real.any():
                    out.append((i, j + 1, at[real], piece[real], self.scores_of[piece[real]]))
        return out

    def forward(self, arcs: list, shape: tuple[int, int]) -> np.ndarray:
        """Log of the summed probability of all segmentations up to each byte."""
        alpha = np.full((shape[0], shape[1] + 1), -np.inf)
        alpha[:, 0] = 0
        for i, j, at, _, p in arcs:
            alpha[at, j] = np.logaddexp(alpha[at, j], alpha[at, i] + p)
        return alpha

    def matrices(self, words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Matrices of the bytes of short words of one length, and the place of each row's word."""
        short = np.array([w for w, word in enumerate(words) if len(word) < SHORT], np.int64)
        length = np.fromiter((len(words[w]) for w in short), np.int64, len(short))
        order = np.argsort(length, kind="stable")
        edges = np.flatnonzero(np.diff(length[order], prepend=-1, append=-1))
        for a, b in zip(edges, edges[1:], strict=False):
            for low in range(a, b, 8192):
                some = short[order[low : min(b, low + 8192)]]
                yield np.frombuffer(b"".join([self.MARK + words[w] for w in some]), np.uint8).reshape(len(some), -1), some

    def arcs_of_long(self, data: np.ndarray, low: int) -> tuple[list, list, list, list]:
        """Starts, ends, pieces and scores of all pieces of a long word that begin at one of HELD bytes from ``low`` on, by start."""
        last = len(self.hashes) - 1
        at = np.arange(low, min(low + HELD, len(data)))
        h, found, length = np.zeros(len(at), np.uint64), [], 0
        while len(at):
            h = h * np.uint64(self.FACTOR) + data[at + length]
            place = np.minimum(np.searchsorted(self.hashes, h), last)
            alive = self.hashes[place] == h
            at, h, piece = at[alive], h[alive], self.number[place[alive]]
            length += 1
            found.append((at[piece >= 0], at[piece >= 0] + length, piece[piece >= 0]))
            inside = at + length < len(data)
            at, h = at[inside], h[inside]
        start, end, piece = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((end, start))
        return start[order].tolist(), end[order].tolist(), piece[order].tolist(), self.scores_of[piece[order]].tolist()

    def forward_of_long(self, word: bytes) -> tuple[np.ndarray, list[float]]:
        """The word's bytes, and the log of the summed probability of all segmentations up to each of them."""
        data = np.frombuffer(self.MARK + word, np.uint8).astype(np.uint64) + np.uint64(1)
        alpha = [-math.inf] * (len(data) + 1)
        alpha[0] = 0.0
        for low in range(0, len(data), HELD):
            for i, j, _, p in zip(*self.arcs_of_long(data, low), strict=True):
                alpha[j] = log_sum(alpha[j], alpha[i] + p)
        return data, alpha

    def scores(self, words: list[bytes]) -> np.ndarray:
        """Natural logs of the words' marginal probabilities."""
        out = np.zeros(len(words))
        for rows, owner in self.matrices(words):
            out[owner] = self.forward(self.arcs(rows), rows.shape)[:, -1]
        for w, word in enumerate(words):
            if len(word) >= SHORT:
                out[w] = self.forward_of_long(word)[1][-1]
        return out

    def expected(self, words: list[bytes], weights: np.ndarray) -> np.ndarray:
        """Expected number of uses of each piece in so many occurrences of each word."""
        uses = np.zeros(len(self.pieces))
        for rows, owner in self.matrices(words):
            arcs = self.arcs(rows)
            alpha = self.forward(arcs, rows.shape)
            beta = np.full_like(alpha, -np.inf)
            beta[:, -1] = 0
            for i, j, at, _, p in reversed(arcs):
                beta[at, i] = np.logaddexp(beta[at, i], p + beta[at, j])
            if arcs:
                pieces = np.concatenate([x[3] for x in arcs])
                share = np.concatenate([np.exp(alpha[at, i] + p + beta[at, j] - alpha[at, -1]) * weights[owner[at]] for i, j, at, _, p in arcs])
                uses += np.bincount(pieces, share, len(uses))
        for w, word in enumerate(words):
            if len(word) >= SHORT:
                data, ahead = self.forward_of_long(word)
                behind = [-math.inf] * len(ahead)
                behind[-1] = 0.0
                for low in reversed(range(0, len(data), HELD)):
                    for i, j, k, p in reversed(list(zip(*self.arcs_of_long(data, low), strict=True))):
                        behind[i] = log_sum(behind[i], p + behind[j])
                        uses[k] += math.exp(ahead[i] + p + behind[j] - ahead[-1]) * weights[w]
        return uses


def log_sum(a: float, b: float) -> float:
    """Log of e**a + e**b."""
    if a < b:
        a, b = b, a
    return a if b == -math.inf else a + math.log1p(math.exp(b - a))


def vocabulary(model_path: str) -> dict[bytes, float]:
    """Pieces of an existing subword vocabulary with their scores, as bytes; the word mark is one byte, every byte is a piece.

    A vocabulary that is scored by rank (score -r for rank r) gets log-probabilities that fall with the log of the rank.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
    scores: dict[bytes, float] = {}
    for i in range(sp.get_piece_size()):
        if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i):
            continue
        piece = sp.id_to_piece(i).replace("▁", "\x00").encode().replace(b"\x00", Lattice.MARK)
        scores[piece] = -math.log(1.0 - sp.get_score(i))
    floor = min(scores.values())
    for b in range(256):
        scores.setdefault(bytes([b]), floor)
    total = math.log(sum(math.exp(s) for s in scores.values()))
    return {k: v - total for k, v in scores.items()}


def training_counts(docs: DataFrame) -> DataFrame:
    """(word, c) over the documents that are not held out; each task adds up its own words first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}
        for batch in batches:
            for text in batch.column(0):
                for w in (text.as_py() or "").encode().translate(UPPER_TO_LOWER).split():
                    seen[w] = seen.get(w, 0) + 1
                if len(seen) >= COUNTED_WORDS:
                    yield out(seen)
                    seen = {}
        yield out(seen)

    def out(seen: dict[bytes, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(seen, pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "c"])

    return docs.where(~held_out(F.col("doc_id"))).select("text").mapInArrow(count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def estimate(counts: DataFrame, ends: int, start: dict[bytes, float], rounds: int = ROUNDS) -> tuple[dict[bytes, float], float]:
    """Re-estimate piece scores by expectation-maximisation over all distinct training words.

    Only sums per piece leave the tasks; there are as many as the vocabulary has pieces. Add-one smoothing keeps all pieces.
    Returns log-probabilities of the pieces and of the end token.
    """
    spark = counts.sparkSession
    log_prob = start
    end = math.log(0.5)
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(log_prob)

        def expected(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            lattice = Lattice(sent.value)
            uses = np.zeros(len(lattice.pieces))
            for batch in batches:
                uses += lattice.expected(batch.column(0).to_pylist(), batch.column(1).to_numpy())
            used = np.flatnonzero(uses)
            yield pa.RecordBatch.from_arrays([pa.array([lattice.pieces[i] for i in used], pa.binary()), pa.array(uses[used])], ["piece", "n"])

        rows = counts.mapInArrow(expected, "piece binary, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()
        uses = dict.fromkeys(start, 1.0)
        for r in rows:
            uses[bytes(r["piece"])] += r["n"]
        total = math.log(sum(uses.values()) + ends)
        log_prob = {k: math.log(v) - total for k, v in uses.items()}
        end = math.log(max(ends, 1)) - total
    return log_prob, end


def word_scores(counts: DataFrame, log_prob: dict[bytes, float]) -> DataFrame:
    """counts with lp, the log-likelihood of each word: every distinct word is scored once. Written."""
    sent = counts.sparkSession.sparkContext.broadcast(log_prob)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(sent.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lattice.scores(batch.column(0).to_pylist()))], ["word", "c", "lp"])

    return scratch(counts.mapInArrow(score, "word binary, c long, lp double"))


class Head(dict):
    """Numbers of the frequent words; -1 for all others."""

    def __missing__(self, word: bytes) -> int:
        return -1


def frequent(words: DataFrame, most: int) -> list:
    """The rows of the most frequent words of bounded length: those from the smallest count on that leaves no more than ``most``."""
    words = words.where(F.octet_length("word") <= HEAD_BYTES)
    sizes = words.groupBy("c").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("c")).limit(most).collect()
    total, least = 0, None
    for r in sizes:
        total += r["n"]
        if total > most:
            break
        least = r["c"]
    return [] if least is None else words.where(F.col("c") >= least).collect()


def score_documents(docs: DataFrame, model_path: str, rounds: int = ROUNDS, head_words: int = HEAD_WORDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of docs (doc_id, text).

    score: log10 of the probability of the text's words and its end under a unigram model over the pieces of an existing
    vocabulary, summed over all segmentations of each word by forward recursion. Piece scores start from the vocabulary's own
    and are re-estimated on the documents that are not held out. base_score: add-one word unigrams of the same documents.

    Every distinct training word is scored once. The frequent ones are looked up in the tasks, all others are joined by word,
    and words that training has not seen are scored where the join leaves them.

    A null text is empty: one end token. Documents with a null id are trained on. Rows that share a doc_id are counted each
    and get a row each. An empty table gives an empty result; with no training words, counts are 0.
    """
    spark = docs.sparkSession
    counts = scratch(training_counts(docs))
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    ends = docs.where(~held_out(F.col("doc_id"))).count()
    n, v = n + ends, v + (ends > 0)
    log_prob, end = estimate(counts, ends, vocabulary(model_path), rounds)
    words = word_scores(counts, log_prob)
    denominator = n + (v + 1)
    end_base = math.log10((ends + 1) / denominator)
    head = frequent(words, head_words)
    logs = np.array([math.log10((r["c"] + 1) / denominator) for r in head] + [0.0])
    sent = spark.sparkContext.broadcast(({bytes(r["word"]): i for i, r in enumerate(head)}, logs, np.array([r["lp"] for r in head] + [0.0])))
    del head

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (head, logs, scores), salt = sent.value, 0
        head = Head(head)
        for batch in batches:
            kept: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                salt += 1
                words = (text.as_py() or "").encode().translate(UPPER_TO_LOWER).split()
                at = np.fromiter(map(head.__getitem__, words), np.int64, len(words))
                rare: dict[bytes, int] = {}
                for i in np.flatnonzero(at < 0).tolist():
                    rare[words[i]] = rare.get(words[i], 0) + 1
                kept.append((doc_id, salt, len(words) + 1, int((at >= 0).sum()) + (ends > 0), float(logs[at].sum()) + end_base, float(scores[at].sum()) + end, rare))
                if len(kept) >= 500:
                    yield out(kept)
                    kept = []
            yield out(kept)

    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.map_(pa.binary(), pa.int64())]

    def out(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
        columns[-1] = [list(x.items()) for x in columns[-1]]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], ["doc_id", "salt", "n_tokens", "n_known", "base", "lp", "rare"])

    schema = "doc_id long, salt long, n_tokens long, n_known long, base double, lp double, rare map<binary, bigint>"
    part = scratch(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(looked_up, schema).withColumn("task", F.spark_partition_id()))
    rare = part.select("task", "salt", F.explode("rare").alias("word", "k")).join(words.hint("merge"), "word", "left")
    model = spark.sparkContext.broadcast(log_prob)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(model.value)
        for batch in batches:
            k, known = batch.column(3).to_numpy(), batch.column(4).is_valid().to_numpy(zero_copy_only=False)
            c = batch.column(4).fill_null(0).to_numpy()
            lp = batch.column(5).fill_null(0.0).to_numpy().copy()
            new = np.flatnonzero(~known)
            lp[new] = lattice.scores(batch.column(2).take(pa.array(new)).to_pylist())
            sums = [pa.array(k * np.log10((c + 1) / denominator)), pa.array(np.where(known, k, 0)), pa.array(k * lp)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *sums], ["task", "salt", "base", "known", "lp"])

    added = (
        rare.select("task", "salt", "word", "k", "c", "lp").mapInArrow(joined, "task int, salt long, base double, known long, lp double")
        .groupBy("task", "salt").agg(F.sum("base").alias("more_base"), F.sum("known").alias("more_known"), F.sum("lp").alias("more_lp"))
    )
    zero = F.lit(0.0)
    return part.join(added.hint("merge"), ["task", "salt"], "left").select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", zero)).alias("base_score"),
        ((F.col("lp") + F.coalesce("more_lp", zero)) / LOG10).alias("score"),
    )
