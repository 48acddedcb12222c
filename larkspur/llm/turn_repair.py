"""Repair of the order of roles in conversations by the cheapest edits: a run-length dynamic program over role and fault symbols."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby, pairwise

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import scratch
from larkspur.operators.numbering import numbered

#: Costs of edits; of a truncated row that stays.
DELETE, REROLE, INSERT, STAYS_CUT = 2, 1, 5, 5
#: Rows of a conversation whose symbols one row of a table holds; ASCII white space.
BLOCK, BLANKS = 4096, " \t\n\x0b\x0c\r"

# What has been given out: nothing, system, user last, assistant last; the first and the last may end a conversation.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
STATES, FAR = range(4), 1 << 50
#: The role that comes next unless a system row is kept first: what an insertion or another role gives, by state.
NEXT = (USER, USER, ASSISTANT, USER)
KEPT = {("s", NOTHING): SYSTEM, ("u", NOTHING): USER, ("u", SYSTEM): USER, ("u", ASSISTANT): USER, ("a", USER): ASSISTANT}
ROLE_NAMES = {USER: "user", ASSISTANT: "assistant"}
#: A symbol is a role (system, user, assistant, other) with a fault (none, blank, duplicate, truncated); a letter stands for it.
ROLES, FAULTS = "suao", "-bdt"
SYMBOLS = [(r, f) for r in ROLES for f in FAULTS]
LEGAL = {"su", "ua", "au"}

Matrix = tuple[tuple[int, ...], ...]
ONE: Matrix = tuple(tuple(0 if i == j else FAR for j in STATES) for i in STATES)


def _times(a: Matrix, b: Matrix) -> Matrix:
    """Min-plus product."""
    return tuple(tuple(min(FAR, *(a[i][k] + b[k][j] for k in STATES)) for j in STATES) for i in STATES)


@lru_cache(maxsize=None)
def power(symbol: str, k: int) -> Matrix:
    """Costs from state to state over 2^k rows of a symbol, with insertions before each."""
    if k:
        half = power(symbol, k - 1)
        return _times(half, half)
    role, fault = SYMBOLS[ord(symbol) - 65]
    row = [list(x) for x in ONE]
    insert = [list(x) for x in ONE]
    for i in STATES:
        row[i] = [FAR] * 4
        row[i][i] = DELETE
        if fault not in "bd":
            cut = STAYS_CUT if fault == "t" else 0
            row[i][NEXT[i]] = min(row[i][NEXT[i]], REROLE + cut)
            if (role, i) in KEPT:
                row[i][KEPT[role, i]] = min(row[i][KEPT[role, i]], cut)
        insert[i][NEXT[i]] = min(insert[i][NEXT[i]], INSERT)
    closed = _times(tuple(map(tuple, insert)), tuple(map(tuple, insert)))
    return _times(_times(closed, closed), tuple(map(tuple, row)))


def before(symbol: str, n: int, after: Matrix) -> Matrix:
    """Costs to go before n rows of a symbol, from those after them: one product for each binary digit of n."""
    k = 0
    while n:
        if n & 1:
            after = _times(power(symbol, k), after)
        n, k = n >> 1, k + 1
    return after


@lru_cache(maxsize=1 << 16)
def _letters(symbol: str, n: int, after: tuple[int, ...], state: int) -> tuple[str, int]:
    """The least letters of the cheapest edits of n rows of a symbol from a state, and the state after them; ``after``: costs to go
    from each state, less the smallest. Halves of a run are unrolled by the costs in its middle."""
    column = tuple((x,) * 4 for x in after)
    if n > 1:
        half = n // 2
        middle = [row[0] for row in before(symbol, n - half, column)]
        first, state = _letters(symbol, half, _leveled(middle), state)
        rest, state = _letters(symbol, n - half, after, state)
        return first + rest, state
    now = [row[0] for row in before(symbol, 1, column)]
    role, fault = SYMBOLS[ord(symbol) - 65]
    out = ""
    while True:
        if after[state] + DELETE == now[state]:
            return out + "D", state
        if now[NEXT[state]] + INSERT != now[state]:
            break
        out, state = out + "I", NEXT[state]
    kept = KEPT.get((role, state))
    if kept is not None and after[kept] + (STAYS_CUT if fault == "t" else 0) == now[state]:
        return out + "K", kept
    return out + "R", NEXT[state]


def _leveled(costs) -> tuple[int, ...]:
    low = min(costs)
    return tuple(FAR if x >= FAR else x - low for x in costs)


@lru_cache(maxsize=1 << 14)
def block_edits(symbols: str, states: tuple[int, ...]) -> tuple[list[int], list[str | None]]:
    """Costs and least audits of a block of rows from each of ``states`` to each state, in order; too far: no audit."""
    runs = [(s, sum(1 for _ in g)) for s, g in groupby(symbols)]
    after = [ONE]
    for symbol, n in reversed(runs):
        after.append(before(symbol, n, after[-1]))
    after.reverse()
    costs, audits = [], []
    for i in states:
        for j in STATES:
            costs.append(after[0][i][j])
            if costs[-1] >= FAR:
                audits.append(None)
                continue
            state, parts = i, []
            for (symbol, n), then in zip(runs, after[1:], strict=True):
                part, state = _letters(symbol, n, _leveled([then[k][j] for k in STATES]), state)
                parts.append(part)
            audits.append("".join(parts))
    return costs, audits


#: Letters and cost from a state to one that may end a conversation.
END = ((0, ""), (2 * INSERT, "II"), (INSERT, "I"), (0, ""))


def conversation_edits(costs: list[list[int]], audits: list[list[str | None]]) -> tuple[int, str]:
    """Cost and least audit of a conversation from its blocks in order: costs to go from the last to the first, then the choices."""
    to_go = [tuple(c for c, _ in END)]
    for block in reversed(costs):
        n = len(block) // 4
        to_go.append(tuple(min(block[4 * i + j] + to_go[-1][j] for j in STATES) if i < n else FAR for i in STATES))
    to_go.reverse()
    state, out = NOTHING, []
    for block, letters, here, then in zip(costs, audits, to_go, to_go[1:], strict=False):
        text, state = min((letters[4 * state + j], j) for j in STATES if block[4 * state + j] + then[j] == here[state] < FAR)
        out.append(text)
    return to_go[0][NOTHING], "".join(out) + END[state][1]


def _edits_of_blocks(symbols: pd.Series, first: pd.Series) -> pd.DataFrame:
    out = []
    for text, f in zip(symbols, first, strict=True):
        costs, audits = block_edits(text, (NOTHING,) if f else tuple(STATES))
        roles = [SYMBOLS[ord(s) - 65][0] for s in text]
        out.append((costs, audits, sum(a + b not in LEGAL for a, b in pairwise(roles))))
    return pd.DataFrame(out, columns=["costs", "audits", "illegal"])


def _edits_of_conversations(costs: pd.Series, audits: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([conversation_edits([list(x) for x in c], [list(x) for x in a]) for c, a in zip(costs, audits, strict=True)], columns=["cost", "audit"])


def _initial(role: Column) -> Column:
    start = F.substring(role, 1, 1)
    return F.when(start.isin("s", "u", "a"), start).otherwise(F.lit("o"))


def symbols(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, n, role, fault) of turns (conv_id, turn, role, text): n numbers a conversation's rows by turn, nulls first,
    role and the text's digest; the role is a letter. Texts stay behind: what is shuffled has a digest."""
    text = F.rtrim(F.coalesce("text", F.lit(" ")), F.lit(BLANKS))
    rows = turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.unhex(F.sha2(F.coalesce("text", F.lit(" ")), 256)).alias("digest"),
        F.when(text == "", "b").when(F.substring(text, -1, 1).isin(".", "!", "?"), "-").otherwise("t").alias("fault"),
    )
    placed = scratch(numbered(rows, ["conv_id"], ["turn", "role", "digest"]))
    first = placed.groupBy("conv_id", "role", "digest").agg(F.min("n").alias("_first")).select(F.col("conv_id").alias("_c"), F.col("role").alias("_r"), F.col("digest").alias("_d"), "_first")
    same = F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("role") == F.col("_r")) & (F.col("digest") == F.col("_d"))
    fault = F.when(F.col("fault") == "b", "b").when(F.col("n") > F.col("_first"), "d").otherwise(F.col("fault"))
    return placed.join(first.hint("merge"), same).select("conv_id", "turn", "n", _initial(F.col("role")).alias("role"), fault.alias("fault"))


def repair_plan(turns: DataFrame, conversations: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of each conversation of turns and of ``conversations`` (conv_id).

    A conversation's symbols are put together in blocks; a block gives the costs and least audits from state to state, in a
    small number whatever the conversation's length, and blocks are composed. Rows that share a turn are ordered by role and
    digest of the text. Conversations without rows have zeros and an empty audit.
    """
    of_blocks = F.pandas_udf(_edits_of_blocks, "costs array<bigint>, audits array<string>, illegal bigint")
    of_conversations = F.pandas_udf(_edits_of_conversations, "cost bigint, audit string")
    rows = scratch(symbols(turns))
    letter = F.element_at(F.array(*[F.lit(chr(65 + i)) for i in range(len(SYMBOLS))]), F.expr(f"(instr('{ROLES}', role) - 1) * 4 + instr('{FAULTS}', fault)"))
    own = rows.withColumn("block", F.floor((F.col("n") - 1) / block)).withColumn("symbol", letter)
    blocks = own.groupBy("conv_id", "block").agg(
        F.array_sort(F.collect_list(F.struct("n", "symbol", "role"))).alias("s"), *[F.count_if(F.col("fault") == f).alias(name) for f, name in (("b", "blank"), ("d", "duplicate"), ("t", "truncated"))]
    )
    text = F.array_join(F.transform("s", lambda x: x["symbol"]), "")
    blocks = blocks.select("conv_id", "block", "blank", "duplicate", "truncated", F.element_at("s", 1)["role"].alias("first"), F.element_at("s", -1)["role"].alias("last"), of_blocks(text, F.col("block") == 0).alias("e"))
    turn = rows.where("turn is not null").groupBy("conv_id", "turn").agg(F.lit(1).alias("_")).groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count(F.lit(1))).alias("gaps"))
    parts = blocks.select("conv_id", "blank", "duplicate", "truncated", F.struct("block", F.col("e.costs").alias("costs"), F.col("e.audits").alias("audits"), "first", "last", F.col("e.illegal").alias("illegal")).alias("b"))
    parts = parts.unionByName(turn, allowMissingColumns=True)
    if conversations is not None:
        parts = parts.unionByName(conversations.select("conv_id").distinct(), allowMissingColumns=True)
    whole = parts.groupBy("conv_id").agg(F.array_sort(F.collect_list("b")).alias("b"), *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated")])
    meets = F.expr("aggregate(sequence(1, size(b) - 1, 1), 0L, (n, i) -> n + if(concat(b[i - 1].last, b[i].first) in ('su', 'ua', 'au'), 0, 1))")
    illegal = F.expr("aggregate(b, 0L, (n, x) -> n + x.illegal)") + F.when(F.size("b") > 1, meets).otherwise(F.lit(0))
    whole = whole.withColumn("e", of_conversations(F.transform("b", lambda x: x["costs"]), F.transform("b", lambda x: x["audits"])))
    return whole.select("conv_id", "gaps", "blank", "duplicate", "truncated", illegal.alias("illegal"), F.col("e.cost").alias("cost"), F.col("e.audit").alias("audit"))


class _Edits:
    """A conversation's audit, applied to its rows as they come."""

    def __init__(self, audit: str):
        self.letters, self.state = iter(audit), NOTHING

    def _inserted(self, letter: str | None) -> Iterator[tuple[str, str, str]]:
        while letter == "I":
            self.state = NEXT[self.state]
            yield "I", ROLE_NAMES[self.state], ""
            letter = next(self.letters, None)
        self.letter = letter

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        yield from self._inserted(next(self.letters, None))
        if self.letter == "K":
            self.state = KEPT[role[0], self.state]
            yield "K", role, text
        elif self.letter == "R":
            self.state = NEXT[self.state]
            yield "R", ROLE_NAMES[self.state], text

    def end(self) -> Iterator[tuple[str, str, str]]:
        yield from self._inserted(next(self.letters, None))


def _in_order(turns: DataFrame, plan: DataFrame) -> DataFrame:
    """Each conversation's plan, then its rows in order, in one partition: its hash is a chain, and tasks read rows as they come."""
    text = F.coalesce("text", F.lit(" "))
    rows = turns.select("conv_id", F.lit(1).alias("kind"), "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.sha2(text, 256).alias("digest"), text.alias("text"))
    both = plan.withColumn("kind", F.lit(0)).unionByName(rows, allowMissingColumns=True)
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "digest")


FIGURES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def repair(turns: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation.

    turns (conv_id, turn, role, text): a null role or text is one space; rows of a null conv_id are a conversation; rows are
    taken by turn, nulls first, then by role and digest of the text; of repeated rows all but the first are duplicates; an
    empty role is none of the three. ``conversations`` (conv_id) adds those that have no rows. Other columns are not read; an
    empty table gives an empty one. The hash is one chain over a conversation's texts: a task streams them in order.
    """
    plan = scratch(repair_plan(turns, conversations))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", *FIGURES, "audit"]
        head = edits = digest = None
        some = False

        def put(made):
            nonlocal some
            for _, role, text in made:
                digest.update(f"{chr(10) if some else ''}{role}:{text}".encode())
                some = True

        for batch in batches:
            out = []
            rows = batch.to_pydict()
            for at, kind in enumerate(rows["kind"]):
                if kind == 0:
                    if head:
                        put(edits.end())
                        out.append([*head, digest.hexdigest()])
                    head, edits, digest, some = [rows[c][at] for c in names], _Edits(rows["audit"][at]), hashlib.sha256(), False
                else:
                    put(edits.row(rows["role"][at], rows["text"][at]))
            if out:
                yield _batch(out, batch.schema.field("conv_id").type)
            kept = batch.schema.field("conv_id").type
        if head:
            put(edits.end())
            yield _batch([[*head, digest.hexdigest()]], kept)

    kind = turns.schema["conv_id"].dataType.simpleString()
    return _in_order(turns, plan).mapInArrow(digests, f"conv_id {kind}, {', '.join(f'{c} long' for c in FIGURES)}, audit string, repaired_sha256 string")


def _batch(rows: list[list], conv_type: pa.DataType) -> pa.RecordBatch:
    types = [conv_type, *[pa.int64()] * len(FIGURES), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["conv_id", *FIGURES, "audit", "repaired_sha256"])


def repaired_turns(turns: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """(conv_id, place, edit, role, text): the repaired conversations themselves, rows from 1 on; as repair() otherwise."""
    plan = scratch(repair_plan(turns, conversations))

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edits, conv, place = None, None, 0
        for batch in batches:
            out = []
            rows = batch.to_pydict()
            conv_type = batch.schema.field("conv_id").type

            def put(made, out=out):
                nonlocal place
                for edit, role, text in made:
                    place += 1
                    out.append((conv, place, edit, role, text))

            for at, kind in enumerate(rows["kind"]):
                if kind == 0:
                    if edits:
                        put(edits.end())
                    edits, conv, place = _Edits(rows["audit"][at]), rows["conv_id"][at], 0
                else:
                    put(edits.row(rows["role"][at], rows["text"][at]))
            yield _turns(out, conv_type)
        if edits:
            last = []
            for edit, role, text in edits.end():
                place += 1
                last.append((conv, place, edit, role, text))
            yield _turns(last, conv_type)

    kind = turns.schema["conv_id"].dataType.simpleString()
    return _in_order(turns, plan).mapInArrow(rows_of, f"conv_id {kind}, place long, edit string, role string, text string")


def _turns(rows: list[tuple], conv_type: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 5
    types = [conv_type, pa.int64(), pa.string(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["conv_id", "place", "edit", "role", "text"])


def damaged(conversations: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text) with rows dropped, emptied, cut, repeated or given another role by a checksum of
    ``conv_id:turn``; a null is one space."""
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    kind = F.crc32(F.encode(name, "UTF-8")) % 20
    text = F.coalesce("text", F.lit(" "))
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), text.alias("text"), kind.alias("kind")).where("kind <> 0")
    return rows.select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("_"),
    ).drop("_")
