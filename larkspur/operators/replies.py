"""A labeller's replies: run so that a fault costs one request, brought into one form, checked against a schema and against their rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.text import is_blank
from larkspur.operators.labels import unwrap_fence
from larkspur.plans.spill import written
from larkspur.schemas import DIMENSIONS, TOPICS, TYPES

# What is said of a value that breaks a rule, after its place.
WRONG_TYPE, NOT_ALLOWED, TOO_SMALL, TOO_LARGE, TOO_MANY, MISSING, UNDEFINED = "类型错误", "不在允许值中", "小于最小值", "大于最大值", "数量超限", "缺失", "未定义"


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is reckoned once, however often it stands there."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _parsed(text: Column) -> Column:
    """A JSON text as a variant, null if it is none. Spark's parser takes what follows a value for nothing; between the brackets of an
    array and the braces of an object at once only a whole value fits."""
    alone = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), "$", "array<variant>")
    member = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    return F.when((F.size(alone) == 1) & member.isNotNull(), F.get(alone, F.lit(0)))


def _member(v: Column, key: str) -> Column:
    """A member of an object as a variant; null if there is none (a JSON null is a variant). Spark's paths have no escapes."""
    if "'" in key and '"' in key:
        raise ValueError(f"a name with both kinds of quotes: {key}")
    return F.try_variant_get(v, f"$['{key}']" if '"' in key else f'$["{key}"]', "variant")


def _is(kind: Column, v: Column, name: str) -> Column:
    if name in ("array", "object"):
        return F.startswith(kind, F.lit(name.upper()))
    number = kind.isin("BIGINT", "DOUBLE", "FLOAT") | F.startswith(kind, F.lit("DECIMAL"))
    if name == "number":
        return number
    if name == "integer":
        as_double = F.try_variant_get(v, "$", "double")
        return number & (as_double == F.floor(as_double))
    return kind == {"null": "VOID", "string": "STRING", "boolean": "BOOLEAN"}[name]


def _fault(v: Column, schema: dict, path: Column) -> Column:
    return _with(F.struct(v.alias("v"), F.schema_of_variant(v).alias("kind"), path.alias("path")), lambda x: _rules(x["v"], x["kind"], schema, x["path"]))


def _rules(v: Column, kind: Column, schema: dict, path: Column) -> Column:
    """The rules of a schema in the order in which they are checked."""
    says = lambda text: F.concat(path, F.lit(f" {text}"))
    kinds = schema.get("type", [])
    kinds = [kinds] if isinstance(kinds, str) else kinds
    found = []
    if kinds:
        found.append(F.when(~reduce(lambda a, b: a | b, [_is(kind, v, k) for k in kinds]), says(WRONG_TYPE)))
    rules = []
    if "enum" in schema:
        rules.append(F.when(~F.coalesce((kind == "STRING") & F.try_variant_get(v, "$", "string").isin(*schema["enum"]), F.lit(False)), says(NOT_ALLOWED)))
    for rule, text, broken in (("minimum", TOO_SMALL, lambda x, most: x < most), ("maximum", TOO_LARGE, lambda x, most: x > most)):
        if rule in schema:
            rules.append(F.when(_is(kind, v, "number") & broken(F.try_variant_get(v, "$", "double"), schema[rule]), says(text)))
    if "maxItems" in schema or "items" in schema:
        items = []
        if "maxItems" in schema:
            items.append(F.when(F.size(F.try_variant_get(v, "$", "array<variant>")) > schema["maxItems"], says(TOO_MANY)))
        if "items" in schema:
            at = lambda i: F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))
            each = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda e, i: _fault(e, schema["items"], at(i)))
            items.append(F.get(F.array_compact(each), F.lit(0)))
        rules.append(F.when(_is(kind, v, "array"), F.coalesce(*items, F.lit(None).cast("string"))))
    if "properties" in schema:
        parts = []
        for key in schema.get("required", []):
            parts.append(F.when(_member(v, key).isNull(), F.concat(path, F.lit(f".{key} {MISSING}"))))
        if schema.get("additionalProperties") is False:
            known = F.array(*[F.lit(k) for k in schema["properties"]]) if schema["properties"] else F.array().cast("array<string>")
            more = F.get(F.array_sort(F.array_except(F.json_object_keys(F.to_json(v)), known)), F.lit(0))
            parts.append(F.when(more.isNotNull(), F.concat(path, F.lit("."), more, F.lit(f" {UNDEFINED}"))))
        for key, child in schema["properties"].items():
            member = _member(v, key)
            parts.append(F.when(member.isNotNull(), _fault(member, child, F.concat(path, F.lit(f".{key}")))))
        rules.append(F.when(_is(kind, v, "object"), F.coalesce(*parts, F.lit(None).cast("string"))))
    if rules:
        found.append(F.when(kind != "VOID", F.coalesce(*rules, F.lit(None).cast("string"))))
    return F.coalesce(*found, F.lit(None).cast("string"))


def schema_fault(text: Column, schema: dict, path: str = "result") -> Column:
    """The first fault of a JSON text against a schema, with its place (``result.rows[3].kind``), or null.

    A schema is a dict of ``type`` (a name or several: null, string, number, integer, boolean, array, object), ``enum``,
    ``minimum``, ``maximum``, ``maxItems``, ``items``, ``properties``, ``required`` and ``additionalProperties``, nested at will; it
    becomes one expression. Rules are checked in that order and members in that of ``properties``; of members that are not
    defined the first by name is told. A text that is no JSON has the fault INVALID_JSON.
    """
    return _with(_parsed(text), lambda v: F.when(v.isNull(), F.lit("INVALID_JSON")).otherwise(_fault(v, schema, F.lit(path))))


def record(properties: dict, **more) -> dict:
    """A schema of an object that has just these members, all of them."""
    return {"type": "object", "properties": properties, "required": list(properties), "additionalProperties": False, **more}


def _rows_of(name: str, row: dict, most: int) -> dict:
    return record({name: {"type": "array", "items": row, "maxItems": most}})


TEXT = {"type": "string"}
#: What a reply must be, by task.
REPLY_SCHEMAS = {
    "review": _rows_of("labels", record({"rowId": TEXT, "typeId": {"type": "string", "enum": list(TYPES)}, "evidenceSource": {"type": "string", "enum": ["initial", "followup"]}, "evidenceQuote": TEXT}), 50),
    "question": _rows_of("labels", record({"rowId": TEXT, "topicId": {"type": "string", "enum": list(TOPICS)}, "topicEvidence": TEXT}), 50),
    "top20": _rows_of(
        "rows",
        record(
            {
                "rowId": TEXT, "dimensions": record({d: {"type": "boolean"} for d in DIMENSIONS}), "evidence": record({d: TEXT for d in DIMENSIONS}),
                "score": {"type": "integer", "minimum": 0, "maximum": len(DIMENSIONS)}, "note": TEXT,
            }
        ),
        20,
    ),
}
#: Names that a field has in replies, the first that is not null counts.
ALIASES = {"typeId": ("typeId", "category", "tier"), "topicId": ("topicId", "topic")}
#: Fields that a row must have as texts for its array to be the one that is meant, by task.
MARKS = {"review": ("rowId", "typeId", "evidenceSource", "evidenceQuote"), "question": ("rowId", "topicId", "topicEvidence")}
#: Members of a reply that repeat the request.
ECHOES = ("requestId", "productId", "task")


def _field(row: Column, name: str) -> Column:
    """A field by any of its names, JSON null as none."""
    given = [_member(row, n) for n in ALIASES.get(name, (name,))]
    return F.coalesce(*[F.when(~F.is_variant_null(g), g) for g in given])


def _is_text(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v) == "STRING", F.lit(False))


def _is_array(v: Column) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(v), F.lit("ARRAY")), F.lit(False))


def reply_form(text: Column, task: str) -> Column:
    """A reply (JSON) in the form of its task, as JSON; what is no object stays as it is.

    Members that repeat the request go. Without an array ``labels``, the one array under any name all of whose rows have the
    task's fields as texts becomes ``labels``, with fields under their own names; if there are several such arrays, none does. For
    ``top20``, ``results`` becomes ``rows``, with six flags and six quotes as objects and a note that is a text.
    """
    whole = _parsed(text)

    def of_object(v: Column) -> Column:
        members = F.map_filter(F.from_json(F.to_json(v), "map<string,variant>"), lambda k, _: ~k.isin(*ECHOES))
        plain = F.to_json(members)
        if task in MARKS:
            fits = lambda row: reduce(lambda a, b: a & b, [_is_text(_field(row, f)) for f in MARKS[task]])
            rows_of = lambda a: F.try_variant_get(a, "$", "array<variant>")
            good = F.filter(F.map_values(members), lambda a: _is_array(a) & (F.size(rows_of(a)) > 0) & F.coalesce(F.forall(rows_of(a), fits), F.lit(False)))
            made = _with(good, lambda g: F.when(F.size(g) == 1, F.to_json(F.struct(F.transform(rows_of(F.get(g, F.lit(0))), lambda r: F.struct(*[_field(r, f).alias(f) for f in MARKS[task]])).alias("labels")))))
            return F.when(_is_array(_member(v, "labels")), plain).otherwise(F.coalesce(made, plain))
        results = _member(v, "results")

        def row(raw: Column) -> Column:
            flags = F.struct(*[_member(raw, d).alias(d) for d in DIMENSIONS])
            quotes = F.struct(*[_member(raw, f"{d}Evidence").alias(d) for d in DIMENSIONS])
            note = F.when(_is_text(_member(raw, "note")), F.try_variant_get(raw, "$.note", "string")).otherwise("")
            out = F.to_json(F.struct(_member(raw, "rowId").alias("rowId"), flags.alias("dimensions"), quotes.alias("evidence"), _member(raw, "score").alias("score"), note.alias("note")))
            return F.when(F.startswith(F.schema_of_variant(raw), F.lit("OBJECT")), out).otherwise(F.to_json(raw))

        rows = F.concat(F.lit('{"rows":['), F.array_join(F.transform(F.try_variant_get(results, "$", "array<variant>"), row), ","), F.lit("]}"))
        return F.when(~_is_array(_member(v, "rows")) & _is_array(results), rows).otherwise(plain)

    return _with(whole, lambda v: F.when(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), of_object(v)).otherwise(text))


ANSWERS = "request_id string, output string, attempts int, error_code string, error_message string"


def run_labeller(requests: DataFrame, label: Callable[[pd.DataFrame], pd.DataFrame], attempts: int = 2, together: int = 16) -> DataFrame:
    """(request_id, output, attempts, error_code, error_message) of requests (request_id, payload), a row for each.

    ``label`` takes some requests and returns (request_id, output). If it raises, each of them is given to it alone, up to
    ``attempts`` times in all; one that fails to the last is a row with LABELLER_FAILED and what was raised, and costs no other.
    A request without an output has NO_OUTPUT, one with several REPEATED_OUTPUT. Written, so that reading the answers asks nothing
    again; only a task that is lost and run anew does.
    """

    def ask(part: pd.DataFrame, attempt: int) -> list[tuple]:
        got = label(part.reset_index(drop=True))
        outputs = got.groupby("request_id")["output"].apply(list).to_dict()
        out = []
        for request in part["request_id"]:
            own = outputs.get(request, [])
            code = None if len(own) == 1 else "REPEATED_OUTPUT" if own else "NO_OUTPUT"
            out.append((request, own[0] if code is None else None, attempt, code, None))
        return out

    def alone(request: pd.DataFrame) -> list[tuple]:
        attempt = 1
        while True:
            attempt += 1
            try:
                return ask(request, attempt)
            except Exception as e:  # noqa: BLE001  the function is the user's: whatever it raises is its answer
                if attempt >= attempts:
                    return [(request["request_id"].iloc[0], None, attempt, "LABELLER_FAILED", f"{type(e).__name__}: {e}")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for start in range(0, len(part), together):
                some = part.iloc[start : start + together]
                try:
                    out += ask(some, 1)
                except Exception as e:  # noqa: BLE001
                    if attempts > 1:
                        out += [row for i in range(len(some)) for row in alone(some.iloc[i : i + 1])]
                    else:
                        out += [(r, None, 1, "LABELLER_FAILED", f"{type(e).__name__}: {e}") for r in some["request_id"]]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in ANSWERS.split(", ")])

    return written(requests.select("request_id", "payload").mapInPandas(run, ANSWERS))


#: Rows of a reply, by task: their array and its type.
REPLY_ROWS = {
    "review": ("labels", "rowId string, typeId string, evidenceSource string, evidenceQuote string"),
    "question": ("labels", "rowId string, topicId string, topicEvidence string"),
    "top20": ("rows", "rowId string, dimensions map<string,boolean>, evidence map<string,string>, score int, note string"),
}


def _row_fault(task: str) -> Column:
    """What is wrong with a reply's row beside the row (initial_text, followup_text or question_text) that it is about."""
    quoted = lambda text, quote: F.coalesce(~is_blank(quote) & F.contains(text, quote), F.lit(False))
    initial, followup = F.col("initial_text"), F.col("followup_text")
    if task == "review":
        source = F.when(F.col("r.evidenceSource") == "initial", initial).otherwise(followup)
        return F.when(~quoted(source, F.col("r.evidenceQuote")), "QUOTE_NOT_FOUND")
    if task == "question":
        return F.when(~quoted(F.col("question_text"), F.col("r.topicEvidence")), "QUOTE_NOT_FOUND")
    flags, quotes = F.col("r.dimensions"), F.col("r.evidence")
    hits = F.size(F.filter(F.map_values(flags), lambda x: x))
    found = F.forall(F.map_entries(flags), lambda e: ~e["value"] | quoted(initial, quotes[e["key"]]) | quoted(followup, quotes[e["key"]]))
    empty = F.forall(F.map_entries(flags), lambda e: e["value"] | (quotes[e["key"]] == ""))
    return F.when(F.col("r.score") != hits, "SCORE_MISMATCH").when(~found, "QUOTE_NOT_FOUND").when(~empty, "QUOTE_OF_NO_HIT")


def checked_replies(answers: DataFrame, asked: DataFrame, task: str) -> tuple[DataFrame, DataFrame]:
    """(good, dead) of answers of run_labeller() to asked rows (request_id, row_id, and the texts of the task).

    good: (request_id, row_id, and the fields of the task's reply) of replies without any fault. dead: (request_id, code, detail), one
    row per request: what the labeller failed with, INVALID_REPLY with the place of the first fault of form, ROWS_DIFFER if a
    row is missing, unknown or repeated, then the first fault of a row by its place. asked: written; rows meet their replies by
    request and row in one join, which is the only one.
    """
    name, kind = REPLY_ROWS[task]
    form = reply_form(unwrap_fence(F.col("output")), task)
    shaped = answers.withColumn("form", F.when(F.col("error_code").isNull(), form))
    shaped = written(shaped.withColumn("fault", F.when(F.col("error_code").isNull(), schema_fault(F.col("form"), REPLY_SCHEMAS[task]))).drop("output"))
    failed = shaped.where("error_code is not null").select("request_id", F.col("error_code").alias("code"), F.col("error_message").alias("detail"))
    wrong = shaped.where("fault is not null").select("request_id", F.lit("INVALID_REPLY").alias("code"), F.col("fault").alias("detail"))
    fine = shaped.where("error_code is null and fault is null")
    rows = fine.select("request_id", F.posexplode(F.from_json("form", f"{name} array<struct<{kind.replace(' ', ':').replace(',:', ', ')}>>")[name]).alias("position", "r"))
    rows = rows.withColumn("row_id", F.col("r.rowId"))
    wanted = asked.withColumn("row_id", F.col("row_id").cast("string")).withColumn("_asked", F.lit(1))
    wanted = wanted.join(fine.select("request_id").hint("merge"), "request_id", "left_semi")
    pairs = written(wanted.join(rows.hint("merge"), ["request_id", "row_id"], "full_outer").withColumn("row_fault", F.when(F.col("_asked").isNotNull() & F.col("position").isNotNull(), _row_fault(task))))
    per_row = pairs.groupBy("request_id", "row_id").agg(
        (F.count_if(F.col("position").isNull()) + F.count_if(F.col("_asked").isNull()) + F.greatest(F.count(F.lit(1)) - 1, F.lit(0))).alias("odd"),
        F.min(F.when(F.col("row_fault").isNotNull(), F.struct("position", "row_fault"))).alias("first"),
    )
    per_request = per_row.groupBy("request_id").agg(F.sum("odd").alias("odd"), F.min("first").alias("first"))
    faulty = per_request.where("odd > 0 or first is not null").select(
        "request_id", F.when(F.col("odd") > 0, "ROWS_DIFFER").otherwise(F.col("first.row_fault")).alias("code"), F.when(F.col("odd") == 0, F.concat(F.lit(f"{name}["), F.col("first.position").cast("string"), F.lit("]"))).alias("detail")
    )
    faulty = written(faulty)
    fields = [f"r.{x.split()[0]}" for x in kind.split(", ") if not x.startswith("rowId")]
    good = pairs.join(faulty.select("request_id").hint("merge"), "request_id", "left_anti").select("request_id", "row_id", *fields)
    return good, failed.unionByName(wrong).unionByName(faulty)
