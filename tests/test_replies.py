"""Replies of a labeller and the state of requests, against plain Python."""

import copy
import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from larkspur.operators import queue_state as Q
from larkspur.operators import replies as R
from larkspur.schemas import DIMENSIONS


def plain_fault(value, schema, path="result"):
    """A schema's rules, one value at a time."""
    kinds = schema.get("type", [])
    kinds = [kinds] if isinstance(kinds, str) else kinds
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    is_kind = {
        "null": value is None, "array": isinstance(value, list), "object": isinstance(value, dict), "string": isinstance(value, str),
        "boolean": isinstance(value, bool), "number": number, "integer": number and float(value).is_integer(),
    }
    if kinds and not any(is_kind[k] for k in kinds):
        return f"{path} {R.WRONG_TYPE}"
    if value is None:
        return None
    if "enum" in schema and value not in schema["enum"]:
        return f"{path} {R.NOT_ALLOWED}"
    if number and "minimum" in schema and value < schema["minimum"]:
        return f"{path} {R.TOO_SMALL}"
    if number and "maximum" in schema and value > schema["maximum"]:
        return f"{path} {R.TOO_LARGE}"
    if isinstance(value, list):
        if len(value) > schema.get("maxItems", len(value)):
            return f"{path} {R.TOO_MANY}"
        for i, x in enumerate(value):
            fault = plain_fault(x, schema.get("items", {}), f"{path}[{i}]")
            if fault:
                return fault
    if isinstance(value, dict) and "properties" in schema:
        for key in schema.get("required", []):
            if key not in value:
                return f"{path}.{key} {R.MISSING}"
        if schema.get("additionalProperties") is False:
            for key in sorted(value):
                if key not in schema["properties"]:
                    return f"{path}.{key} {R.UNDEFINED}"
        for key, child in schema["properties"].items():
            if key in value:
                fault = plain_fault(value[key], child, f"{path}.{key}")
                if fault:
                    return fault
    return None


SCHEMA = R.record(
    {
        "rows": {"type": "array", "maxItems": 3, "items": R.record({"kind": {"type": "string", "enum": ["a", "b"]}, "n": {"type": ["integer", "null"], "minimum": 0, "maximum": 9}, "deep": {"type": "array", "items": {"type": "array", "items": {"type": "boolean"}}}})},
        "share": {"type": "number", "minimum": -1.5},
        "odd 'key": {"type": ["string", "null"]},
        "any": {},
        "free": {"type": "object", "properties": {"x": {"type": "integer"}}},
    }
)


def good_value(r):
    return {
        "rows": [{"kind": r.choice("ab"), "n": r.choice([None, 0, 9, 4.0]), "deep": [[True], []][: r.randint(0, 2)]} for _ in range(r.randint(0, 3))],
        "share": r.choice([0, -1.5, 2.25, 1e300]), "odd 'key": r.choice([None, "", "é"]), "any": r.choice([None, [], {"z": 1}, "t"]), "free": r.choice([{}, {"x": 3}, {"more": []}]),
    }


def spoiled(value, r):
    """A copy with one change anywhere."""
    value = copy.deepcopy(value)
    places = []

    def walk(x):
        if isinstance(x, dict):
            places.extend((x, k) for k in x)
            [walk(v) for v in x.values()]
        elif isinstance(x, list):
            places.extend((x, i) for i in range(len(x)))
            [walk(v) for v in x]

    walk(value)
    at, key = r.choice(places)
    kind = r.randrange(4)
    if kind == 0:
        del at[key]
    elif kind == 1 and isinstance(at, dict):
        at[r.choice(["more", "a b", "zz"])] = 1
    elif kind == 2 and isinstance(at[key], list):
        at[key] = at[key] * 4 or [1]
    else:
        at[key] = r.choice([None, True, "c", -1, 10, 1.5, [], {}, [None], {"x": "y"}])
    return value


def test_schema_faults_like_value_by_value(spark):
    r = random.Random(6)
    values = [good_value(r) for _ in range(100)]
    values += [spoiled(r.choice(values), r) for _ in range(1500)]
    values += [spoiled(spoiled(v, r), r) for v in values[:200] if v] + [None, 3, "x", [], {}, True]
    rows = [(i, json.dumps(v, ensure_ascii=bool(i % 2))) for i, v in enumerate(values)]
    got = {x.i: x.fault for x in spark.createDataFrame(rows, "i int, t string").select("i", R.schema_fault(F.col("t"), SCHEMA).alias("fault")).collect()}
    assert got == {i: plain_fault(v, SCHEMA) for i, v in enumerate(values)}
    assert len({g.split(" ")[-1] for g in got.values() if g}) == 7


def test_no_json_is_a_fault(spark):
    rows = [(i, t) for i, t in enumerate(["", "{", "[1,]", "nope", '{"rows": []} x', "1],[2", '1,"w":2', "1}{", "1 2"])]
    got = spark.createDataFrame(rows, "i int, t string").select(R.schema_fault(F.col("t"), SCHEMA).alias("fault")).collect()
    assert {x.fault for x in got} == {"INVALID_JSON"}


def formed(spark, task, *values):
    rows = [(i, v if isinstance(v, str) else json.dumps(v)) for i, v in enumerate(values)]
    got = spark.createDataFrame(rows, "i int, t string").select("i", R.reply_form(F.col("t"), task).alias("form")).orderBy("i").collect()
    return [json.loads(x.form) if x.form.startswith(("{", "[", '"')) else x.form for x in got]


REVIEW = {"rowId": "r1", "typeId": "t1", "evidenceSource": "initial", "evidenceQuote": "q"}


def test_forms_of_reviews(spark):
    tiered = {"rowId": "r2", "category": None, "tier": "t2", "evidenceSource": "initial", "evidenceQuote": "", "more": 1}
    got = formed(
        spark, "review",
        {"requestId": "x", "task": "t", "labels": [REVIEW, 1], "note": 2}, {"items": [tiered, REVIEW], "productId": "p"}, {"a": [REVIEW], "b": [REVIEW]}, {"a": [REVIEW, {"rowId": 1}], "labels": {}}, {"a": [], "b": [REVIEW], "labels": None},
        [REVIEW], "no json",
    )
    assert got == [
        {"labels": [REVIEW, 1], "note": 2}, {"labels": [{**REVIEW, "rowId": "r2", "typeId": "t2", "evidenceQuote": ""}, REVIEW]}, {"a": [REVIEW], "b": [REVIEW]}, {"a": [REVIEW, {"rowId": 1}], "labels": {}},
        {"labels": [REVIEW]}, [REVIEW], "no json",
    ]


def test_forms_of_questions_and_dimensions(spark):
    q = {"rowId": "r", "topic": "q1", "topicEvidence": "e"}
    assert formed(spark, "question", {"x": [q]}, {"x": [{**q, "topic": 1}]}) == [{"labels": [{"rowId": "r", "topicId": "q1", "topicEvidence": "e"}]}, {"x": [{**q, "topic": 1}]}]
    flat = {"rowId": "r", "score": 1, **{d: d == "scene" for d in DIMENSIONS}, **{f"{d}Evidence": "" for d in DIMENSIONS}, "note": 3}
    made = {"rowId": "r", "dimensions": {d: d == "scene" for d in DIMENSIONS}, "evidence": dict.fromkeys(DIMENSIONS, ""), "score": 1, "note": ""}
    got = formed(spark, "top20", {"results": [flat, 5]}, {"results": [flat], "rows": []}, {"results": []})
    assert got == [{"rows": [made, 5]}, {"results": [flat], "rows": []}, {"rows": []}]


def requests(spark, n):
    return spark.createDataFrame([(f"q{i}", f"{i}") for i in range(n)], "request_id string, payload string").repartition(2)


def test_a_fault_costs_one_request(spark):
    def label(part: pd.DataFrame) -> pd.DataFrame:
        numbers = part["payload"].astype(int)
        if (numbers % 7 == 3).any():
            raise ValueError("seven")
        out = pd.DataFrame({"request_id": part["request_id"], "output": [f"out {p}" for p in part["payload"]]})
        out = out[numbers % 11 != 5]
        return pd.concat([out, out[numbers % 13 == 1]])

    got = {r.request_id: r for r in R.run_labeller(requests(spark, 60), label, attempts=3).collect()}
    assert len(got) == 60
    for i in range(60):
        r = got[f"q{i}"]
        if i % 7 == 3:
            assert (r.error_code, r.error_message, r.attempts, r.output) == ("LABELLER_FAILED", "ValueError: seven", 3, None)
        elif i % 11 == 5:
            assert r.error_code == "NO_OUTPUT"
        elif i % 13 == 1:
            assert r.error_code == "REPEATED_OUTPUT"
        else:
            assert (r.error_code, r.output) == (None, f"out {i}")


ASKED = "request_id string, row_id long, initial_text string, followup_text string"


def test_replies_are_checked_whole(spark):
    asked = spark.createDataFrame([(q, i, f"text of {i}", "more" if i % 2 else None) for q in "abcdefghi" for i in (1, 2)], ASKED)
    label = lambda i, **k: {"rowId": str(i), "typeId": "t1", "evidenceSource": "initial", "evidenceQuote": f"of {i}"} | k
    outputs = {
        "a": {"labels": [label(1), label(2)]}, "b": {"anything": [label(2), label(1, evidenceSource="followup", evidenceQuote="more")]}, "c": {"labels": [label(1)]}, "d": {"labels": [label(1), label(2), label(2)]},
        "e": {"labels": [label(1), label(3)]}, "f": {"labels": [label(1, typeId="t99"), label(2)]}, "g": {"labels": [label(1), label(2, evidenceQuote=" ")]}, "h": {"labels": [label(1, evidenceSource="followup", evidenceQuote="of 1"), label(2, evidenceSource="followup")]},
    }
    rows = [(q, "```JSON\n" + json.dumps(o) + "\n```", 1, None, None) for q, o in outputs.items()] + [("i", None, 2, "LABELLER_FAILED", "x")]
    good, dead = R.checked_replies(spark.createDataFrame(rows, R.ANSWERS), asked, "review")
    assert {(r.request_id, r.row_id, r.evidenceSource) for r in good.collect()} == {("a", "1", "initial"), ("a", "2", "initial"), ("b", "1", "followup"), ("b", "2", "initial")}
    assert {tuple(r) for r in dead.collect()} == {
        ("c", "ROWS_DIFFER", None), ("d", "ROWS_DIFFER", None), ("e", "ROWS_DIFFER", None), ("f", "INVALID_REPLY", f"result.labels[0].typeId {R.NOT_ALLOWED}"), ("g", "QUOTE_NOT_FOUND", "labels[1]"),
        ("h", "QUOTE_NOT_FOUND", "labels[0]"), ("i", "LABELLER_FAILED", "x"),
    }


@pytest.mark.parametrize("change, code", [({}, None), ({"score": 2}, "SCORE_MISMATCH"), ({"scene": ""}, "QUOTE_NOT_FOUND"), ({"effect": "text"}, "QUOTE_OF_NO_HIT"), ({"scene": "later"}, None)])
def test_dimensions_are_checked(spark, change, code):
    row = {"rowId": "1", "dimensions": {d: d == "scene" for d in DIMENSIONS}, "evidence": {d: "text" if d == "scene" else "" for d in DIMENSIONS}, "score": change.get("score", 1), "note": ""}
    row["evidence"] |= {k: v for k, v in change.items() if k in DIMENSIONS}
    answers = spark.createDataFrame([("a", json.dumps({"rows": [row]}), 1, None, None)], R.ANSWERS)
    good, dead = R.checked_replies(answers, spark.createDataFrame([("a", 1, "a text", "said later")], ASKED), "top20")
    assert [r.code for r in dead.collect()] == ([code] if code else [])
    assert good.count() == (0 if code else 1)


def state(spark, *rows):
    """(request, product, task, status, attempts, error code, task and request of the result)"""
    made = [(1, r, p, t, s, a, (e, "m", False) if e else None, rt, ri, "out" if ri else None) for r, p, t, s, a, e, rt, ri in rows]
    return spark.createDataFrame(made, Q.STATE)


def test_resumed_state(spark):
    earlier = state(
        spark, ("r1", "p", "topic", "failed", 2, "E", None, None), ("r2", "p", "topic", "excluded", 1, "X", "type", "r2"), ("r3", "p", "type", "succeeded", 1, "old", "type", "r3"), ("r4", "p", "topic", "succeeded", 3, None, "topic", "r4"),
        ("r5", "p", "type", "succeeded", 1, None, "type", "other"), ("r6", "p", "type", "running", 1, "E", "type", "r6"), ("r7", "p", "type", "failed", -1, None, "type", "r7"), ("gone", "p", "type", "failed", 1, "E", None, None),
    )
    asked = spark.createDataFrame([(f"r{i}", "now", "type") for i in range(1, 9)], "request_id string, product_id string, task string")
    got = {r.request_id: (r.status, r.attempts, r.error.code if r.error else None, r.result) for r in Q.resume_plan(asked, earlier).collect()}
    assert got == {
        "r1": ("failed", 2, "E", None), "r2": ("excluded", 1, "X", "out"), "r3": ("succeeded", 1, None, "out"), "r4": ("pending", 3, None, None), "r5": ("pending", 1, None, None), "r6": ("pending", 1, None, None),
        "r7": ("failed", 0, None, None), "r8": ("pending", 0, None, None),
    }


def test_commands_and_versions(spark, tmp_path):
    first = state(spark, ("a", "p", "t", "failed", 1, "E", None, None), ("b", "p", "t", "failed", 1, "E", None, None), ("c", "q", "t", "succeeded", 1, None, "t", "c"), ("d", "q", "t", "failed", 2, "E", None, None), ("e", "q", "t", "running", 1, None, None, None))
    path = str(tmp_path / "log")
    Q.append_versions(first, 1, path)
    commands = spark.createDataFrame([("retry", "a"), ("retry", "c"), ("exclude", "q"), ("exclude", "q")], "kind string, target string")
    Q.append_versions(Q.state_transitions(Q.latest(Q.read_log(spark, path)).drop("version"), commands), 2, path)
    Q.append_versions(Q.latest(Q.read_log(spark, path)).drop("version").where("request_id = 'a'").withColumn("status", F.lit("succeeded")), 3, path)
    want = {"a": ("succeeded", None), "b": ("failed", "E"), "c": ("succeeded", None), "d": ("excluded", "E"), "e": ("excluded", None)}
    log = Q.read_log(spark, path)
    assert {r.request_id: (r.status, r.error.code if r.error else None) for r in Q.latest(log).collect()} == want and log.count() == 11
    Q.compact(log, str(tmp_path / "less"))
    less = Q.read_log(spark, str(tmp_path / "less"))
    assert less.count() == 5 and {r.request_id: (r.status, r.error.code if r.error else None) for r in Q.latest(less).collect()} == want
    every = spark.createDataFrame([("retry_failed", None)], "kind string, target string")
    assert {r.request_id: r.status for r in Q.state_transitions(first, every).collect()} == {"a": "pending", "b": "pending", "c": "succeeded", "d": "pending", "e": "running"}


def test_lists_of_ids(spark, monkeypatch):
    monkeypatch.setattr(Q, "IDS", 2)
    rows = state(spark, *[(f"r{i}", "p", "t", "failed" if i % 3 else "pending", 0, None, None, None) for i in range(8)])
    got = {(r.status, r.part): r.request_ids for r in Q.status_lists(rows).collect()}
    assert got == {("failed", 1): ["r1", "r2"], ("failed", 2): ["r4", "r5"], ("failed", 3): ["r7"], ("pending", 1): ["r0", "r3"], ("pending", 2): ["r6"]}
