"""Queries over batches and labels, and over inventories of files."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import functions as F

from larkspur.functions import markdown as M
from larkspur.functions import paths as P
from larkspur.functions import text as T
from larkspur.operators import files as FI
from larkspur.operators import labels as L
from larkspur.operators import queue_state as Q
from larkspur.operators import replies as R
from larkspur.operators import validate_rows as V
from larkspur.plans import bindings as B
from larkspur.plans.registry import query
from larkspur.plans.spill import scratch_path

DR = B.REVIEWS_DOCS
BATCHED = f"""{DR}, batched AS (
  SELECT *, 'type:' || product_id || ':' || sort || ':' || CAST(CAST(floor((k - 1) / 50) AS BIGINT) + 1 AS VARCHAR) AS request_id, CAST((k - 1) % 50 + 1 AS INTEGER) AS place
  FROM (SELECT *, row_number() OVER (PARTITION BY product_id, sort ORDER BY row_id) AS k FROM dr)
), given AS (
  SELECT request_id, place * 3 AS o, row_id, type_id, substr(initial_text, 1, 10) AS quote FROM batched WHERE type_id IS NOT NULL
  UNION ALL SELECT request_id, place * 3 + 1, row_id, 'other', substr(initial_text, 1, 10) FROM batched WHERE type_id IS NOT NULL AND row_id % 23 = 0
  UNION ALL SELECT request_id, place * 3 + 2, row_id + 1000000000, type_id, substr(initial_text, 1, 10) FROM batched WHERE type_id IS NOT NULL AND row_id % 29 = 0
), labels2 AS (SELECT *, CAST(row_number() OVER (PARTITION BY request_id ORDER BY o) - 1 AS INTEGER) AS position FROM given
), ranked AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY request_id, position) AS nth FROM labels2)"""


def batched(s, d):
    return L.batch_rows(B.reviews_docs(s, d), "type")


def results(s, d):
    """JSON results with planted faults: some rows labelled twice, some unknown."""
    b = batched(s, d).where("type_id IS NOT NULL")
    label = lambda o, row, kind: F.struct((F.col("place") * 3 + o).alias("o"), row.alias("rowId"), kind.alias("typeId"), F.lit("initial").alias("evidenceSource"), F.substring("initial_text", 1, 10).alias("evidenceQuote"))
    every = F.array_compact(
        F.array(
            label(0, F.col("row_id"), F.col("type_id")),
            F.when(F.col("row_id") % 23 == 0, label(1, F.col("row_id"), F.lit("other"))),
            F.when(F.col("row_id") % 29 == 0, label(2, F.col("row_id") + 1_000_000_000, F.col("type_id"))),
        )
    )
    g = b.select("request_id", F.explode(every).alias("l")).groupBy("request_id").agg(F.transform(F.array_sort(F.collect_list("l")), lambda x: x.dropFields("o")).alias("labels"))
    return g.select("request_id", F.to_json(F.struct("labels")).alias("output"))


def labels(s, d):
    return L.parse_results(results(s, d))


def sorted_results(s, d):
    """Results of which each third is of another task, and a twin of each with a request that nobody asked for."""
    r = results(s, d).withColumn("n", F.regexp_extract("request_id", "([0-9]+)$", 1).cast("int"))
    r = r.select("request_id", F.when(F.col("n") % 3 == 0, "topic").otherwise("type").alias("task"), "output")
    return L.split_results(r.union(r.select(F.concat("request_id", F.lit(":x")), F.lit("type"), "output")), asked(s, d), "type")


query("batch_rows", f"WITH {BATCHED} SELECT row_id, request_id, place FROM batched")(lambda s, d: batched(s, d).select("row_id", "request_id", "place"))
query("label_request_projection", f"WITH {BATCHED} SELECT request_id, count(*) AS n_rows, sum(row_id) AS id_sum, min(product_id) AS product_id FROM batched GROUP BY request_id")(
    lambda s, d: L.requests(batched(s, d), "initial_text").select(
        "request_id", "n_rows", F.aggregate(F.from_json("payload", "struct<rows:array<struct<rowId:bigint>>>")["rows"], F.lit(0).cast("long"), lambda a, r: a + r["rowId"]).alias("id_sum"),
        F.get(F.split("request_id", ":"), F.lit(1)).alias("product_id"),
    )
)
query("scan_label_results", f"WITH {BATCHED} SELECT request_id, position, row_id, type_id, quote FROM labels2")(labels)
SPLIT = f"{BATCHED}, every AS (SELECT DISTINCT request_id, CAST(regexp_extract(request_id, '([0-9]+)$', 1) AS INTEGER) AS n FROM given)"
query("good_results", f"WITH {SPLIT} SELECT request_id, 'type' AS task FROM every WHERE n % 3 <> 0")(lambda s, d: sorted_results(s, d)[0].select("request_id", "task"))
query("rejected_results", f"WITH {SPLIT} SELECT request_id, 'topic' AS task, 'TASK_MISMATCH' AS code FROM every WHERE n % 3 = 0 UNION ALL SELECT request_id || ':x', 'type', 'REQUEST_MISMATCH' FROM every")(lambda s, d: sorted_results(s, d)[1])
query("scan_json_props", "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events")(lambda s, d: B.table(s, d, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k")))
query("first_label", f"WITH {BATCHED} SELECT request_id, position, row_id, type_id, quote FROM ranked WHERE nth = 1")(lambda s, d: L.first_label(labels(s, d)))
query("order_results", f"WITH {BATCHED} SELECT request_id, count(*) AS n FROM labels2 GROUP BY 1 ORDER BY 1")(lambda s, d: L.results_in_order(labels(s, d)))
query("attach_labels", f"WITH {BATCHED} SELECT dr.row_id, r.type_id, quote FROM dr LEFT JOIN ranked r ON dr.row_id = r.row_id AND nth = 1")(
    lambda s, d: L.attach_labels(B.reviews_docs(s, d).select("row_id"), labels(s, d))
)
query("unknown_label_rows", f"WITH {BATCHED} SELECT request_id, position, row_id, CASE WHEN row_id NOT IN (SELECT row_id FROM dr) THEN 'UNKNOWN_ROW' ELSE 'LABELLED_BEFORE' END AS why FROM ranked WHERE nth > 1 OR row_id NOT IN (SELECT row_id FROM dr)")(
    lambda s, d: L.rejected_labels(B.reviews_docs(s, d), labels(s, d))
)
query("results_for_products", f"WITH {BATCHED} SELECT DISTINCT request_id FROM labels2 WHERE starts_with(request_id, 'type:en:') OR starts_with(request_id, 'type:de:')")(
    lambda s, d: L.results_for_products(results(s, d), s.createDataFrame([("en",), ("de",)], "product_id string")).select("request_id")
)
query("drop_excluded_products", f"WITH {DR} SELECT row_id FROM dr WHERE product_id NOT IN ('fr', 'es')")(
    lambda s, d: V.without_products(B.reviews_docs(s, d), s.createDataFrame([("fr",), ("es",)], "product_id string")).select("row_id")
)
query("label_domain_check", f"WITH {BATCHED} SELECT request_id, position, type_id FROM labels2 WHERE type_id NOT IN ('q0t0', 'q0t1', 'q1t0', 'q1t1')")(
    lambda s, d: L.out_of_domain(labels(s, d), s.createDataFrame([(t,) for t in ("q0t0", "q0t1", "q1t0", "q1t1")], "type_id string"))
)
query("request_coverage", f"WITH {BATCHED}, got AS (SELECT request_id, row_id, count(*) AS times FROM labels2 GROUP BY ALL) SELECT coalesce(b.request_id, g.request_id) AS request_id, count(*) FILTER (times IS NULL) AS missing, count(*) FILTER (b.row_id IS NULL) AS foreign, count(*) FILTER (times > 1) AS repeated FROM batched b FULL JOIN got g ON b.request_id = g.request_id AND b.row_id = g.row_id GROUP BY 1")(
    lambda s, d: L.request_coverage(batched(s, d), labels(s, d))
)
query("quote_contained", f"WITH {BATCHED} SELECT r.row_id, trim(r.quote) <> '' AND contains(dr.initial_text, r.quote) AS ok FROM ranked r JOIN dr USING (row_id) WHERE nth = 1")(
    lambda s, d: L.quote_check(L.first_label(labels(s, d)).join(B.reviews_docs(s, d).select("row_id", F.col("initial_text").alias("text")).hint("merge"), "row_id"))
)
LIMITED = f"""{BATCHED}, limited AS (SELECT request_id, CASE WHEN row_id % 97 = 0 THEN repeat('x', 257) ELSE '' END || CASE WHEN row_id % 31 = 0 THEN 'same' ELSE CAST(row_id AS VARCHAR) END AS row_id, CASE WHEN row_id % 5 = 0 THEN ' ' ELSE initial_text END AS a,
  CASE WHEN row_id % 41 = 0 THEN ' data:image/png;base64,' WHEN row_id % 10 <> 0 THEN 'again' END AS b FROM batched)"""
BLANK = "NOT regexp_matches(coalesce({}, ''), '[^\\s]')".format
UNITS = "length({0}) + len(regexp_extract_all({0}, '[\\x{{10000}}-\\x{{10FFFF}}]'))".format
query("input_limits", f"""WITH {LIMITED}, m AS (SELECT request_id, count(*) - count(DISTINCT row_id) AS again, max({UNITS('a')}) AS longest, count(*) FILTER ({BLANK('a')} AND {BLANK('b')}) AS empty, count(*) FILTER (length(row_id) > 256) AS ids, count(*) FILTER (b LIKE '%data:%' OR ltrim(a) LIKE 'data:image/%') AS pictures FROM limited GROUP BY 1)
  SELECT request_id, 'TEXT_TOO_LONG' AS code FROM m WHERE longest > 20000 UNION ALL SELECT request_id, 'EMPTY_TEXT' FROM m WHERE empty > 0 UNION ALL SELECT request_id, 'INVALID_ID' FROM m WHERE ids > 0 UNION ALL SELECT request_id, 'REPEATED_ID' FROM m WHERE again > 0 UNION ALL SELECT request_id, 'IMAGE_DATA' FROM m WHERE pictures > 0""")(
    lambda s, d: L.input_limits(limited(s, d), ["a", "b"])
)


def limited(s, d):
    """Batches of which some rows have a long or a repeated id, no text at all, or a picture in the place of a text."""
    k = F.col("row_id")
    row_id = F.concat(F.when(k % 97 == 0, "x" * 257).otherwise(""), F.when(k % 31 == 0, "same").otherwise(k.cast("string")))
    return batched(s, d).select("request_id", row_id.alias("row_id"), F.when(k % 5 == 0, " ").otherwise(F.col("initial_text")).alias("a"), F.when(k % 41 == 0, " data:image/png;base64,").when(k % 10 != 0, "again").alias("b"))


SMALL_BATCH = 5
BY_FIVE = f"""{DR}, by_five AS (
  SELECT *, 'type:' || product_id || ':' || sort || ':' || CAST(CAST(floor((k - 1) / {SMALL_BATCH}) AS BIGINT) + 1 AS VARCHAR) AS request_id, CAST((k - 1) % {SMALL_BATCH} + 1 AS INTEGER) AS place, CAST(floor((k - 1) / {SMALL_BATCH}) AS BIGINT) + 1 AS n
  FROM (SELECT *, row_number() OVER (PARTITION BY product_id, sort ORDER BY row_id) AS k FROM dr)
)"""


def by_five(s, d):
    return L.batch_rows(B.reviews_docs(s, d), "type", SMALL_BATCH)


def number():
    """The number of a request in its list."""
    return F.regexp_extract("request_id", "([0-9]+)$", 1).cast("int")


STATE = f"""{BY_FIVE}, asked2 AS (SELECT DISTINCT request_id, 'type' AS task, product_id, n FROM by_five
), earlier AS (SELECT request_id, CASE n % 4 WHEN 0 THEN 'succeeded' WHEN 1 THEN 'failed' WHEN 2 THEN 'running' ELSE 'excluded' END AS estatus, n % 5 <> 0 AND n % 6 <> 0 AS fits, CASE WHEN n % 9 = 0 THEN -1 ELSE n % 3 END AS tries FROM asked2 WHERE n % 7 <> 0
), state AS (SELECT a.request_id, a.task, a.product_id, CASE WHEN estatus IN ('failed', 'excluded') THEN estatus WHEN estatus = 'succeeded' AND fits THEN 'succeeded' ELSE 'pending' END AS status,
  CAST(CASE WHEN tries >= 0 THEN tries ELSE 0 END AS INTEGER) AS attempts, CASE WHEN estatus IN ('failed', 'excluded') THEN 'E' || n END AS error_code, CASE WHEN fits AND estatus IN ('succeeded', 'excluded') THEN 'result ' || n END AS result
  FROM asked2 a LEFT JOIN earlier USING (request_id))"""


def asked(s, d):
    return batched(s, d).select("request_id", F.lit("type").alias("task"), "product_id").distinct()


def state(s, d):
    """State resumed from a log of two versions: all running, then what became of them; a fifth of the results is of another
    task, a sixth of another request."""
    want = by_five(s, d).select("request_id", F.lit("type").alias("task"), "product_id").distinct()
    n = F.col("n")
    e = want.withColumn("n", number()).where("n % 7 <> 0")
    first = e.select(
        "request_id", "product_id", "task", F.lit("running").alias("status"), F.lit(1).alias("attempts"), F.lit(None).cast("struct<code:string,message:string,retryable:boolean>").alias("error"),
        *[F.lit(None).cast("string").alias(c) for c in ("result_task", "result_id", "result")],
    )
    then = e.select(
        "request_id", "product_id", "task", F.when(n % 4 == 0, "succeeded").when(n % 4 == 1, "failed").when(n % 4 == 2, "running").otherwise("excluded").alias("status"),
        F.when(n % 9 == 0, -1).otherwise(n % 3).cast("int").alias("attempts"), F.struct(F.concat(F.lit("E"), n).alias("code"), F.lit("m").alias("message"), F.lit(True).alias("retryable")).alias("error"),
        F.when(n % 5 == 0, "topic").otherwise("type").alias("result_task"), F.when(n % 6 == 0, "x").otherwise(F.col("request_id")).alias("result_id"), F.concat(F.lit("result "), n).alias("result"),
    )
    log = scratch_path(s)
    Q.append_versions(first, 1, log)
    Q.append_versions(then, 2, log)
    return Q.resume_plan(want, Q.latest(Q.read_log(s, log)))


query("resume_plan", f"WITH {STATE} SELECT request_id, task, status, attempts, error_code, result FROM state")(lambda s, d: state(s, d).select("request_id", "task", "status", "attempts", F.col("error.code").alias("error_code"), "result"))
query("task_status_counts", f"WITH {STATE} SELECT status, count(*) AS n FROM state GROUP BY 1")(lambda s, d: Q.task_status_counts(state(s, d)))
query("task_status_ids", f"WITH {STATE} SELECT status, CAST((k - 1) // 1000 + 1 AS BIGINT) AS part, list(request_id ORDER BY k) AS request_ids FROM (SELECT *, row_number() OVER (PARTITION BY status ORDER BY request_id) AS k FROM state) GROUP BY ALL")(
    lambda s, d: Q.status_lists(state(s, d))
)


@query("state_transitions", f"WITH {STATE} SELECT request_id, CASE WHEN status = 'succeeded' THEN status WHEN product_id = 'es' THEN 'excluded' WHEN status = 'failed' THEN 'pending' ELSE status END AS status, CASE WHEN status = 'failed' AND product_id <> 'es' THEN NULL ELSE error_code END AS error_code, attempts FROM state")
def _(s, d):
    commands = s.createDataFrame([("exclude", "es"), ("retry_failed", None)], "kind string, target string")
    return Q.state_transitions(state(s, d), commands).select("request_id", "status", F.col("error.code").alias("error_code"), "attempts")


query("top20_if_full", f"WITH {B.REVIEWS_ORDERS} SELECT row_id, product_id, rank FROM reviews WHERE sort = 'default' AND rank <= 20 AND product_id IN (SELECT product_id FROM reviews WHERE sort = 'default' GROUP BY 1 HAVING count(*) >= 20)")(
    lambda s, d: L.top_if_full(B.reviews_orders(s, d), 20).select("row_id", "product_id", "rank")
)
query("order_top20", f"WITH {B.REVIEWS_ORDERS}, {B.ASSESSMENTS_ORDERS} SELECT product_id, CAST(rank AS INTEGER) AS rank, review_id, CAST(count(*) FILTER (present) AS INTEGER) AS score FROM assessed GROUP BY ALL ORDER BY product_id, rank, review_id")(
    lambda s, d: L.assessments_in_order(B.assessments_orders(s, d)).select("product_id", "rank", "review_id", "score")
)


@query("score_consistent", f"WITH {B.REVIEWS_ORDERS}, {B.ASSESSMENTS_ORDERS} SELECT review_id, rank % 7 <> 0 AS ok FROM flags")
def _(s, d):
    a = B.assessments_orders(s, d)
    flags = F.map_from_entries(F.transform("dimensions", lambda x: F.struct(x["dimension"], x["present"])))
    quotes = F.map_from_entries(F.transform("dimensions", lambda x: F.struct(x["dimension"], x["evidence"])))
    text = F.array_join(F.transform("dimensions", lambda x: x["evidence"]), " ")
    score = F.col("score") + F.when(F.col("rank") % 7 == 0, 1).otherwise(0)
    return a.select("review_id", L.score_consistent(flags, quotes, score, text).alias("ok"))


def label(part: pd.DataFrame) -> pd.DataFrame:
    """A labeller with every fault: by a request's number it raises, is no JSON, leaves a row out, quotes what is not there, or says it
    all under another name in a fence."""
    out = []
    for request, payload in zip(part["request_id"], part["payload"], strict=True):
        n, rows = int(request.rsplit(":", 1)[1]) % 7, json.loads(payload)["rows"]
        if n == 3:
            raise ValueError("no answer")
        said = [{"rowId": str(r["rowId"]), "typeId" if n != 2 else "tier": f"t{1 + r['rowId'] % 8}", "evidenceSource": "initial", "evidenceQuote": r.get("initial_text", "")[:10]} for r in rows]
        if n == 6:
            said[0]["evidenceQuote"] = "\u0001 not there"
        text = json.dumps({"items" if n == 2 else "labels": said[1:] if n == 5 else said})
        out.append((request, "not json" if n == 4 else f"```JSON\n{text}\n```" if n == 2 else text))
    return pd.DataFrame(out, columns=["request_id", "output"])


def answered(s, d):
    return R.run_labeller(L.requests(by_five(s, d), "initial_text"), label)


def checked(s, d):
    asked_rows = by_five(s, d).select("request_id", "row_id", "initial_text", F.lit(None).cast("string").alias("followup_text"))
    return R.checked_replies(answered(s, d), asked_rows, "review")


JUDGED = f"""{BY_FIVE}, blanks AS (SELECT request_id, min(place) FILTER (NOT regexp_matches(substr(initial_text, 1, 10), '[^\\s]') OR (n % 7 = 6 AND place = 1)) AS first FROM by_five WHERE n % 7 NOT IN (3, 4, 5) GROUP BY 1
), dead AS (
  SELECT DISTINCT request_id, CASE n % 7 WHEN 3 THEN 'LABELLER_FAILED' WHEN 4 THEN 'INVALID_REPLY' ELSE 'ROWS_DIFFER' END AS code, CASE n % 7 WHEN 3 THEN 'ValueError: no answer' WHEN 4 THEN 'INVALID_JSON' END AS detail FROM by_five WHERE n % 7 IN (3, 4, 5)
  UNION ALL SELECT request_id, 'QUOTE_NOT_FOUND', 'labels[' || (first - 1) || ']' FROM blanks WHERE first IS NOT NULL
)"""
query("apply_labeller", f"WITH {BY_FIVE} SELECT request_id, CAST(CASE WHEN n % 7 = 3 THEN 2 ELSE 1 END AS INTEGER) AS attempts, CASE WHEN n % 7 = 3 THEN 'LABELLER_FAILED' END AS error_code, CASE WHEN n % 7 NOT IN (2, 3, 4) THEN count(*) - CASE WHEN n % 7 = 5 THEN 1 ELSE 0 END END AS units FROM by_five GROUP BY request_id, n")(
    lambda s, d: answered(s, d).select(
        "request_id", F.when(F.col("error_code").isNotNull(), F.col("attempts")).otherwise(1).alias("attempts"), "error_code",
        F.size(F.from_json("output", "labels array<struct<rowId:string>>")["labels"]).cast("long").alias("units"),
    )
)
query("checked_labels", f"WITH {JUDGED} SELECT request_id, CAST(row_id AS VARCHAR) AS row_id, 't' || (1 + row_id % 8) AS type_id, substr(initial_text, 1, 10) AS quote FROM by_five WHERE request_id NOT IN (SELECT request_id FROM dead)")(
    lambda s, d: checked(s, d)[0].select("request_id", "row_id", F.col("typeId").alias("type_id"), F.col("evidenceQuote").alias("quote"))
)
query("dead_letters", f"WITH {JUDGED} SELECT request_id, code, detail FROM dead")(lambda s, d: checked(s, d)[1])


@query("reply_form", """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '{"labels":[{"rowId":"r' || doc_id || '","typeId":"t1","evidenceSource":"initial","evidenceQuote":"' || md5(text) || '"}]}' WHEN 1 THEN '{"a":[{"evidenceQuote":"","evidenceSource":"initial","rowId":"x","typeId":"t1"}],"b":[{"evidenceQuote":"","evidenceSource":"initial","rowId":"x","typeId":"t1"}]}'
  WHEN 2 THEN '{"labels":[],"note":"' || md5(text) || '"}' ELSE '[' || doc_id || ']' END AS form FROM documents""")
def _(s, d):
    """Replies with their rows under an unknown name, in two arrays of which neither is meant, in their own form, and no object at all."""
    row = lambda k, q: F.concat(F.lit('[{"rowId":"'), k, F.lit('","category":null,"tier":"t1","evidenceSource":"initial","evidenceQuote":"'), q, F.lit('"}]'))
    k, m = F.col("doc_id").cast("string"), F.md5("text")
    plain = F.lit('[{"evidenceQuote":"","evidenceSource":"initial","rowId":"x","typeId":"t1"}]')
    text = (
        F.when(k.cast("long") % 4 == 0, F.concat(F.lit('{"requestId":"q","things":'), row(F.concat(F.lit("r"), k), m), F.lit(',"more":[]}')))
        .when(k.cast("long") % 4 == 1, F.concat(F.lit('{"a":'), plain, F.lit(',"b":'), plain, F.lit("}")))
        .when(k.cast("long") % 4 == 2, F.concat(F.lit('{"task":"t","labels":[],"note":"'), m, F.lit('"}')))
        .otherwise(F.concat(F.lit("["), k, F.lit("]")))
    )
    return B.table(s, d, "documents").select("doc_id", R.reply_form(text, "review").alias("form"))


@query("json_schema_fault", f"""SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN 'INVALID_JSON' WHEN 1 THEN 'result.labels {R.MISSING}' WHEN 2 THEN 'result.more {R.UNDEFINED}' WHEN 3 THEN 'result.labels[1].typeId {R.NOT_ALLOWED}' WHEN 4 THEN 'result.labels[' || CASE WHEN n_chars % 2 = 0 THEN 0 ELSE 1 END || '].evidenceQuote {R.WRONG_TYPE}'
  WHEN 5 THEN 'result.labels {R.TOO_MANY}' WHEN 6 THEN 'result.labels[1].rowId {R.MISSING}' WHEN 7 THEN 'result.labels {R.WRONG_TYPE}' END AS fault FROM documents""")
def _(s, d):
    """A reply per document, of the fault that its id says, with the document's text as a quote."""
    m, at = F.col("doc_id") % 9, F.col("n_chars") % 2
    quote = F.get_json_object(F.to_json(F.struct(F.array(F.substring("text", 1, 50)).alias("q"))), "$.q")
    quote = F.regexp_extract(quote, r"(?s)^\[(.*)\]$", 1)

    def row(i: int):
        fields = [
            F.when(~((m == 6) & F.lit(i == 1)), F.concat(F.lit('"rowId":"'), F.col("doc_id").cast("string"), F.lit('"'))), F.when((m == 3) & F.lit(i == 1), '"typeId":"t9"').otherwise('"typeId":"t8"'), F.lit('"evidenceSource":"followup"'),
            F.concat(F.lit('"evidenceQuote":'), F.when((m == 4) & (at == i), "null").otherwise(quote)),
        ]
        return F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*fields)), ","), F.lit("}"))

    rows = F.when(m == 5, F.array_repeat(row(0), 51)).otherwise(F.array(row(0), row(1)))
    labels = F.when(m == 7, '{"0":1}').otherwise(F.concat(F.lit("["), F.array_join(rows, ","), F.lit("]")))
    members = F.array_compact(F.array(F.when(m != 1, F.concat(F.lit('"labels":'), labels)), F.when(m == 2, '"more":1')))
    text = F.concat(F.lit("{"), F.array_join(members, ","), F.when(m == 0, ",}").otherwise("}"))
    return B.table(s, d, "documents").select("doc_id", R.schema_fault(text, R.REPLY_SCHEMAS["review"]).alias("fault"))


query("unwrap_fence", "SELECT event_id, CASE WHEN event_id % 5 = 4 THEN '' ELSE props END AS inner_text FROM events")(
    lambda s, d: B.table(s, d, "events").select("event_id", L.unwrap_fence(fenced(F.col("event_id") % 5, F.col("props"))).alias("inner_text"))
)


def fenced(kind, text):
    """A text in fences of several forms, plain with blanks around it, and a fence with nothing inside."""
    return (
        F.when(kind == 0, F.concat(F.lit("```json\n"), text, F.lit("\n```"))).when(kind == 1, F.concat(F.lit(" ```JSON  "), text, F.lit("```\n"))).when(kind == 2, F.concat(F.lit("```"), text, F.lit(" ```")))
        .when(kind == 3, F.concat(F.lit("\n\t"), text, F.lit("　"))).otherwise("```json\n```")
    )


SHAPE = {"rowId": ("int", 0, 10**9), "kind": ("enum", ["q0", "q1"]), "note": ("text?", 20), "ok": ("bool",), "score": ("number?", 0, 1), "dims": ("list", {"name": ("enum", ["persona", "scene"]), "hit": ("bool",)})}


@query("strict_json", """SELECT doc_id, CASE doc_id % 10 WHEN 0 THEN 'NOT_AN_OBJECT' WHEN 1 THEN 'MISSING_KEY' WHEN 2 THEN 'FURTHER_KEY' WHEN 3 THEN 'WRONG_ENUM kind' WHEN 4 THEN 'WRONG_BOOL ok' WHEN 5 THEN 'WRONG_NUMBER score' WHEN 6 THEN 'dims: WRONG_ENUM name'
  WHEN 7 THEN 'dims: MISSING_KEY' WHEN 8 THEN 'WRONG_LIST dims' END AS error FROM documents""")
def _(s, d):
    """A JSON text per document, of the fault that its id says, or none."""
    m, k = F.col("doc_id") % 10, F.col("doc_id")
    dims = F.when(m == 6, '[{"name":"scene","hit":true},{"name":"other","hit":true}]').when(m == 7, '[{"name":"scene"}]').when(m == 8, '{"name":"scene","hit":true}').when(k % 3 == 0, "[]").otherwise('[{"name":"persona","hit":false}]')
    parts = [
        F.concat(F.lit('"rowId":'), k.cast("string")), F.when(m != 1, F.concat(F.lit('"kind":"'), F.when(m == 3, "q2").otherwise("q1"), F.lit('"'))), F.concat(F.lit('"note":'), F.when(k % 4 == 0, "null").otherwise('"' + "x" * 20 + '"')),
        F.concat(F.lit('"ok":'), F.when(m == 4, '"true"').otherwise("true")), F.concat(F.lit('"score":'), F.when(m == 5, "1.5").when(k % 4 == 1, "null").otherwise("0.5")), F.concat(F.lit('"dims":'), dims), F.when(m == 2, '"more":1'),
    ]
    text = F.when(m == 0, "[1, 2]").otherwise(F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*parts)), ","), F.lit("}")))
    return B.table(s, d, "documents").select("doc_id", L.strict_json_error(text, SHAPE).alias("error"))


@query("dimension_flags", "SELECT doc_id, quality = 1 AS persona, doc_id % 2 = 0 AND toxic = 1 AS scene, false AS effect FROM labels")
def _(s, d):
    """Flags beside the other fields for odd documents, in an object of their own for even ones; one is never given."""
    given = F.concat(F.lit('"persona":'), (F.col("quality") == 1).cast("string"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(',"scene":'), F.col("toxic").cast("string"))).otherwise(""))
    text = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit('{"dimensions":{'), given, F.lit("}}"))).otherwise(F.concat(F.lit('{"typeId":"t1",'), given, F.lit("}")))
    flags = L.dimension_flags(text, ("persona", "scene", "effect"))
    return B.table(s, d, "labels").select("doc_id", *[flags[k].alias(k) for k in ("persona", "scene", "effect")])


@query("coalesce_label_shape", "SELECT doc_id, 't' || quality AS type_id, CASE WHEN doc_id % 2 = 0 THEN 'q' || toxic END AS topic_id FROM labels")
def _(s, d):
    name = F.when(F.col("doc_id") % 3 == 0, "typeId").when(F.col("doc_id") % 3 == 1, "category").otherwise("tier")
    topic = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(', "'), F.when(F.col("doc_id") % 4 == 0, "topicId").otherwise("topic"), F.lit('": "q'), "toxic", F.lit('"'))).otherwise("")
    text = F.concat(F.lit('{"'), name, F.lit('": "t'), "quality", F.lit('"'), topic, F.lit("}"))
    kind, about = L.label_shape(text)
    return B.table(s, d, "labels").select("doc_id", kind.alias("type_id"), about.alias("topic_id"))


# Files.

FP = B.FILES_PAGES
GROUPED = f"{FP}, grouped AS (SELECT id, path, size, CASE WHEN id % 10 = 0 THEN 'manual' ELSE detected END AS group_name FROM files)"


def grouped(s, d):
    f = B.files_pages(s, d)
    return FI.apply_overrides(f, f.where("id % 10 = 0").select("id", F.lit(" manual ").alias("assigned")))


query("normalize_path", f"WITH {FP} SELECT id, regexp_replace(path, '^/+|/+$', '', 'g') AS path FROM files")(lambda s, d: B.files_pages(s, d).select("id", P.normalize_path(F.concat(F.lit("/"), F.regexp_replace("path", "/", r"\\"), F.lit("/"))).alias("path")))
query("safe_archive_path", f"WITH {FP} SELECT id, CASE WHEN id % 7 NOT IN (0, 1) THEN rtrim(path, '/') END AS path FROM files")(
    lambda s, d: B.files_pages(s, d).select("id", P.safe_archive_path(F.when(F.col("id") % 7 == 1, ".//./").otherwise(F.concat(F.lit("./"), F.when(F.col("id") % 7 == 0, "../").otherwise("/"), "path"))).alias("path"))
)
query("file_extension", f"WITH {FP} SELECT id, lower(string_split(path, '.')[-1]) AS extension FROM files")(lambda s, d: B.files_pages(s, d).select("id", T.file_extension(F.col("path")).alias("extension")))
query("apply_overrides", f"WITH {GROUPED} SELECT id, group_name FROM grouped")(lambda s, d: grouped(s, d).select("id", "group_name"))
query("drop_system_paths", f"WITH {FP} SELECT id FROM files WHERE id % 4 = 0 AND path NOT LIKE '%/'")(
    lambda s, d: B.files_pages(s, d).withColumn("p", F.when(F.col("id") % 4 == 1, F.concat("path", F.lit("/"))).when(F.col("id") % 4 == 2, F.concat(F.lit("__MACOSX/"), "path")).when(F.col("id") % 4 == 3, F.concat("path", F.lit("/.DS_Store"))).otherwise(F.col("path"))).where(~P.is_system_path(F.col("p"))).select("id")
)
def uploaded(s, d):
    """Files of which one in three has a name for a temporary file and one in three another such name."""
    stem = F.when(F.col("id") % 3 == 0, ".~").when(F.col("id") % 3 == 1, "~$").otherwise("a")
    return FI.drop_temporary(B.files_pages(s, d).select("id", F.concat(F.lit("up/load/"), stem, F.regexp_replace("path", "/", "_")).alias("path")))


query("drop_temp_files", f"WITH {FP} SELECT id FROM files WHERE id % 3 = 2")(lambda s, d: uploaded(s, d)[0].select("id"))
query("temp_file_warnings", f"WITH {FP} SELECT id, 'TEMPORARY_FILE_IGNORED' AS code, 'up/load/' || CASE id % 3 WHEN 0 THEN '.~' ELSE '~$' END || replace(path, '/', '_') AS detail FROM files WHERE id % 3 <> 2")(lambda s, d: uploaded(s, d)[1])
query("file_type_counts", f"WITH {GROUPED}, e AS (SELECT group_name, lower(string_split(path || CASE id % 4 WHEN 0 THEN '.PNG' WHEN 1 THEN '.md' WHEN 2 THEN '.csv' ELSE '.bin' END, '.')[-1]) AS x FROM grouped) SELECT group_name, count(*) FILTER (x = 'png') AS image_count, count(*) FILTER (x = 'md') AS document_count, count(*) FILTER (x = 'csv') AS spreadsheet_count, count(*) FILTER (x = 'bin') AS other_count FROM e GROUP BY 1")(
    lambda s, d: FI.file_type_counts(grouped(s, d).withColumn("path", F.concat("path", F.element_at(F.array(*map(F.lit, (".PNG", ".md", ".csv", ".bin"))), (F.col("id") % 4 + 1).cast("int")))))
)
query("size_budgets", f"WITH {GROUPED} SELECT group_name, count(*) AS files, CAST(sum(size) AS BIGINT) AS total_bytes, max(size) AS largest, count(*) > 10 OR max(size) > 20000 OR sum(size) > 60000 AS over FROM grouped GROUP BY 1")(lambda s, d: FI.size_budgets(grouped(s, d), 10, 20_000, 60_000))
query("group_recognition", f"WITH {GROUPED} SELECT group_name, CAST(row_number() OVER (ORDER BY min(id)) AS INTEGER) AS position, count(*) AS files FROM grouped GROUP BY 1")(lambda s, d: FI.group_recognition(grouped(s, d)))
query("manifest_caps", f"WITH {GROUPED} SELECT id, group_name FROM grouped WHERE group_name IN (SELECT group_name FROM grouped GROUP BY 1 ORDER BY min(id) LIMIT 20) QUALIFY row_number() OVER (PARTITION BY group_name ORDER BY id) <= 3")(
    lambda s, d: FI.manifest_caps(grouped(s, d), 20, 3).select("id", "group_name")
)
query("group_manifest", f"""WITH {GROUPED}, kept AS (SELECT * REPLACE (CASE WHEN id % 6 <> 0 THEN group_name END AS group_name) FROM grouped) SELECT group_name, CAST((n - 1) // 1000 + 1 AS BIGINT) AS part, '{{"name":"' || group_name || '","files":["' || string_agg(path, '","' ORDER BY id, path) || '"]}}' AS manifest FROM (SELECT *, row_number() OVER (PARTITION BY group_name ORDER BY id) AS n FROM kept WHERE group_name IS NOT NULL) GROUP BY 1, 2
  UNION ALL SELECT NULL, CAST((n - 1) // 1000 + 1 AS BIGINT), '{{"unclassified":["' || string_agg(path, '","' ORDER BY id, path) || '"]}}' FROM (SELECT *, row_number() OVER (ORDER BY id) AS n FROM kept WHERE group_name IS NULL) GROUP BY 2""")(
    lambda s, d: FI.group_manifest(grouped(s, d).withColumn("group_name", F.when(F.col("id") % 6 != 0, F.col("group_name"))))
)
MODULE = "CASE id % 6 WHEN 0 THEN '/market/' WHEN 1 THEN '/competitor/' WHEN 2 THEN '/buyer/' WHEN 3 THEN '/detail/' WHEN 4 THEN '/review/' ELSE '/x/' END"


def with_module(s, d):
    part = F.element_at(F.array(*[F.lit(f"/{m}/") for m in (*P.MODULES, "x")]), (F.col("id") % 6 + 1).cast("int"))
    return B.files_pages(s, d).withColumn("path", F.concat(part, "path"))


query("classify_path", f"WITH {FP} SELECT id, CASE id % 6 WHEN 5 THEN NULL ELSE trim({MODULE}, '/') END AS module FROM files")(lambda s, d: with_module(s, d).select("id", P.classify_path(F.col("path")).alias("module")))
query("module_counts", f"WITH {FP} SELECT m AS module, count(id) AS files FROM (VALUES ('market', 0), ('competitor', 1), ('buyer', 2), ('detail', 3), ('review', 4), ('unclassified', 5)) v(m, k) LEFT JOIN files ON id % 6 = k GROUP BY 1")(
    lambda s, d: FI.module_counts(with_module(s, d), P.classify_path(F.col("path")), P.MODULES)
)
query("infer_group", f"WITH {FP} SELECT id, CASE WHEN length(detected) > 40 THEN substr(detected, 1, 40) ELSE detected END AS group_name FROM files")(
    lambda s, d: B.files_pages(s, d).select("id", P.infer_group(P.normalize_path(F.concat(F.lit("uploads/"), "path"))).alias("group_name"))
)
def inventory(s, d):
    """Pages as uploads: each fifth is an archive with the pages whose ids stand a thousand apart as members; others of two types."""
    f = B.files_pages(s, d).withColumn("path", F.regexp_replace("path", "/", "_"))
    kind = F.when(F.col("id") % 5 == 0, ".zip").when(F.col("id") % 3 == 0, ".exe").otherwise(".PDF")
    files = f.select("id", F.concat("path", kind).alias("path"), "size")
    inside = f.where("id % 5 = 0").select(F.col("id").alias("archive_id"), F.explode(F.array(F.lit("a/b.md"), F.lit("__MACOSX/x.md"), F.lit("c.bin"))).alias("path"), "size")
    return FI.expand_inventory(files, inside)


INVENTORY = f"{FP}, i AS (SELECT id, replace(path, '/', '_') AS p FROM files)"
query("expand_inventory", f"WITH {INVENTORY} SELECT id, p || '.PDF' AS path FROM i WHERE id % 5 <> 0 AND id % 3 <> 0 UNION ALL SELECT id, p || '/a/b.md' FROM i WHERE id % 5 = 0")(lambda s, d: inventory(s, d)[0].select("id", "path"))
query("skipped_files", f"WITH {INVENTORY} SELECT id, p || '.exe' AS path, 'UNSUPPORTED_FILE' AS code FROM i WHERE id % 5 <> 0 AND id % 3 = 0 UNION ALL SELECT id, p || '/__MACOSX/x.md', 'SYSTEM_PATH' FROM i WHERE id % 5 = 0 UNION ALL SELECT id, p || '/c.bin', 'UNSUPPORTED_FILE' FROM i WHERE id % 5 = 0")(
    lambda s, d: inventory(s, d)[1]
)

# Markdown.

query("markdown_islands", "SELECT source || ':' || lang AS doc, doc_id AS k, md5(text) AS name, source || ' ' || lang AS heading FROM documents")(
    lambda s, d: FI.markdown_tables(B.markdown_docs(s, d)).where("row_no > 0").select("doc", F.get("cells", F.lit(0)).cast("long").alias("k"), F.get("cells", F.lit(1)).alias("name"), F.col("name").alias("heading"))
)
#: A document's whole text as a cell: on one line, without the marks of Markdown and entities, between two letters.
MARKS = "[\\n\\r|\\\\*_`&<>]"
DOCS = f"(SELECT doc_id, 't' || regexp_replace(text, '{MARKS}', ' ', 'g') || 't' AS m FROM documents)"


def md(s, d):
    return B.table(s, d, "documents").select("doc_id", F.concat(F.lit("t"), F.regexp_replace("text", MARKS, " "), F.lit("t")).alias("m"))


query("split_md_row", f"SELECT doc_id, [m, 'a|b', ''] AS cells FROM {DOCS}")(lambda s, d: md(s, d).select("doc_id", M.split_row(F.concat(F.lit(" | "), "m", F.lit(r" | a\|b | | "))).alias("cells")))
query("clean_md_cell", f"SELECT doc_id, m || chr(10) || '& <x>' AS cell FROM {DOCS}")(lambda s, d: md(s, d).select("doc_id", M.clean_cell(F.concat(F.lit(" **"), "m", F.lit("**<br/>&amp; `<x>` "))).alias("cell")))
query("is_md_separator", f"SELECT doc_id, doc_id % 2 = 0 AS separator FROM {DOCS}")(lambda s, d: md(s, d).select("doc_id", M.is_separator(M.split_row(F.when(F.col("doc_id") % 2 == 0, "|:---| ---- |:---:|").otherwise("|--|---|"))).alias("separator")))
query("clean_heading", f"SELECT doc_id, m || ' x' AS heading FROM {DOCS}")(lambda s, d: md(s, d).select("doc_id", M.clean_heading(F.concat(F.lit("三、 **"), "m", F.lit("** `x` "))).alias("heading")))
query("fit_width", f"SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN [m, ''] ELSE [m, 'b'] END AS cells FROM {DOCS}")(
    lambda s, d: md(s, d).select("doc_id", M.fit_width(F.when(F.col("doc_id") % 2 == 0, F.array("m")).otherwise(F.array("m", F.lit("b"), F.lit("c"))), F.lit(2)).alias("cells"))
)
