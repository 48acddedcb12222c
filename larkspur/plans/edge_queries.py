"""Queries over evidence as edges, published tables, dealt files, recognised groups and manifests."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.operators import evidence as E
from larkspur.operators import files as FI
from larkspur.operators import integrity as I
from larkspur.operators import report as R
from larkspur.plans import bindings as B
from larkspur.plans import label_queries as LQ
from larkspur.plans import report_queries as PQ
from larkspur.plans import review_queries as RQ
from larkspur.plans.registry import query
from larkspur.plans.report import Report
from larkspur.plans.spill import scratch_path, written
from larkspur.sources import published as P

EDGES = """SELECT evidence_id, 'type' AS family, row_id FROM gaps JOIN reviews USING (product_id, type_id) UNION ALL SELECT evidence_id, 'dimension', a.review_id FROM cover JOIN assessed a USING (product_id, dimension) WHERE present
  UNION ALL SELECT evidence_id, 'question', row_id FROM tstat JOIN questions USING (product_id, topic_id) UNION ALL SELECT 'DATA-' || product_id || '-' || sort || '_reviews', 'data', row_id FROM reviews
  UNION ALL SELECT 'DATA-' || product_id || '-questions', 'data', row_id FROM questions"""
query("evidence_edges", f"WITH {RQ.FLAGGED} {EDGES}")(lambda s, d: Report(s, d).edges)


def gated(r):
    """Findings as a model may propose them, as edges: F02 with a wrong status, F03 with evidence that there is not and another twice."""
    cited = r.allowed_edges.where("finding_id = 'F01'").unionByName(r.allowed_edges.where("finding_id = 'F02'"))
    third = r.allowed_edges.where("finding_id = 'F03'")
    cited = cited.unionByName(third).unionByName(third).unionByName(third.select("finding_id", F.lit("AGG-NONE").alias("evidence_id")))
    status = F.when(F.col("finding_id") == "F02", "unavailable").otherwise(F.col("status"))
    findings, edges, errors = E.gate_citations(r.findings.select("finding_id", status.alias("status")), cited, r.ready.select("finding_id", "status"), r.allowed_edges, r.data_edges)
    return written(findings), written(edges), errors


GATED = f"""{PQ.FOUND}, {RQ.SOURCES}, {PQ.DATA_FOR.replace('$keep', 'true')}, gatedf AS (SELECT f.finding_id, f.finding_id = 'F01' AS accepted, CASE WHEN f.finding_id = 'F01' THEN status ELSE 'unavailable' END AS status, has_problem,
    CASE WHEN f.finding_id = 'F01' THEN evidence_ids ELSE ids END AS evidence_ids FROM findings f JOIN data_for USING (finding_id))"""
query("gate_citations", f"WITH {GATED} SELECT finding_id, status, accepted FROM gatedf")(lambda s, d: gated(Report(s, d))[0])
query("gated_edges", f"WITH {GATED} SELECT finding_id, unnest(evidence_ids) AS evidence_id FROM gatedf")(lambda s, d: gated(Report(s, d))[1])


@query("action_source_rows", f"""WITH {GATED}, acts AS (SELECT 'A' || lpad(CAST(row_number() OVER (ORDER BY finding_id) AS VARCHAR), 2, '0') AS action_id, evidence_ids FROM gatedf WHERE status = 'unavailable' OR has_problem
), e AS MATERIALIZED (SELECT action_id, unnest(evidence_ids) AS evidence_id FROM acts), edges AS MATERIALIZED ({EDGES}) SELECT action_id, evidence_id, family, row_id FROM e JOIN edges USING (evidence_id)""")
def _(s, d):
    """The rows behind the actions for gated findings: of an accepted one those of its aggregates, of others those of their sources."""
    r = Report(s, d)
    findings, edges, _ = gated(r)
    acts = findings.join(F.broadcast(r.flags.select("finding_id", "has_problem")), "finding_id").where("status = 'unavailable' OR has_problem")  # a row per finding, of three
    names = s.createDataFrame([(f, i) for i, f in enumerate(("F01", "F02", "F03"))], "finding_id string, place int")
    n = acts.join(F.broadcast(names), "finding_id").agg(F.array_sort(F.collect_list("finding_id")).alias("ids"))  # at most three
    acts = n.select(F.posexplode("ids").alias("n", "finding_id")).select(F.concat(F.lit("A"), F.lpad((F.col("n") + 1).cast("string"), 2, "0")).alias("action_id"), "finding_id")
    return E.traced(edges.join(F.broadcast(acts), "finding_id").select("action_id", "evidence_id"), r.edges, "action_id")


@query("rows_cited_by", f"WITH {GATED}, e AS MATERIALIZED (SELECT finding_id, unnest(evidence_ids) AS evidence_id FROM gatedf), edges AS MATERIALIZED ({EDGES}) SELECT row_id, finding_id, evidence_id FROM e JOIN edges USING (evidence_id) WHERE row_id IN (SELECT row_id FROM reviews WHERE rank % 50 = 1)")
def _(s, d):
    """What stands on every fiftieth review."""
    r = Report(s, d)
    return E.cited_by(r.edges, gated(r)[1], r.reviews.where("rank % 50 = 1"), "finding_id")


# Facts and proposals of a synthesis.

FACT_FAULTS = """SELECT 'REPEATED_READINESS' AS code, 'F02' AS object_id UNION ALL SELECT 'MISSING_READINESS', 'F03' UNION ALL SELECT 'READINESS_WITHOUT_REASON', 'F02' UNION ALL SELECT 'READINESS_EVIDENCE', 'F01' UNION ALL SELECT 'UNKNOWN_EVIDENCE', 'F02:AGG-NONE'
  UNION ALL SELECT 'BLANK_ID', 'evidence' UNION ALL SELECT 'STATUS_DIFFERS', 'F02' UNION ALL SELECT 'MISSING_PROPOSAL', 'F03' UNION ALL SELECT 'PROPOSAL_EVIDENCE', 'F01' UNION ALL SELECT 'EVIDENCE_NOT_ALLOWED', 'F01:' || min(evidence_id) FROM cover"""


@query("validate_synthesis", f"WITH {RQ.FLAGGED} {FACT_FAULTS}")
def _(s, d):
    """A readiness table and a proposal with a fault of each kind, over the evidence of a report."""
    r = Report(s, d)
    evidence = r.evidence.select("evidence_id", "product_id").unionByName(s.createDataFrame([(" ", "BUILDING")], "evidence_id string, product_id string"))
    mine = r.allowed_edges.where("finding_id = 'F01'")
    twice = mine.unionByName(mine)
    facts = s.createDataFrame([("F01", "available", "why"), ("F02", "available", "why"), ("F02", "available", " ")], "finding_id string, status string, reason string")
    fact_edges = twice.unionByName(r.allowed_edges.where("finding_id = 'F02'").select("finding_id", F.lit("AGG-NONE").alias("evidence_id")).limit(1))
    proposed = s.createDataFrame([("F01", "available"), ("F02", "unavailable")], "finding_id string, status string")
    foreign = r.coverage.agg(F.min("evidence_id").alias("evidence_id")).select(F.lit("F01").alias("finding_id"), "evidence_id")
    return I.validate_synthesis(facts, fact_edges, proposed, twice.unionByName(foreign).unionByName(fact_edges.where("finding_id = 'F02'")), evidence)


# Published tables and files.


@query("publish_table", f"WITH {RQ.DENSE} SELECT source_id, used_rows, CAST(v AS INTEGER) AS version FROM sources, (VALUES (2), (3)) x(v)")
def _(s, d):
    """A table published three times: replaced by the second version, appended to by the third; a fourth has a fault and never appears."""
    rows, path = RQ.all_sources(s, d).select("source_id", "used_rows"), scratch_path(s)
    of = lambda v: rows.withColumn("version", F.lit(v))
    P.publish(of(1), path)
    P.publish(of(2), path, lambda t: I.repeated(t, "source_id", "TWICE"))
    P.publish(of(3), path, lambda t: I.repeated(t, "source_id", "TWICE"), append=True)
    try:
        P.publish(of(4).union(of(4)), path, lambda t: I.repeated(t, "source_id", "TWICE"))
    except ValueError:
        return P.read_published(s, path)
    raise AssertionError("a table with a fault was published")


NOTED = "SELECT event_id AS note_id, ts, event_type AS title, CASE WHEN event_id % 3 = 0 THEN event_type ELSE '' END AS content, event_id % 2 AS part FROM events WHERE event_id % 5 <> 0"


@query("append_note_ids", f"SELECT CAST(row_number() OVER (ORDER BY part, ts, note_id) AS BIGINT) AS id, note_id, title, content FROM ({NOTED})")
def _(s, d):
    """Notes appended in two goes with ids that go on, by time."""
    path, n = scratch_path(s), R.notes_to_keep(PQ.notes(s, d).withColumn("content", F.concat(F.lit(" "), "content", F.lit("\t"))))
    for part in (0, 1):
        P.append_numbered(n.where(f"note_id % 2 = {part}"), path, ["ts", "note_id"])
    return P.read_published(s, path).select("id", "note_id", "title", "content")


@query("report_files", f"WITH {RQ.FLAGGED} {PQ.REVIEW_ROWS}")
def _(s, d):
    """The table of labelled reviews as CSV files by product, split where a product has many rows, and read back."""
    r, path = Report(s, d), scratch_path(s)
    rows = R.reviews_table(PQ.full_reviews(r), r.gaps)
    P.write_dealt(rows, path, "product_id", ["sort", "rank"], rows_per_file=1000)
    return P.read_dealt(s, path, rows.schema)


# Groups and manifests.

FURTHER = "further AS (SELECT '3-' || detected AS name, id AS position FROM files WHERE id % 50 = 0 UNION ALL SELECT 'further', -1)"
RECOGNISED = f"""{LQ.FP}, g AS (SELECT id, CASE WHEN id % 10 = 0 THEN '12_manual' WHEN id % 6 <> 0 THEN detected END AS name FROM files), {FURTHER}, named AS (SELECT id, substr(regexp_replace(name, '^[0-9]+[_\\-\\s]*', ''), 1, 40) AS group_name FROM g)
, places AS (SELECT group_name, late, place FROM (SELECT group_name, 1 AS late, id AS place FROM named WHERE group_name IS NOT NULL UNION ALL SELECT substr(regexp_replace(name, '^[0-9]+[_\\-\\s]*', ''), 1, 40), 0, position FROM further) QUALIFY row_number() OVER (PARTITION BY group_name ORDER BY late, place) = 1)"""


def recognised(s, d):
    f = B.files_pages(s, d)
    named = FI.apply_overrides(f.withColumn("detected", F.when(F.col("id") % 6 != 0, F.col("detected"))), f.where("id % 10 = 0").select("id", F.lit(" 12_manual ").alias("assigned")))
    extra = f.where("id % 50 = 0").select(F.concat(F.lit("3-"), "detected").alias("name"), F.col("id").alias("position"))
    return FI.recognise(named, extra.unionByName(s.createDataFrame([("further", -1)], "name string, position long")))


query("recognised_groups", f"WITH {RECOGNISED} SELECT p.group_name, CAST(row_number() OVER (ORDER BY late, place, p.group_name) AS INTEGER) AS position, count(n.id) AS files FROM places p LEFT JOIN named n USING (group_name) GROUP BY p.group_name, late, place")(
    lambda s, d: recognised(s, d)[0].select("group_name", "position", "files")
)
query("group_entries", f"WITH {RECOGNISED} SELECT group_name, id FROM named WHERE group_name IS NOT NULL")(lambda s, d: recognised(s, d)[1])
query("unclassified_entries", f"WITH {RECOGNISED} SELECT id FROM named WHERE group_name IS NULL")(lambda s, d: recognised(s, d)[2])


@query("manifest_text", f"""WITH {LQ.FP} SELECT id, CASE id % 6 WHEN 1 THEN '1. ' || substr('A ' || path, 1, 40) || '：x y、' || substr(path, 1, 240) || chr(10) || '2. b：q'
  WHEN 2 THEN (SELECT string_agg(i || '. g' || i || '：' || substr(path, 1, 240), chr(10) ORDER BY i) FROM range(1, 21) t(i)) WHEN 3 THEN '1. n：' || (SELECT string_agg('f' || i || substr(path, 1, 200), '、' ORDER BY i) FROM range(1, 81) t(i)) ELSE '' END AS text FROM files""")
def _(s, d):
    """Manifests of the forms that there are: no JSON, odd names and files, too many groups, too many files, no groups, too long."""
    p, m = F.col("path"), F.col("id") % 6
    quoted = F.concat(F.lit('"'), p, F.lit('"'))
    many = F.transform(F.sequence(F.lit(1), F.lit(25)), lambda i: F.concat(F.lit('{"name":"g'), i.cast("string"), F.lit('","files":['), quoted, F.lit("]}")))
    files = F.transform(F.sequence(F.lit(1), F.lit(90)), lambda i: F.concat(F.lit('"f'), i.cast("string"), F.substring(p, 1, 200), F.lit('"')))
    manifest = (
        F.when(m == 0, "{no json")
        .when(m == 1, F.concat(F.lit('{"groups":[{"name":"　Ａ '), p, F.lit('","files":["x\\u0001 y",5,"",'), quoted, F.lit(']},{"name":"","files":["z"]},{"name":"n","files":[]},7,{"name":"b","files":["q"]}]}')))
        .when(m == 2, F.concat(F.lit('{"groups":['), F.array_join(many, ","), F.lit("]}")))
        .when(m == 3, F.concat(F.lit('{"groups":[{"name":"n","files":['), F.array_join(files, ","), F.lit("]}]}")))
        .when(m == 4, F.when(F.col("id") % 4 == 0, '{"groups":{}}').otherwise('{"groups":[{"name":"b","files":["q"]},null]}'))
        .otherwise(F.concat(F.lit('{"groups":[{"name":"n","files":["'), F.repeat(F.lit("x"), 30_000), F.lit('"]}]}')))
    )
    return FI.manifest_text(B.files_pages(s, d).select("id", manifest.alias("manifest")))
