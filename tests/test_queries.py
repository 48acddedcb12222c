"""Every query of the domain against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from larkspur.plans.all_queries import ORACLE_SQL, QUERIES
from tests.conftest import LARGER, SMALL

#: Reports are whole, and their faults planted, at the size at which products are comparable.
WHOLE = {"gate_findings", "refused_findings", "build_actions", "build_actions_short", "action_numbering", "business_reason", "array_refs_merge", "extract_refs", "action_lineage", "action_source_rows", "report_tables_actions", "report_tables_findings",
         "report_metrics", "report_json", "finding_evidence_join", "v18_v21_finding_evidence", "finding_text", "finding_details", "finding_details_short", "problem_flags", "v14_diagnosis_mismatch", "validate_report", "source_anchor_check", "report_document", "evidence_edges", "gate_citations", "gated_edges", "rows_cited_by", "validate_synthesis",
         "resume_plan", "state_transitions", "checked_labels", "dead_letters", "apply_labeller"}


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(name, same):
    same(QUERIES[name], ORACLE_SQL[name], LARGER if name in WHOLE else SMALL)


def test_a_report_with_every_fault(spark):
    found = {r.code for r in QUERIES["validate_report"](spark, LARGER).select("code").distinct().collect()}
    assert len(found) == 30



@pytest.fixture(scope="module")
def many_questions(duck, tmp_path_factory):
    """Tables in which every product has more than 90 questions: conversations thirty times, with shifted ids that keep their product."""
    folder = tmp_path_factory.mktemp("many")
    for f in set(os.listdir(LARGER)) - {"conversations.parquet"}:
        os.symlink(f"{LARGER}/{f}", folder / f)
    db = duckdb.connect()
    db.sql(f"COPY (SELECT * REPLACE (conv_id + 1000000 * i AS conv_id) FROM '{LARGER}/conversations.parquet', range(30) t(i)) TO '{folder}/conversations.parquet'")
    for f in os.listdir(folder):
        db.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{f}'")
    duck[str(folder)] = db
    return str(folder)


def test_a_competitor_with_enough_questions_may_be_cited(same, spark, many_questions):
    """The SQL once took a product to have fewer than 90 questions whatever the tables hold."""
    same(QUERIES["v18_v21_finding_evidence"], ORACLE_SQL["v18_v21_finding_evidence"], many_questions)
    assert "INELIGIBLE_COMPETITOR_EVIDENCE" not in {r.code for r in QUERIES["v18_v21_finding_evidence"](spark, many_questions).collect()}


def test_a_report_with_many_questions(same, many_questions):
    """The SQL of the whole report once took the same."""
    same(QUERIES["validate_report"], ORACLE_SQL["validate_report"], many_questions)


@pytest.mark.parametrize("name", ["v08_aggregate_mismatch", "v10_completeness_mismatch", "v13_readiness_mismatch", "v14_diagnosis_mismatch"])
def test_a_report_is_computed_once(spark, monkeypatch, name):
    """What is compared with itself but for a planted fault was once computed twice."""
    from larkspur.plans import bindings

    made, orders = [], bindings.reviews_orders
    monkeypatch.setattr(bindings, "reviews_orders", lambda s, d: made.append(d) or orders(s, d))
    QUERIES[name](spark, SMALL)
    assert len(made) == 1
