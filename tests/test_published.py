"""Published tables, dealt files, measured joins and evidence edges."""

import os

import pytest
from pyspark.sql import functions as F

from larkspur.operators import evidence as E
from larkspur.operators import integrity as I
from larkspur.operators import joins
from larkspur.sources import published as P


def twice(table):
    return I.repeated(table, "id", "TWICE")


def test_versions_appear_at_once(spark, tmp_path):
    path = str(tmp_path / "t")
    a = spark.range(5)
    assert P.publish(a, path, twice) == 1 and P.publish(spark.range(10, 13), path, twice, append=True) == 2 and P.publish(spark.range(2), path) == 3
    ids = lambda v=None: sorted(r.id for r in P.read_published(spark, path, v).collect())
    assert ids() == [0, 1] and ids(2) == [0, 1, 2, 3, 4, 10, 11, 12] and ids(1) == [0, 1, 2, 3, 4]
    gone = P.sweep(spark, path, keep=2, older_than_s=0)
    assert ids() == [0, 1] and ids(2) == [0, 1, 2, 3, 4, 10, 11, 12] and "manifest-0000000001.json" in gone
    with pytest.raises(FileNotFoundError):
        P.read_published(spark, str(tmp_path / "none"))


def test_what_breaks_before_the_rename_is_not_seen(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    P.publish(spark.range(3), path)
    with pytest.raises(ValueError, match="TWICE"):
        P.publish(spark.range(3).union(spark.range(3)), path, twice)
    put = P._Folder.put

    def lost(self, name, content):
        raise OSError("the driver is gone")

    monkeypatch.setattr(P._Folder, "put", lost)
    with pytest.raises(OSError):
        P.publish(spark.range(100), path)
    assert P.read_published(spark, path).count() == 3
    monkeypatch.setattr(P._Folder, "put", put)
    # What the lost job has staged goes, what is published stays.
    assert len([n for n in os.listdir(path) if n.startswith("data-")]) == 2
    assert len(P.sweep(spark, path, older_than_s=0)) == 1 and P.read_published(spark, path).count() == 3


def test_two_writers(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    P.append_numbered(spark.range(3).withColumnRenamed("id", "x"), path, ["x"])
    put, first = P._Folder.put, []

    def late(self, name, content):
        """Another writer is faster, once."""
        if not first:
            first.append(name)
            P.append_numbered(spark.range(100, 102).withColumnRenamed("id", "x"), path, ["x"])
        put(self, name, content)

    monkeypatch.setattr(P._Folder, "put", late)
    assert P.append_numbered(spark.range(10, 14).withColumnRenamed("id", "x"), path, ["x"]) == 3
    assert sorted((r.id, r.x) for r in P.read_published(spark, path).collect()) == [(1, 0), (2, 1), (3, 2), (4, 100), (5, 101), (6, 10), (7, 11), (8, 12), (9, 13)]
    first.clear()
    with pytest.raises(P.Conflict):
        monkeypatch.setattr(P._Folder, "put", lambda self, name, content: (_ for _ in ()).throw(P.Conflict(name)))
        P.publish(spark.range(1), path)


def test_a_hot_value_is_many_files(spark, tmp_path):
    odd = F.element_at(F.array(*[F.lit(x) for x in ("a,b", 'say "x"', "two\nlines", "", " blank ", "=1", "\\", "ü")]), (F.col("id") % 8 + 1).cast("int"))
    rows = spark.range(6000).select(F.when(F.col("id") % 3 == 0, F.concat(F.lit("p"), F.col("id") % 7)).otherwise("hot/ product").alias("product"), F.col("id").alias("rank"), odd.alias("cell"), F.when(F.col("id") % 5 > 0, F.col("id")).alias("n"))
    path = str(tmp_path / "t")
    P.write_dealt(rows, path, "product", ["rank"], rows_per_file=500)
    got = P.read_dealt(spark, path, rows.schema)
    assert sorted(map(tuple, got.select(*rows.columns).collect())) == sorted(map(tuple, rows.collect()))
    sizes = got.groupBy(F.input_file_name().alias("f"), "product").count().collect()
    assert max(r["count"] for r in sizes) <= 500 and sum(r["product"] == "hot/ product" for r in sizes) >= 8


def test_small_files_do_not_make_many_tasks(spark, tmp_path):
    """There was once a range, and samples of it at the driver, for each file."""
    rows = spark.range(20_000).select(F.lit("a").alias("product"), F.col("id").alias("rank"))
    P.write_dealt(rows, str(tmp_path / "t"), "product", ["rank"], rows_per_file=100)
    names = os.listdir(tmp_path / "t" / "product=a")
    parts = {n.split("-")[1] for n in names if n.startswith("part-")}
    assert len([n for n in names if n.startswith("part-")]) == 200 and len(parts) == 1
    assert P.read_dealt(spark, str(tmp_path / "t"), rows.schema).count() == 20_000


def test_joins_are_measured(spark):
    left, right = spark.range(100).withColumn("k", F.col("id") % 5), spark.range(5).select(F.col("id").alias("k"), F.array(F.struct(F.lit("x").alias("a"))).alias("nested"))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan(joins.join_checked(left, right, "k")) and "SortMergeJoin" in plan(joins.join_checked(left, right, "k", most=10))
    assert joins.table_bytes(right) > 5 * 48 and joins.table_bytes(right.limit(0)) == 0
    assert joins.join_written(left, right.where("k < 2"), "k", "left_anti").count() == 60


def test_edges_and_gate(spark):
    of = lambda rows: spark.createDataFrame(rows, "finding_id string, evidence_id string")
    states = lambda *rows: spark.createDataFrame(rows, "finding_id string, status string")
    ready = states(("F01", "available"), ("F02", "available"), ("F03", "unavailable"), ("F04", "available"), ("F05", "available"))
    allowed = of([(f"F0{i}", e) for i in range(1, 6) for e in ("a", "b")])
    cited = of([("F01", "a"), ("F02", "a"), ("F02", "a"), ("F03", "a"), ("F04", "c")])
    findings, edges, errors = E.gate_citations(states(("F01", "available"), ("F02", "available"), ("F03", "available"), ("F04", "available"), ("F05", "available")), cited, ready, allowed, of([("F02", "d"), ("F01", "x")]))
    assert {r.finding_id: (r.status, r.accepted) for r in findings.collect()} == {"F01": ("available", True), **{f"F0{i}": ("unavailable", False) for i in range(2, 6)}}
    assert {tuple(r) for r in edges.collect()} == {("F01", "a"), ("F01", "b"), ("F02", "d")}
    assert {r.finding_id for r in errors.collect()} == {"F02", "F03", "F04", "F05"}
    rows = spark.createDataFrame([("a", "type", "r1"), ("a", "type", "r2"), ("d", "data", "r1")], "evidence_id string, family string, row_id string")
    back = E.cited_by(rows, edges, spark.createDataFrame([("r1",)], "row_id string"), "finding_id")
    assert {tuple(r) for r in back.collect()} == {("r1", "F01", "a"), ("r1", "F02", "d")}
