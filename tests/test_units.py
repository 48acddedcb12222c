"""Functions and small operators on literal rows."""

import hashlib
import math
import os
import random
import zipfile
from collections import defaultdict
from fractions import Fraction

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from larkspur.functions import markdown as M
from larkspur.functions import paths as P
from larkspur.functions import text as T
from larkspur.operators import aggregates, dedup, files, findings, integrity, labels, report, validate_rows
from larkspur.operators.numbering import numbered
from larkspur.plans.spill import scratch_path, workspace
from larkspur.sources import headers, workbooks


def values(spark, items, f, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(items)], f"i int, x {kind}")
    return [r[0] for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").select("y").collect()]


def test_groups_of_paths(spark):
    paths = ["多竞品/01_品牌甲/主图/a.png", "品牌乙/a.png", "x/品牌丙/b/a.png", "资料/主图/c.png", "competitors/brand-x/p.pdf", "牌子_1.png", "主图_1.png", "a", "", "/"]
    want = ["品牌甲", "品牌乙", "品牌丙", "资料", "brand-x", "牌子", None, None, None, None]
    assert values(spark, paths, lambda c: P.infer_group(P.normalize_path(c))) == want


def test_modules_of_paths(spark):
    assert values(spark, ["a/市场资料/x", "竞品分析/详情页.png", "X/Buyer-Show/1", "评价区/a", "none", None], P.classify_path) == ["market", "competitor", "buyer", "review", None, None]


def test_ranks(spark):
    assert values(spark, ["1", "007", "0", "-1", "1.0", "9007199254740991", "9007199254740992", "9" * 40, "", None], T.rank_value) == [1, 7, None, None, None, 9007199254740991, None, None, None, None]
    assert values(spark, ["１２", " 12 ", "\u3000０7\t", "1 2", "⑫", "²", "0" * 30 + "5"], T.rank_value) == [12, 12, 7, None, 12, 2, 5]


def test_exact_form(spark):
    assert values(spark, ["Ａ b　c", "a﻿b ", "é", None], T.normalize_exact) == ["Abc", "ab", "é", None]


def test_text_keys_of_composed_and_wide_texts(spark):
    texts = ["Ａ b", "A\u3000b", "Ab", "é x", "e\u0301x", "éx", None, "ﬁ", "fi"]
    rows = spark.createDataFrame(list(enumerate(texts)), "row_id long, text string")
    got = {r.row_id: r.key for r in dedup.with_text_key(rows, "text").collect()}
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    assert [got[i] for i in range(9)] == [md5("Ab")] * 3 + [md5("éx")] * 3 + [None] + [md5("fi")] * 2


def test_no_text_comes_back_from_python_for_its_key(spark, tmp_path):
    """Texts once went to Python and back as whole batches; only digests come back."""
    spark.createDataFrame([(1, "é")], "row_id long, text string").write.parquet(str(tmp_path / "t"))
    seen = []
    write = dedup.written
    dedup.written = lambda df: seen.append(df._jdf.queryExecution().optimizedPlan().toString()) or write(df)
    try:
        dedup.with_text_key(spark.read.parquet(str(tmp_path / "t")), "text")
    finally:
        dedup.written = write
    assert "MapInArrow" in seen[0] and "ArrowEvalPython" not in seen[0]


def test_compatibility_form_in_slices():
    texts = [None, "Ａ", "b"] * 50
    assert T.nfkc.func(pa.array(texts)).to_pylist() == [None, "A", "b"] * 50
    assert T.nfkc.func(pa.array([], pa.string())).to_pylist() == []


def decimal_tenths(x):
    """x times 100 as one rounds the exact value of a double: half away from zero."""
    n = abs(Fraction(x * 100.0)) * 10
    n = int(n + Fraction(1, 2))
    return f"{'-' if x * 100.0 < 0 else ''}{n // 10}.{n % 10}%"


def test_percent_of_any_double(spark):
    r = random.Random(1)
    shares = [r.random() for _ in range(300_000)] + [r.randint(0, 20_000) / 20_000 for _ in range(300_000)] + [a / b for a in range(0, 700) for b in range(max(a, 1), 701)]
    shares += [-x for x in shares[:50_000]] + [x * 10 ** -r.randint(1, 9) for x in shares[:100_000]] + [0.0635, 0.0115, 0.0005, 0.00049999999, 1.0, 5e-324, 1e-17, 12.3455]
    near = [math.nextafter(x, y) for x in (0.0005, 0.0635, 0.0115, 0.5005, 0.9995, 0.1235) for y in (0, 1)]
    shares += near
    got = spark.createDataFrame(pd.DataFrame({"i": range(len(shares)), "x": shares})).select("i", T.percent1(F.col("x")).alias("y")).toPandas().sort_values("i")["y"].tolist()
    assert [(x, g) for x, g in zip(shares, got, strict=True) if g != decimal_tenths(x)] == []


def test_percent(spark):
    assert values(spark, [0.0625, 0.5, 0.0, 1.0], T.percent1, "double") == ["6.3%", "50.0%", "0.0%", "100.0%"]


def test_refs_between_other_letters(spark):
    assert values(spark, ["见F01与F02、F01", "xF01 F1a AGG-TYPE-p-t1：DATA-p-q_"], lambda c: T.extract_refs(c, "finding")) == [["F01", "F02"], []]
    assert values(spark, ["AGG-TYPE-p-t1、DATA-a:b-q。AGG-"], lambda c: T.extract_refs(c, "evidence")) == [["AGG-TYPE-p-t1", "DATA-a:b-q"]]


def test_cells(spark):
    assert values(spark, ["=1", " +x", "a=", "@b", "", None], T.safe_cell) == ["'=1", "' +x", "a=", "'@b", "", None]
    assert values(spark, ["a\x00b￾", "\U0001F600\n"], T.clean_xml_text) == ["a�b�", "\U0001F600\n"]


def test_markdown_table_rules(spark):
    text = "# 一、Name `x`\n| a | b |\n|---|---|\n# c | d\n| e \\| f |\nend\n| g | h |\nno table\n\n|i|\n|---|\n| j | k |"
    got = files.markdown_rows(spark.createDataFrame([("d", text), ("e", None), ("f", "")], "doc string, markdown string")).orderBy("table_no", "row_no").collect()
    assert [(r.table_no, r.row_no, r.name, r.cells) for r in got] == [
        (1, 0, "Name x", ["a", "b"]), (1, 1, "Name x", ["# c", "d"]), (1, 2, "Name x", ["e | f", ""]), (2, 0, "Name x", ["i"]), (2, 1, "Name x", ["j"]),
    ]


def test_lines_over_many_tasks_are_the_same_tables(spark, monkeypatch):
    r = random.Random(12)
    kinds = ["| a | b |", "|---|---|", "|---|:--:|", "| c |", "text", "", "# H1", "## 2. `H2` x", "# P | Q", "x | y", "| d \\| e | **f** | g |"]
    docs = [(f"d{i}", "\n".join(r.choices(kinds, [5, 4, 1, 3, 2, 1, 1, 1, 1, 2, 1], k=r.choice([3, 20, 150])))) for i in range(40)] + [("long", "\n".join(["# Long", "| a | b |", "|---|---|", *(["| 1 | 2 |"] * 4000), "# in | it", "end", "| x |", "|---|"]))]
    texts = spark.createDataFrame(docs, "doc string, markdown string")
    lines = spark.createDataFrame([(d, i, line) for d, t in docs for i, line in enumerate(t.split("\n"))], "doc string, pos long, line string").repartition(3)
    columns = ["doc", "table_no", "row_no", "name", "cells"]
    want = sorted(map(str, files.markdown_rows(texts).select(*columns).collect()))
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    for parts in ("60", "7"):
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            got = sorted(map(str, files.markdown_tables(lines).select(*columns).collect()))
        finally:
            for k, v in before.items():
                spark.conf.set(k, v)
        assert got == want and len(want) > 4500


def test_a_heading_with_a_pipe_is_a_heading(spark):
    text = "# A | B\n|---|---|\n| x | y |\n|---|---|\n| 1 | 2 |\n# no | heading\n\n## C | D\n| k |\n|---|"
    got = files.markdown_rows(spark.createDataFrame([("d", text)], "doc string, markdown string")).orderBy("table_no", "row_no").collect()
    assert [(r.table_no, r.row_no, r.name, r.cells) for r in got] == [
        (1, 0, "A | B", ["x", "y"]), (1, 1, "A | B", ["1", "2"]), (1, 2, "A | B", ["# no", "heading"]), (2, 0, "C | D", ["k"]),
    ]


def test_members_need_a_path(spark):
    assert values(spark, ["./", "", "/", "a//./b", "..", "a/../b", "\\x\\y"], P.safe_archive_path) == [None, None, None, "a/b", None, None, "x/y"]


def test_fences(spark):
    assert values(spark, ["```JSON\n{}\n```", "```\n```", "```json```", " \n x \u3000", "``` a", "a ```json b```"], labels.unwrap_fence) == ["{}", "", "", "x", "``` a", "a ```json b```"]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Shanghai"])
def test_minutes_in_any_session_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        got = values(spark, ["2024-03-10T07:30:00Z", "2024-03-10T02:30:00.123Z", "2024-11-03 06:30:00+01:00", "1988-07-01T00:00:00Z", "x", None], T.beijing_minute)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert got == [f"{t}{T.MINUTE_MARK}" for t in ("2024-03-10 15:30", "2024-03-10 10:30", "2024-11-03 13:30", "1988-07-01 09:00")] + [T.NO_MINUTE] * 2


def test_order_by_locale(spark):
    names = ["b", "B", "a", "É", "e", "é", "Z", "_", "10", "9", "ä"]
    gaps = spark.createDataFrame([("p", n, 0.5) for n in names], "product_id string, type_id string, difference double")
    own = spark.createDataFrame([("p",)], "product_id string")
    assert aggregates.top_gap_type(gaps, own).first().type_id == "10" and aggregates.top_gap_type(gaps, own, "UNICODE").first().type_id == "_"
    found = gaps.select(F.col("type_id").alias("product_id"))
    assert [r.product_id for r in aggregates.distinct_products(found, "UNICODE").collect()] == ["_", "10", "9", "a", "ä", "b", "B", "e", "é", "É", "Z"]
    q = spark.createDataFrame([("p", "t", 1, n) for n in names], "product_id string, topic_id string, rank int, row_id string")
    assert [r.row_id for r in aggregates.representatives(q, 3, "UNICODE").orderBy("n").collect()] == ["_", "10", "9"]


def test_question_headers(spark):
    h = [("a", "昵 称", "时间", "问题\u3000", "问答"), ("b", "昵称", "时间", "问题", "回答"), ("c", "序号 ", "x"), ("d", "昵称", "时间", "问题", "问答", "多")]
    cells = spark.createDataFrame([(s, i, n) for s, *names in h for i, n in enumerate(names)], "source_id string, col_no int, name string")
    assert {r.source_id: r.profile for r in headers.question_profile(cells).collect()} == {"a": "by_order", "b": "INVALID_QUESTION_HEADER_PROFILE", "c": "by_rank", "d": "INVALID_QUESTION_HEADER_PROFILE"}


def test_limits_of_requests(spark):
    rows = [("ok", "1", "a", None), ("ids", "", "a", None), ("ids2", "x" * 257, "a", ""), ("twice", "1", "a", None), ("twice", "1", "b", None), ("blank", "1", " ", None), ("long", "1", "a", "\U0001F600" * 11), ("picture", "1", "a", "\n data:image/png;base64,xx")]
    rows += [("many", str(i), "a", None) for i in range(51)]
    got = labels.input_limits(spark.createDataFrame(rows, "request_id string, row_id string, a string, b string"), ["a", "b"], longest=21 + 5).collect()
    assert {(r.request_id, r.code) for r in got} == {("ids", "INVALID_ID"), ("ids2", "INVALID_ID"), ("twice", "REPEATED_ID"), ("blank", "EMPTY_TEXT"), ("picture", "IMAGE_DATA"), ("many", "TOO_MANY_ROWS")}
    assert [r.code for r in labels.input_limits(spark.createDataFrame(rows[6:7], "request_id string, row_id string, a string, b string"), ["a", "b"], longest=21).collect()] == ["TEXT_TOO_LONG"]


def test_groups_with_further_names(spark):
    rows = [(0, "a.png", "01_甲"), (1, "b.md", None), (2, "c", "乙"), (3, "d.csv", " 2-甲"), (4, "e", "123"), (5, "f.jpg", "丙" * 50)]
    given = spark.createDataFrame(rows, "id long, path string, group_name string")
    extra = spark.createDataFrame([("3 丁", 0), ("乙", 1), ("9", 2)], "name string, position long")
    groups, entries, none = files.recognise(given, extra)
    got = {r.group_name: (r.position, r.files, r.image_count, r.spreadsheet_count) for r in groups.collect()}
    assert got == {"丁": (1, 0, 0, 0), "乙": (2, 1, 0, 0), "甲": (3, 1, 1, 0), " 2-甲": (4, 1, 0, 1), "丙" * 40: (5, 1, 1, 0)} or got == {"丁": (1, 0, 0, 0), "乙": (2, 1, 0, 0), "甲": (3, 1, 1, 0), "2-甲": (4, 1, 0, 1), "丙" * 40: (5, 1, 1, 0)}
    assert {r.id for r in entries.collect()} == {0, 2, 3, 5} and [r.id for r in none.collect()] == [1]


def test_separator(spark):
    assert values(spark, ["|---|:---:|", "|--|", "a", None], lambda c: M.is_separator(M.split_row(c))) == [True, False, False, False]


def sequential(grid, cap):
    """Row by row, as one would sort a sheet by hand."""
    used, out = {}, {}
    for source, row, formula, rank, text in sorted(grid):
        ranks = used.setdefault(source, set())
        n = int(rank) if rank and rank.isdigit() and int(rank) > 0 else None
        if formula:
            out[source, row] = "FORMULA_RANK"
        elif n is None:
            out[source, row] = "MISSING_RANK"
        elif not text.strip():
            out[source, row] = "EMPTY_INITIAL_TEXT"
        elif n in ranks:
            out[source, row] = "DUPLICATE_RANK"
        elif len(ranks) >= cap:
            out[source, row] = "OVER_LIMIT"
        else:
            ranks.add(n)
            out[source, row] = "USED"
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_exclusions_like_row_by_row(spark, seed):
    import random

    r = random.Random(seed)
    grid = [(s, i, r.random() < 0.1, r.choice([None, "x", *map(str, range(25))]), r.choice(["", " ", "t", "t", "t"])) for s in ("a", "b", "c") for i in range(2, 80)]
    df = spark.createDataFrame(grid, "source_id string, row_no int, is_formula boolean, rank_text string, text string")
    got = validate_rows.exclude_rows(df, [("text", "EMPTY_INITIAL_TEXT")], 10)
    assert {(x.source_id, x.row_no): x.reason for x in got.collect()} == sequential(grid, 10)


def test_reconcile(spark):
    want = spark.createDataFrame([("a", 1), ("b", None), ("c", 3), ("d", 4)], "k string, n int")
    got = spark.createDataFrame([("a", 1), ("b", None), ("b", None), ("c", 4), ("e", 5)], "k string, n int")
    assert {(r.k, r.fault) for r in integrity.reconcile(got, want, ["k"]).collect()} == {("b", "REPEATED"), ("c", "DIFFERENT"), ("d", "MISSING"), ("e", "EXTRA")}


def test_sink_is_gated(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("a", 2)], "k string, n int")
    with pytest.raises(ValueError, match="TWICE a"):
        integrity.write_if_clean(rows, integrity.repeated(rows, "k", "TWICE"), str(tmp_path / "x"))
    assert not (tmp_path / "x").exists()
    integrity.write_if_clean(rows, integrity.repeated(rows, "n", "TWICE"), str(tmp_path / "y"), partition_by=["k"])
    assert spark.read.parquet(str(tmp_path / "y")).count() == 2


def test_findings_without_data(spark):
    f = spark.createDataFrame([("F01", "available", False, ["AGG-1"]), ("F02", "available", True, ["AGG-2"]), ("F03", "unavailable", False, ["DATA-3"])], "finding_id string, status string, has_problem boolean, evidence_ids array<string>")
    eligible = spark.createDataFrame([("a", "self", 20, True), ("b", "competitor", 95, True), ("c", "competitor", 3, False)], "product_id string, role string, questions long, eligible boolean")
    got = findings.build_actions(f, eligible).orderBy("action_id").collect()
    assert findings.build_actions(f, eligible.where("product_id <> 'c'")).where("action_id = 'A02'").first().action == "补齐问大家数据"
    assert [(r.action_id, r.priority, r.finding_ids) for r in got] == [("A01", "P1", ["F02"]), ("A02", "P0", ["F03"])]
    assert got[1].reason == "F03｜DATA-3：" + findings.MORE_COMPETITORS[1]


def test_label_results_of_another_form(spark):
    df = spark.createDataFrame([("r1", "not json"), ("r2", None), ("r3", '{"labels": [{"rowId": 1, "typeId": "t1"}]}')], "request_id string, output string")
    assert [(r.request_id, r.row_id) for r in labels.parse_results(df).collect()] == [("r3", 1)]


def workbook(path, sheets):
    with zipfile.ZipFile(path, "w") as z:
        rels, names = "", ""
        for i, (name, xml) in enumerate(sheets, 1):
            names += f'<sheet name="{name}" sheetId="{i}" r:id="rId{i}"/>'
            rels += f'<Relationship Id="rId{i}" Target="worksheets/sheet{i}.xml"/>'
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'<worksheet xmlns="m"><sheetData>{xml}</sheetData></worksheet>')
        z.writestr("xl/workbook.xml", f'<workbook xmlns="m" xmlns:r="r"><sheets>{names}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f"<Relationships>{rels}</Relationships>")
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="m"><si><t>序号</t></si><si><r><t>初</t></r><r><t>评</t></r></si></sst>')


def test_workbooks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    first = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row r="2"><c r="A2"><f>1+1</f><v>2</v></c><c r="B2" t="inlineStr"><is><t>x</t></is></c></row>'
    workbook(tmp_path / "in/a.xlsx", [("default", first), ("recent", "")])
    (tmp_path / "in/b.xlsx").write_bytes(b"no workbook")
    cells = workbooks.scan_workbook_cells(spark, str(tmp_path / "in")).cache()
    got = {(r.sheet_no, r.row_no, r.col_no, r.value, r.is_formula) for r in workbooks.select_sheet(cells).collect()}
    assert got == {(0, 1, 1, "序号", False), (0, 1, 2, "初评", False), (0, 2, 1, "2", True), (0, 2, 2, "x", False)}
    assert [r.error for r in cells.where("error IS NOT NULL").collect()] == ["UNREADABLE_FILE"]
    small = workbooks.scan_workbook_cells(spark, str(tmp_path / "in"), most=20)
    assert {r.error for r in small.collect()} == {"FILE_TOO_LARGE", "UNREADABLE_FILE"}


def test_archives(spark, tmp_path):
    (tmp_path / "in").mkdir()
    with zipfile.ZipFile(tmp_path / "in/a.zip", "w") as z:
        for n in ("多竞品/甲/a.png", "__MACOSX/x", "d/.DS_Store", "e/"):
            z.writestr(n, b"12345")
    with zipfile.ZipFile(tmp_path / "in/b.zip", "w") as z:
        for i in range(121):
            z.writestr(f"{i}", b"")
    got = {(r.path[-5:], r.member, r["size"], r.error) for r in workbooks.list_archive_entries(spark, str(tmp_path / "in")).collect()}
    assert got == {("a.zip", "多竞品/甲/a.png", 5, None), ("b.zip", None, None, "OVER_LIMIT")}


def test_headers_without_any(spark):
    h = spark.createDataFrame([("a", 1, "序号"), ("a", 2, "排名"), ("b", 1, " ")], "source_id string, col_no int, name string")
    mapping, faults = headers.map_headers(h, headers.alias_table(spark, headers.REVIEW_ALIASES), ["rank"])
    assert [(r.source_id, r.field, r.col_no) for r in mapping.collect()] == [("a", "rank", 1)]
    assert {(r.source_id, r.code, r.detail) for r in faults.collect()} == {("a", "DUPLICATE_COLUMN", "排名"), ("b", "MISSING_HEADER", "")}


def test_numbers_in_groups_of_any_size(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 10 == 0, F.concat(F.lit("g"), F.col("id") % 7)).when(F.col("id") % 10 > 1, F.lit("hot")).alias("g"), (F.col("id") * 7919 % 3001).alias("o"), F.lit("x").alias("n2"))
    want = defaultdict(list)
    for r in rows.collect():
        want[r.g].append(r.o)
    got = defaultdict(list)
    for r in numbered(rows, ["g"], ["o"]).orderBy("g", "n").collect():
        got[r.g].append((r.n, r.o))
    assert got == {g: list(enumerate(sorted(o), 1)) for g, o in want.items()}
    assert numbered(rows.where("false"), ["g"], ["o"]).count() == 0


def test_only_texts_beyond_ascii_are_normalised_in_python(spark):
    rows = spark.createDataFrame([(1, "a b"), (2, "ａ ｂ"), (3, "ab"), (4, None), (5, "\u3000é"), (6, "e\u0301")], "row_id long, text string")
    key = {r.row_id: r.key for r in dedup.with_text_key(rows, "text").collect()}
    assert key[1] == key[2] == key[3] and key[4] is None and key[5] == key[6] != key[1]


def test_notes_are_appended(spark, tmp_path):
    notes = spark.createDataFrame([(1, "2024-01-01", " a ", None), (2, "2024-01-02", " ", "x"), (3, "2024-01-02", "b", "y")], "note_id long, ts string, title string, content string")
    report.append_notes(notes, str(tmp_path / "n"))
    table = report.append_notes(notes.where("note_id = 3").withColumn("note_id", F.lit(4).cast("long")), str(tmp_path / "n"))
    assert [(r.note_id, r.title, r.content) for r in report.recent_notes(table, 2).collect()] == [(4, "b", "y"), (3, "b", "y")] and table.count() == 3


def test_work_tables_go_with_their_workspace(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(root))
    with workspace(spark):
        assert numbered(spark.range(20), [], ["id"]).count() == 20 and set(os.listdir(root)) - before
    assert set(os.listdir(root)) <= before


def test_work_tables_need_a_shared_folder():
    class Session:
        class conf:  # noqa: N801
            get = staticmethod(lambda key, default: default)

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

    with pytest.raises(RuntimeError, match="checkpoint"):
        scratch_path(Session())
