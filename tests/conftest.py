import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMALL, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    out = {}
    for folder in (SMALL, LARGER):
        out[folder] = duckdb.connect()
        for f in os.listdir(folder):
            out[folder].sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{f}'")
    return out


def plain(v):
    """A value of either engine in one form."""
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return {k: plain(x) for k, x in v.items()}
    if v is None or v != v:
        return None
    if isinstance(v, float) and v.is_integer():
        return int(v)
    return v


def rows(columns, table):
    return sorted(repr([plain(r[c]) for c in columns]) for r in table)


@pytest.fixture
def same(spark, duck):
    """Asserts that a query and its SQL give the same rows."""

    def check(query, sql, folder=SMALL):
        got = query(spark, folder)
        want = duck[folder].sql(sql)
        assert sorted(got.columns) == sorted(want.columns)
        columns = sorted(got.columns)
        left = rows(columns, [r.asDict() for r in got.collect()])
        right = rows(columns, [dict(zip(want.columns, r, strict=True)) for r in want.fetchall()])
        assert left == right

    return check
