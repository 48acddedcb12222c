"""Paths for tables that a job writes between its steps."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


#: Work tables of the workspaces that are open, the innermost last.
_open: list[list[str]] = []


@contextmanager
def workspace(spark: SparkSession) -> Iterator[None]:
    """Work tables written inside are deleted at the end: for jobs that write or collect their results inside. Results that are still
    lazy read these tables, so they must not leave it."""
    made: list[str] = []
    _open.append(made)
    try:
        yield
    finally:
        _open.pop()
        for path in made:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def scratch_path(spark: SparkSession) -> str:
    """A new path in the folder that all executors share. In local mode a temporary folder will do; a cluster must name one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="larkspur-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/larkspur-{uuid.uuid4().hex}"
    if _open:
        _open[-1].append(path)
    return path


def written(df: DataFrame) -> DataFrame:
    """df as a work table: what reads it several times computes it once, and lineage ends here."""
    path = scratch_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
