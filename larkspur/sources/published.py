"""Tables that readers see whole or not at all: rows are staged, checked and published by one rename."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.operators.numbering import numbered

#: How often an append is tried again when others publish at the same time.
TRIES = 20
#: Rows that a task of write_dealt() has at least, if there are so many: ranges are found from samples at the driver, a hundred
#: and more rows a range, so small files are many a task.
TASK_ROWS = 200_000


class Conflict(RuntimeError):
    """Another writer has published the version first."""


class _Folder:
    """A folder in any store that Spark's Hadoop client knows; only names and manifests go through the driver."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.root = path.rstrip("/")
        self.fs = self.jvm.org.apache.hadoop.fs.Path(self.root).getFileSystem(self.conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def manifests(self) -> list[str]:
        at = self.jvm.org.apache.hadoop.fs.Path(self.root)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at) if s.getPath().getName().startswith("manifest-")) if self.fs.exists(at) else []

    def read(self, name: str) -> dict:
        stream = self.fs.open(self.path(name))
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def put(self, name: str, content: dict) -> None:
        """Write a file under a name that nobody sees and rename it; raises Conflict if the name is taken."""
        staged = self.path(f"_staged-{uuid.uuid4().hex}")
        out = self.fs.create(staged, False)
        try:
            out.write(bytearray(json.dumps(content).encode()))
        finally:
            out.close()
        at = self.path(name)
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf)
        keep = self.jvm.org.apache.hadoop.fs.Options.Rename.NONE
        options = self.jvm.java.lang.reflect.Array.newInstance(keep.getClass(), 1)
        options[0] = keep
        try:
            context.rename(context.makeQualified(staged), context.makeQualified(at), options)
        except Exception as e:
            self.fs.delete(staged, False)
            if self.fs.exists(at):
                raise Conflict(name) from e
            raise

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


def _latest(folder: _Folder) -> dict:
    names = folder.manifests()
    return folder.read(names[-1]) if names else {"version": 0, "parts": [], "last_id": 0, "schema": None}


def _put_next(folder: _Folder, last: dict, part: str, append: bool, schema: str, last_id: int) -> int:
    version = last["version"] + 1
    folder.put(f"manifest-{version:010d}.json", {"version": version, "parts": [*(last["parts"] if append else []), part], "last_id": last_id, "schema": schema})
    return version


def publish(rows: DataFrame, path: str, faults: Callable[[DataFrame], DataFrame] | None = None, append: bool = False, partition_by: tuple[str, ...] = (), rows_per_file: int = 0) -> int:
    """Write rows as a new version of the table below ``path`` and return its number.

    The rows are written beside what is published; ``faults`` is given them as they were written and returns violations (code,
    object_id); any stops the publication. Then a manifest that names the version's folders appears by a rename that fails if
    the name is taken. Before that moment readers see the version before, after it the new one; a job or driver lost in between
    leaves folders that no manifest names, which sweep() deletes. An append that meets another writer is tried again on top of
    it; a replacement raises Conflict.
    """
    spark = rows.sparkSession
    folder, part = _Folder(spark, path), f"data-{uuid.uuid4().hex}"
    writer = rows.write.option("maxRecordsPerFile", rows_per_file)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{folder.root}/{part}")
    if faults is not None:
        staged = spark.read.schema(rows.schema).parquet(f"{folder.root}/{part}")
        first = faults(staged).limit(1).collect()
        if first:
            folder.delete(part)
            raise ValueError(f"not published: {first[0]['code']} {first[0]['object_id']}")
    for attempt in range(TRIES):
        last = _latest(folder)
        try:
            return _put_next(folder, last, part, append, rows.schema.json(), last["last_id"])
        except Conflict:
            if not append or attempt == TRIES - 1:
                raise
    raise AssertionError


def append_numbered(rows: DataFrame, path: str, order: list[str], name: str = "id") -> int:
    """Append rows with ids that go on from the largest so far, in an order that names rows uniquely; returns the version.

    Rows are numbered by ranges and offsets, whatever their number. If another writer takes the ids first, the rows get others.
    """
    spark = rows.sparkSession
    folder = _Folder(spark, path)
    with_place = numbered(rows, [], order, "_place")
    for attempt in range(TRIES):
        last, part = _latest(folder), f"data-{uuid.uuid4().hex}"
        made = with_place.withColumn(name, F.col("_place") + F.lit(last["last_id"]).cast("long")).select(name, *rows.columns)
        made.write.parquet(f"{folder.root}/{part}")
        top = spark.read.schema(made.schema).parquet(f"{folder.root}/{part}").agg(F.max(name)).first()[0]
        try:
            return _put_next(folder, last, part, True, made.schema.json(), top or last["last_id"])
        except Conflict:
            folder.delete(part)
            if attempt == TRIES - 1:
                raise
    raise AssertionError


def read_published(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The table as last published, or as of a version."""
    from pyspark.sql.types import StructType

    folder = _Folder(spark, path)
    m = folder.read(f"manifest-{version:010d}.json") if version else _latest(folder)
    if not m["parts"]:
        raise FileNotFoundError(f"nothing is published below {path}")
    reader = spark.read.schema(StructType.fromJson(json.loads(m["schema"])))
    out = None
    for part in m["parts"]:  # each has its own base, so partition columns are read as such
        own = reader.parquet(f"{folder.root}/{part}")
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out


def sweep(spark: SparkSession, path: str, keep: int = 1, older_than_s: float = 86_400) -> list[str]:
    """Delete all but the last ``keep`` versions and folders that no kept manifest names, if they are older than a writer takes; returns their names."""
    folder = _Folder(spark, path)
    names = folder.manifests()
    kept = names[-keep:]
    needed = {p for n in kept for p in folder.read(n)["parts"]} | set(kept)
    now = folder.jvm.java.lang.System.currentTimeMillis()
    gone = []
    for status in folder.fs.listStatus(folder.jvm.org.apache.hadoop.fs.Path(folder.root)):
        name = status.getPath().getName()
        if name not in needed and not name.startswith(".") and (name in names or now - status.getModificationTime() >= older_than_s * 1000):
            folder.delete(name)
            gone.append(name)
    return gone


def write_dealt(rows: DataFrame, path: str, by: str, order: list[str], rows_per_file: int = 1_000_000, fmt: str = "csv") -> None:
    """Write a table with a folder for each value of ``by`` and at most ``rows_per_file`` rows a file, in order.

    Rows are dealt by ranges of ``by`` and ``order``, so a value that holds most rows is many tasks and files, and small values share
    tasks; a task of TASK_ROWS rows writes as many files as it takes. As CSV with a header, every cell quoted and quotes doubled, so that line ends and separators within cells come back.
    """
    n = rows.count()
    dealt = rows.repartitionByRange(max(1, -(-n // max(rows_per_file, TASK_ROWS))), by, *order).sortWithinPartitions(by, *order)
    writer = dealt.write.partitionBy(by).option("maxRecordsPerFile", rows_per_file).format(fmt)
    if fmt == "csv":
        writer = writer.options(header=True, quoteAll=True, escape='"', emptyValue="", nullValue="\\N", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    writer.save(path)


def read_dealt(spark: SparkSession, path: str, schema, fmt: str = "csv") -> DataFrame:
    """What write_dealt() wrote."""
    reader = spark.read.schema(schema).format(fmt)
    if fmt == "csv":
        reader = reader.options(header=True, multiLine=True, escape='"', emptyValue="", nullValue="\\N", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return reader.load(path)
