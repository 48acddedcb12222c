"""What several operators share: words, scratch tables, joins behind a size check, components."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.plans.spill import scratch_path

#: A word: what stands between the ASCII white space characters.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
UPPER_TO_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Bytes of a table that may be broadcast.
BROADCAST_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


#: Paths of the work tables that the stages of a pipeline have written so far, and whether a stage is at work.
_stage_tables: list[str] = []
_in_stage = False


def scratch(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends here, so a lost executor costs one read."""
    path = scratch_path(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.work_path = path
    if _in_stage:
        _stage_tables.append(path)
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def drop(*tables: DataFrame) -> None:
    """Delete work tables that no frame in use reads any more."""
    for t in tables:
        _delete(t.sparkSession, t.work_path)
        if t.work_path in _stage_tables:
            _stage_tables.remove(t.work_path)


@contextmanager
def stage_of(docs: DataFrame, first: bool = False, last: bool = False) -> Iterator[None]:
    """Work tables written inside belong to a stage of a pipeline; they go when the next stage begins.

    A stage is given what its predecessor's result was written to, so nothing of the predecessor's work is read again; tables
    that ``docs`` does read stay. The ``first`` stage of a pipeline leaves what earlier pipelines have written alone, and what
    the ``last`` one has written belongs to its result.
    """
    global _stage_tables, _in_stage
    if _stage_tables and not first:
        read = {part for f in docs.inputFiles() for part in f.rsplit("/", 2)[-2:]}
        kept = [p for p in _stage_tables if p.rsplit("/", 1)[-1] in read]
        for path in set(_stage_tables) - set(kept):
            _delete(docs.sparkSession, path)
        _stage_tables = kept
    elif first:
        _stage_tables = []
    _in_stage = True
    try:
        yield
    finally:
        _in_stage = False
        if last:
            _stage_tables = []


def table_bytes(df: DataFrame) -> int:
    """Bytes of a written table's rows as a hash table holds them: 48 a row and 8 a column, and what texts and arrays hold."""
    per_row = F.lit(48 + 8 * len(df.columns))
    for f in df.schema:
        kind, c = f.dataType, F.col(f"`{f.name}`")
        if isinstance(kind, (T.StringType, T.BinaryType)):
            per_row = per_row + F.coalesce(F.octet_length(c), F.lit(0))
        elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.NumericType, T.BooleanType)):
            per_row = per_row + 8 * F.coalesce(F.size(c), F.lit(0))
        elif not isinstance(kind, (T.NumericType, T.BooleanType)):
            raise TypeError(f"{f.name}: no bound for the size of {kind.simpleString()}")
    return df.agg(F.sum(per_row.cast("long"))).first()[0] or 0


def join_checked(left: DataFrame, right: DataFrame, on, how: str = "inner", most: int = BROADCAST_BYTES) -> DataFrame:
    """Join a written table: broadcast if its bytes are proven few, else by sort-merge, whose hot keys AQE splits."""
    return left.join(right.hint("broadcast" if table_bytes(right) <= most else "merge"), on, how)


def without_lines(df: DataFrame, text: Column, places: Column) -> DataFrame:
    """df with ``cleaned``: the text without the lines at these places (from 0; null: none). Linear in lines, as sets of integers
    are; ``_lines`` is a column of its own, used twice, so that no optimizer rule moves the split into the lambda."""
    df = df.withColumn("_lines", F.when(places.isNotNull(), F.split(text, "\n")))
    stay = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), places)
    cleaned = F.array_join(F.transform(stay, lambda i: F.get("_lines", i)), "\n")
    return df.withColumn("cleaned", F.when(places.isNull(), text).otherwise(cleaned))


def components(nodes_edges: DataFrame, src: str = "a", dst: str = "b", max_rounds: int = 60) -> DataFrame:
    """Connected components of an edge table: (node, component), component the smallest node reachable.

    Alternates two steps until nothing changes: every node links its larger neighbours to its smallest neighbour, then
    its smaller-or-equal ones. A step is an aggregation by node, written, and a join with it, whose hubs AQE can split so;
    nothing but a change count reaches the driver. Nodes without an edge do not occur.
    """
    spark = nodes_edges.sparkSession
    edges = scratch(
        nodes_edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).where("u <> v").distinct()
    )
    for _ in range(max_rounds):
        # Large star: each node's larger neighbours go to the smallest of the node and its neighbours.
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = scratch(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = scratch(
            join_checked(both.where("v > u"), low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        )
        drop(low)
        # Small star: a node's smaller neighbours and itself go to the smallest of them.
        low = scratch(large.groupBy("u").agg(F.min("v").alias("m")))
        small = (
            join_checked(large, low, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        new = scratch(small)
        same = [x.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first() for x in (edges, new)]
        drop(edges, large, low)
        edges = new
        if same[0] == same[1]:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    pairs = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return pairs.union(edges.select(F.col("v"), F.col("v")).distinct())
