"""Joins whose strategy follows from the measured size of a side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.plans.spill import written

#: Bytes of a table that may be broadcast.
BROADCAST_BYTES = 16 << 20


def _bytes(name: str, kind: T.DataType) -> Column:
    """Bytes of a value beyond its eight: a bound of what a hash table holds."""
    c = F.col(f"`{name}`")
    if isinstance(kind, (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType, T.NullType)):
        return F.lit(0)
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0))
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.NumericType, T.BooleanType)):
        return 8 * F.coalesce(F.size(c), F.lit(0))
    # The text of a nested value has its names too; eight bytes a character cover numbers and offsets.
    return 8 * F.coalesce(F.octet_length(F.to_json(F.struct(c.alias("v")))), F.lit(0))


def table_bytes(df: DataFrame) -> int:
    """Bytes of a table's rows as a hash table holds them: 48 a row, 8 a column, and what texts, arrays and nested values hold.
    Reads the table; give it one that is written, or small in what it is made of."""
    per_row = F.lit(48 + 8 * len(df.columns))
    for f in df.schema:
        per_row = per_row + _bytes(f.name, f.dataType)
    return df.agg(F.sum(per_row.cast("long"))).first()[0] or 0


def join_checked(left: DataFrame, right: DataFrame, on, how: str = "inner", most: int = BROADCAST_BYTES) -> DataFrame:
    """Join a written table: broadcast if its bytes are proven few, so that ``left`` is not shuffled; else by sort-merge, whose hot
    keys AQE splits."""
    return left.join(right.hint("broadcast" if table_bytes(right) <= most else "merge"), on, how)


def join_written(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """join_checked() with a table that is not written yet: it is made once, measured and read back."""
    return join_checked(left, written(right), on, how)


def small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """A catalog to be broadcast, if its bytes are proven few; else as it is, and Spark joins it without. Measured by one more reading, so it
    is written or cheap to make."""
    return df.hint("broadcast") if table_bytes(df) <= most else df
