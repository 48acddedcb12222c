"""Row numbers within groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.plans.spill import written


def numbered(rows: DataFrame, groups: list[str], order: list[str], name: str = "n") -> DataFrame:
    """Adds the number of each row, from 1, in its group by ``order``, which names rows uniquely there.

    Rows are dealt by ranges of group and order, numbered in each range, and the counts of the ranges before are added, so a
    group that holds most rows is many tasks. Counts are one row per range and group.
    """
    dealt = written(rows.repartitionByRange(*groups, *order).withColumn("_range", F.spark_partition_id()))
    counts = dealt.groupBy(*groups, "_range").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(*groups).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    start = counts.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)], F.col("_range").alias("_r"), F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy(*groups, "_range").orderBy(*order))
    same = F.col("_range") == F.col("_r")
    for i, g in enumerate(groups):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    out = dealt.withColumn("_own", own).join(start.hint("merge"), same)
    return out.withColumn(name, (F.col("_before") + F.col("_own")).cast("long")).select(*rows.columns, name)
