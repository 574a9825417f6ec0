"""Sorted lists of any length as long tables with ranks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.sources.scratch import written

#: Bits of a row's number within its partition, as monotonically_increasing_id gives it.
_ROW_BITS = 33


def ranked(df: DataFrame, order: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """The rows with their rank (from 1) in the order given, in each group or in all.

    Rows are sorted in ranges, one for each task, and written. A rank is the place in the range plus
    the rows of the ranges before it; only those counts, one for each range, meet in one task, and
    for groups their first ranks, one for each group. Rows that are equal in the order get ranks of
    their own in an order left open.
    """
    spark, keys = df.sparkSession, [*by, *order]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    place = F.monotonically_increasing_id()
    rows = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("_place", place)
    rows = written(rows).withColumn("_range", F.shiftright("_place", _ROW_BITS))
    counts = rows.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    counts = counts.select("_range", before.alias("_before"))
    number = F.col("_before") + F.col("_place").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)) + 1
    out = rows.join(counts, "_range").withColumn("rank", number)
    if by:
        firsts = out.groupBy(*by).agg(F.min("rank").alias("_first"))
        firsts = firsts.select(*[F.col(f"`{c}`").alias(f"_by_{i}") for i, c in enumerate(by)], "_first")
        same: Column = F.lit(True)
        for i, c in enumerate(by):
            same = same & F.col(f"`{c}`").eqNullSafe(F.col(f"_by_{i}"))
        out = out.join(firsts, same).withColumn("rank", F.col("rank") - F.col("_first") + 1)
    return out.select("rank", *[F.col(f"`{c}`") for c in df.columns])
