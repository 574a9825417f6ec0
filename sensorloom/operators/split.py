"""Chronological splits at dates shared by all groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.config import (
    CONTINUITY_WARN_GAP_DAYS,
    DATE,
    DISTRICT_CODE,
    SPARSE_GROUP_ROWS,
    SPLIT,
    TARGET,
    SplitShares,
)
from sensorloom.errors import DataCheckError
from sensorloom.operators.target import valid_targets


def continuity(df: DataFrame, group: str = DISTRICT_CODE, date: str = DATE) -> DataFrame:
    """First and last date, distinct dates and largest gap of each group.

    Rows are first reduced to distinct days, so a group's window holds one row a calendar day.
    """
    days = df.select(group, F.to_date(date).alias("day")).where("day IS NOT NULL").distinct()
    gap = F.datediff("day", F.lag("day").over(Window.partitionBy(group).orderBy("day")))
    return (
        days.withColumn("gap", gap)
        .groupBy(group)
        .agg(
            F.min("day").alias("min_date"),
            F.max("day").alias("max_date"),
            F.count(F.lit(1)).alias("n_dates"),
            F.max("gap").alias("max_gap_days"),
        )
        .withColumn("large_gap", F.coalesce(F.col("max_gap_days") > CONTINUITY_WARN_GAP_DAYS, F.lit(False)))
    )


def check_continuity(stats: DataFrame, group: str = DISTRICT_CODE) -> None:
    short = [r[0] for r in stats.where("n_dates < 2").select(group).limit(5).collect()]
    if short:
        raise DataCheckError(f"groups with fewer than 2 dates, such as {short}")


def cut_dates(df: DataFrame, shares: SplitShares, date: str = DATE, target: str = TARGET) -> DataFrame:
    """One row: distinct target-bearing dates and the last date of train and of validation.

    The single unpartitioned window runs over distinct days only: 36,525 rows a century.
    """
    days = valid_targets(df, target).select(F.to_date(date).alias("day")).distinct()
    everything = Window.partitionBy(F.lit(0))
    numbered = days.select(
        "day",
        F.row_number().over(everything.orderBy("day")).alias("i"),
        F.count(F.lit(1)).over(everything).alias("n"),
    )
    n = F.col("n")
    train = F.greatest(F.lit(1), F.least(F.floor(n * F.lit(shares.train)), n - 2))
    validation = F.greatest(
        train + 1, F.least(F.floor(n * F.lit(shares.train + shares.validation)), n - 1)
    )
    return numbered.agg(
        F.count(F.lit(1)).alias("n_dates"),
        F.max(F.when(F.col("i") == train, F.col("day"))).alias("train_end"),
        F.max(F.when(F.col("i") == validation, F.col("day"))).alias("validation_end"),
    )


def with_split(
    df: DataFrame, shares: SplitShares = SplitShares(), date: str = DATE, target: str = TARGET
) -> DataFrame:
    """Rows with a target, each marked train, validation or test by its date.

    The cut dates are one scalar subquery: two values, found once, used by every task. The rows
    are read twice, for the dates and for the result, so they should come from a written table.
    """
    cuts = cut_dates(df, shares, date, target)
    ends = cuts.select(F.struct("train_end", "validation_end")).scalar()
    day = F.to_date(date)
    return valid_targets(df, target).withColumn(
        SPLIT,
        F.when(day <= ends.getField("train_end"), "train")
        .when(day <= ends.getField("validation_end"), "validation")
        .otherwise("test"),
    )


def check_cuts(cuts: DataFrame) -> None:
    n = cuts.first()["n_dates"]
    if n < 3:
        raise DataCheckError(f"only {n} dates carry a target; three splits need at least 3")


def split_report(split: DataFrame, date: str = DATE) -> DataFrame:
    return split.groupBy(SPLIT).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min(F.to_date(date)).alias("first_date"),
        F.max(F.to_date(date)).alias("last_date"),
    )


def sparse_train_groups(
    split: DataFrame, group: str = DISTRICT_CODE, fewer_than: int = SPARSE_GROUP_ROWS
) -> DataFrame:
    train = split.where(F.col(SPLIT) == "train")
    return train.groupBy(group).agg(F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") < fewer_than)
