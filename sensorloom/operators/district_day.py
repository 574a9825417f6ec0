"""Readings to one row for each category, district and day."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.config import (
    AGGREGATION_FILE_KEYWORDS,
    CATEGORIES,
    CATEGORY,
    DATE,
    DISTRICT,
    DISTRICT_CODE,
    MEASUREMENT,
    STATION,
    STATION_COUNT,
    TIMESTAMP,
)
from sensorloom.errors import DataCheckError
from sensorloom.functions.casts import to_day
from sensorloom.functions.names import category_of
from sensorloom.operators.checks import violations

SUMMED = [c.name for c in CATEGORIES if c.aggregate == "sum"]


def by_method(category: Column, total: Column, mean: Column) -> Column:
    return F.when(category.isin(*SUMMED), total).otherwise(mean)


def valid_readings(df: DataFrame) -> DataFrame:
    """Readings with a value, so that every group that follows holds at least one."""
    return df.where(F.col(MEASUREMENT).isNotNull())


def union_files(frames: Sequence[DataFrame]) -> DataFrame:
    """Files of one category, aligned by column name; absent columns are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def with_file_category(df: DataFrame, file_name: str = "source_file") -> DataFrame:
    """Category of each row from the name of its file; NULL when no keyword fits."""
    return df.withColumn(CATEGORY, category_of(F.col(file_name), AGGREGATION_FILE_KEYWORDS, None))


def uncovered_categories(df: DataFrame, expected: Sequence[str] | None = None) -> DataFrame:
    """Expected categories no row belongs to."""
    names = list(expected or [c.name for c in CATEGORIES])
    wanted = df.sparkSession.createDataFrame([(n,) for n in names], f"{CATEGORY} string")
    return wanted.join(df.select(CATEGORY).distinct(), CATEGORY, "left_anti")


def require_categories(df: DataFrame) -> None:
    missing = sorted(r[0] for r in uncovered_categories(df).collect())
    if missing:
        raise DataCheckError(f"no rows for categories {missing}")


def reading_violations(df: DataFrame, text_time: str | None = None) -> DataFrame:
    """Rows without a district code and, for text timestamps, rows without a readable one."""
    rules = {"district code is missing": F.col(DISTRICT_CODE).isNull()}
    if text_time:
        rules["timestamp cannot be read"] = to_day(F.col(text_time)).isNull()
    return violations(df, rules)


def station_days(df: DataFrame) -> DataFrame:
    """Partial result for each station, day and label.

    All buffers are primitive, so this is a hash aggregate that shrinks the raw readings before
    they are shuffled, however many of them one district holds. The label is part of the key
    because a text buffer would make Spark sort the raw readings instead.
    """
    return (
        valid_readings(df)
        .groupBy(CATEGORY, DISTRICT_CODE, F.to_date(TIMESTAMP).alias(DATE), STATION, DISTRICT)
        .agg(
            F.sum(MEASUREMENT).alias("total"),
            F.count(F.lit(1)).alias("n"),
            F.min(TIMESTAMP).alias("first_seen"),
        )
    )


def district_day(df: DataFrame) -> DataFrame:
    """Sum of rainfall, mean of every other category, distinct stations, and the earliest label.

    The partial results are dealt by the final key, so the stations of a group are counted where
    the group is: grouping by station and then without it needs no further shuffle.
    """
    # min skips NULL, so a missing label never wins over a present one.
    label = F.when(F.col(DISTRICT).isNotNull(), F.struct("first_seen", STATION, DISTRICT))
    keys = (CATEGORY, DISTRICT_CODE, DATE)
    by_station = (
        station_days(df)
        .repartition(*keys)
        .groupBy(*keys, STATION)
        .agg(F.sum("total").alias("total"), F.sum("n").alias("n"), F.min(label).alias("label"))
    )
    return (
        by_station.groupBy(*keys)
        .agg(
            F.sum("total").alias("total"),
            F.sum("n").alias("n"),
            F.count(STATION).alias(STATION_COUNT),
            F.min("label").alias("label"),
        )
        .select(
            CATEGORY,
            DISTRICT_CODE,
            F.col("label").getField(DISTRICT).alias(DISTRICT),
            DATE,
            by_method(F.col(CATEGORY), F.col("total"), F.col("total") / F.col("n")).alias(MEASUREMENT),
            STATION_COUNT,
        )
    )


def sorted_for_people(df: DataFrame, *keys: str) -> DataFrame:
    """Ordered by key with NULL last; a range-partitioned sort, not one task."""
    return df.orderBy(*[F.col(k).asc_nulls_last() for k in keys])


def aggregate_violations(df: DataFrame) -> DataFrame:
    """Rules every district-day table must keep."""
    keys = [c for c in (CATEGORY, DISTRICT_CODE, DATE) if c in df.columns]
    rules = violations(
        df,
        {
            "station count is not positive": F.col(STATION_COUNT) <= 0,
            "district code is missing": F.col(DISTRICT_CODE).isNull(),
            "date is missing": F.col(DATE).isNull(),
        },
    )
    repeated = (
        df.groupBy(*keys)
        .count()
        .agg(F.coalesce(F.sum(F.when(F.col("count") > 1, F.col("count"))), F.lit(0)).alias("n_rows"))
        .select(F.lit("key is repeated").alias("rule"), "n_rows")
    )
    return rules.unionByName(repeated)


def aggregation_report(readings: DataFrame, aggregated: DataFrame) -> DataFrame:
    """One row for each category and one, without a category, for the total.

    The medians are over station counts: their few distinct values bound the buffer.
    """
    raw = readings.groupBy(CATEGORY).agg(
        F.count(F.lit(1)).alias("input_rows"),
        F.count_if(F.col(MEASUREMENT).isNull()).alias("missing_measurements"),
    )
    counts = aggregated.groupBy(CATEGORY).agg(
        F.count(F.lit(1)).alias("output_rows"),
        F.min(STATION_COUNT).alias("station_count_min"),
        F.max(STATION_COUNT).alias("station_count_max"),
        F.avg(STATION_COUNT).alias("station_count_mean"),
        F.percentile(STATION_COUNT, F.lit(0.5)).alias("station_count_median"),
        F.count_distinct(DISTRICT_CODE).alias("district_count"),
        F.min(DATE).alias("first_date"),
        F.max(DATE).alias("last_date"),
    )
    per_category = raw.join(counts, CATEGORY, "left").withColumn(
        "output_rows", F.coalesce("output_rows", F.lit(0))
    )
    sums = ("input_rows", "missing_measurements", "output_rows")
    total = per_category.agg(*[F.sum(c).alias(c) for c in sums])
    report = per_category.unionByName(total, allowMissingColumns=True)
    return report.withColumn(
        "compression_ratio", F.try_divide(F.col("input_rows"), F.col("output_rows"))
    )
