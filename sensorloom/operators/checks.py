"""Checks that count violations; `require` turns a violation into an error on the driver."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorloom.errors import DataCheckError
from sensorloom.functions.casts import nan_to_null


def repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, NULL being a value like any other."""
    return df.groupBy(*keys).count().where("count > 1")


def duplicate_key_stats(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All rows, repeated key groups, the largest group, and the rows in repeated groups."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.count_if(F.col("n") > 1).alias("duplicate_key_groups"),
        F.coalesce(F.max("n"), F.lit(0)).alias("max_group_size"),
        F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("duplicate_rows"),
    )


def repeated_row_count(df: DataFrame) -> DataFrame:
    """Rows equal to an earlier row."""
    copies = df.groupBy(*[F.col(f"`{c}`") for c in df.columns]).agg(F.count(F.lit(1)).alias("n"))
    return copies.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"))


def key_sample(df: DataFrame, keys: Sequence[str], n: int = 5) -> DataFrame:
    """The first offending keys with their counts, for an error message."""
    return repeated_keys(df, keys).orderBy(*keys).limit(n)


def nan_as_missing(df: DataFrame) -> DataFrame:
    """The table with NULL for NaN in its float columns, types kept."""
    kinds = {f.name: f.dataType for f in df.schema.fields if f.dataType.simpleString() in ("float", "double")}
    return df.withColumns({c: nan_to_null(F.col(f"`{c}`")).cast(t) for c, t in kinds.items()}) if kinds else df


def null_counts(df: DataFrame) -> DataFrame:
    """Missing cells (NULL or NaN), one row for each column, from a single pass over the table."""
    df = nan_as_missing(df)
    counts = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(f"n{i}") for i, c in enumerate(df.columns)])
    return counts.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("n_null"))
                    for i, c in enumerate(df.columns)
                ]
            )
        )
    )


def violations(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """For each named rule, how many rows break it; all rules share one pass."""
    counts = df.agg(*[F.count_if(rule).alias(f"n{i}") for i, rule in enumerate(rules.values())])
    return counts.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(name).alias("rule"), F.col(f"n{i}").alias("n_rows"))
                    for i, name in enumerate(rules)
                ]
            )
        )
    )


def require(checked: DataFrame, what: str) -> None:
    """Raise if any rule of a violations table counts rows. The table has one row for each rule."""
    broken = {r["rule"]: r["n_rows"] for r in checked.where("n_rows > 0").collect()}
    if broken:
        raise DataCheckError(f"{what}: {broken}")


def require_unique(df: DataFrame, keys: Sequence[str], what: str) -> None:
    stats = duplicate_key_stats(df, keys).first()
    if stats["duplicate_rows"]:
        sample = [r.asDict() for r in key_sample(df, keys).collect()]
        raise DataCheckError(f"{what}: {stats['duplicate_rows']} rows share keys {list(keys)}, such as {sample}")


def require_columns(df: DataFrame, columns: Sequence[str], what: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise DataCheckError(f"{what} lacks columns {missing}; it has {df.columns}")


def is_numeric(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.NumericType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def float_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]


def require_numeric(df: DataFrame, columns: Sequence[str], what: str) -> None:
    wrong = {c: df.schema[c].dataType.simpleString() for c in columns if not is_numeric(df, c)}
    if wrong:
        raise DataCheckError(f"{what} has columns that are not numeric: {wrong}")
