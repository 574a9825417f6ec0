"""Checks of a feature table before it is used."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorloom.errors import DataCheckError
from sensorloom.functions.scalars import is_infinite
from sensorloom.operators.checks import float_columns, nan_as_missing, numeric_columns


def infinite_counts(df: DataFrame) -> DataFrame:
    """How many values of each numeric column are infinite. Only floats are scanned for it."""
    floats = set(float_columns(df))
    columns = numeric_columns(df)
    counts = df.agg(
        *[
            (F.count_if(is_infinite(F.col(f"`{c}`"))) if c in floats else F.lit(0).cast("bigint")).alias(f"n{i}")
            for i, c in enumerate(columns)
        ]
    )
    rows = [F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("n_infinite")) for i, c in enumerate(columns)]
    return counts.select(F.inline(F.array(*rows)))


def feature_table_report(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """One row: size, type families, repeated rows, columns with infinities or NULLs, verdict."""
    floats = set(float_columns(df))
    fields = df.schema.fields
    families = {
        "numeric_columns": sum(isinstance(f.dataType, T.NumericType) for f in fields),
        "text_columns": sum(isinstance(f.dataType, T.StringType) for f in fields),
        "date_columns": sum(isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)) for f in fields),
    }
    missing = [c for c in required if c not in df.columns]
    # Copies are folded first, and every figure is read off the folded rows: one pass, one shuffle.
    df = nan_as_missing(df)
    folded = df.groupBy(*[F.col(f"`{c}`") for c in df.columns]).agg(F.count(F.lit(1)).alias("_copies"))
    flags = folded.agg(
        F.coalesce(F.sum("_copies"), F.lit(0)).alias("total_rows"),
        F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0)).alias("duplicate_rows"),
        *[F.count_if(F.col(f"`{f.name}`").isNull()).alias(f"null{i}") for i, f in enumerate(fields)],
        *[F.count_if(is_infinite(F.col(f"`{f.name}`"))).alias(f"inf{i}") for i, f in enumerate(fields) if f.name in floats],
    )
    zero = F.lit(0)
    with_nulls = sum([(F.col(f"null{i}") > 0).cast("int") for i in range(len(fields))], zero)
    with_inf = sum([(F.col(f"inf{i}") > 0).cast("int") for i, f in enumerate(fields) if f.name in floats], zero)
    return flags.select(
        "total_rows",
        F.lit(len(fields)).alias("total_columns"),
        *[F.lit(n).alias(name) for name, n in families.items()],
        F.lit(len(missing)).alias("missing_required_columns"),
        with_inf.alias("columns_with_infinities"),
        with_nulls.alias("columns_with_nulls"),
        "duplicate_rows",
        (F.lit(not missing) & (F.col("duplicate_rows") == 0) & (with_inf == 0)).alias("is_valid"),
    )


def require_valid_features(df: DataFrame, required: Sequence[str]) -> None:
    """Strict mode: missing columns, copies and infinities raise."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise DataCheckError(f"feature table lacks columns {missing}")
    report = feature_table_report(df, required).first()
    if not report["is_valid"]:
        infinite = {r["column"]: r["n_infinite"] for r in infinite_counts(df).where("n_infinite > 0").collect()}
        raise DataCheckError(
            f"feature table has {report['duplicate_rows']} repeated rows and infinities in {infinite}"
        )
