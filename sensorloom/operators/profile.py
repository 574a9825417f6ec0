"""Profiles: what each column of a table holds."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.functions.scalars import half_even
from sensorloom.operators.checks import nan_as_missing, numeric_columns
from sensorloom.operators.clean import col
from sensorloom.operators.quantiles import exact_quantiles


#: Types whose values are counted as whole numbers, and how.
_WHOLE = {
    "boolean": "cast({} as bigint)",
    "date": "cast(unix_date({}) as bigint)",
    "timestamp": "unix_micros({})",
    **{t: "cast({} as bigint)" for t in ("tinyint", "smallint", "int", "bigint")},
}


def _kind(df: DataFrame, column: str) -> str:
    """The type as which values of the column are counted."""
    name = df.schema[column].dataType.simpleString()
    return "bigint" if name in _WHOLE else {"float": "double"}.get(name, name if name in ("double", "timestamp_ntz") else "string")


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, n_distinct) of every column that holds a value, exact.

    Columns are counted in groups by type, so a cell is a pair of two numbers unless it is text.
    Values are counted before the shuffle and spread over (column, value): neither a column with many
    values nor one frequent value lands in a single task.
    """
    parts = []
    for kind in ("bigint", "double", "timestamp_ntz", "string"):
        names = [c for c in columns if _kind(df, c) == kind]
        if not names:
            continue
        pairs = []
        for c in names:
            quoted, name = f"`{c}`", df.schema[c].dataType.simpleString()
            value = F.expr(_WHOLE[name].format(quoted)) if name in _WHOLE else col(c).cast(kind)
            pairs.append(F.struct(F.lit(columns.index(c)).alias("c"), value.alias("value")))
        cells = df.select(F.inline(F.array(*pairs))).where("value IS NOT NULL")
        parts.append(cells.groupBy("c", "value").agg(F.lit(1)).groupBy("c").agg(F.count(F.lit(1)).alias("n_distinct")))
    names = F.array(*[F.lit(c) for c in columns])
    return reduce(DataFrame.unionByName, parts).select(F.get(names, F.col("c")).alias("column"), "n_distinct")


def text_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value as text, n) for every distinct value of the columns."""
    pairs = [F.struct(F.lit(c).alias("column"), col(c).cast("string").alias("value")) for c in columns]
    cells = df.select(F.inline(F.array(*pairs))).where("value IS NOT NULL")
    return cells.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def _by_column(df: DataFrame, metrics: dict[str, dict[str, Column]], types: dict[str, str]) -> DataFrame:
    """Run all metrics of all columns in one aggregate and return one row for each column."""
    columns = list(metrics)
    flat = [
        expr.cast(types[m]).alias(f"m{i}_{m}")
        for i, c in enumerate(columns)
        for m, expr in metrics[c].items()
    ]
    rows = [
        F.struct(
            F.lit(c).alias("column"),
            *[
                (F.col(f"m{i}_{m}") if m in metrics[c] else F.lit(None)).cast(t).alias(m)
                for m, t in types.items()
            ],
        )
        for i, c in enumerate(columns)
    ]
    return df.agg(*flat).select(F.inline(F.array(*rows)))


def column_profile(df: DataFrame) -> DataFrame:
    """Type, missing values, exact distinct values and, for numbers, range, mean and spread.

    NaN is missing, as NULL is.
    """
    df = nan_as_missing(df)
    numeric = set(numeric_columns(df))
    types = {
        "n_rows": "bigint",
        "n_missing": "bigint",
        "minimum": "double",
        "maximum": "double",
        "mean": "double",
        "std": "double",
        "n_values": "bigint",
    }
    metrics: dict[str, dict[str, Column]] = {}
    for c in df.columns:
        metrics[c] = {"n_rows": F.count(F.lit(1)), "n_missing": F.count_if(col(c).isNull())}
        if c in numeric:
            metrics[c] |= {
                "minimum": F.min(col(c)),
                "maximum": F.max(col(c)),
                "mean": F.avg(col(c)),
                "std": F.stddev_samp(col(c)),
                "n_values": F.count(col(c)),
            }
    stats = _by_column(df, metrics, types)
    distinct = distinct_counts(df, df.columns)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    kind = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])
    # A single value has no sample spread; the profile calls that 0.
    std = F.when(F.col("n_values") == 1, F.lit(0.0)).otherwise(F.col("std"))
    share = F.try_divide(F.col("n_missing") * 100, F.col("n_rows"))
    return stats.join(distinct, "column", "left").select(
        "column",
        kind[F.col("column")].alias("data_type"),
        "n_missing",
        half_even(F.coalesce(share, F.lit(0.0)), 2).alias("missing_percent"),
        F.coalesce("n_distinct", F.lit(0)).alias("n_distinct"),
        "minimum",
        "maximum",
        half_even(F.col("mean"), 4).alias("mean"),
        half_even(std, 4).alias("std"),
        F.when(F.col("n_values") > 0, F.col("n_values")).alias("n_values"),
    )


def describe_all(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Count, distinct, most frequent value, mean, spread, range and exact quartiles of each column.

    Text columns have the first three, numeric columns the others. Between equally frequent values
    the smallest wins.
    """
    df = nan_as_missing(df)
    columns = list(columns or df.columns)
    numeric = [c for c in numeric_columns(df) if c in columns]
    text = [c for c in columns if c not in numeric]
    types = {"count": "bigint", "mean": "double", "std": "double", "min": "double", "max": "double"}
    metrics = {c: {"count": F.count(col(c))} for c in columns}
    for c in numeric:
        metrics[c] |= {
            "mean": F.avg(col(c)),
            "std": F.stddev_samp(col(c)),
            "min": F.min(col(c)),
            "max": F.max(col(c)),
        }
    out = _by_column(df, metrics, types)
    quartiles = exact_quantiles(df, numeric, (0.25, 0.5, 0.75))
    for j, name in enumerate(("p25", "p50", "p75")):
        value = F.lit(None).cast("double")
        for c in numeric:
            value = F.when(F.col("column") == c, F.lit(quartiles[c][j]).cast("double")).otherwise(value)
        out = out.withColumn(name, value)
    if not text:
        return out.withColumns(
            {"unique": F.lit(None).cast("bigint"), "top": F.lit(None).cast("string"), "freq": F.lit(None).cast("bigint")}
        )
    top = (
        text_counts(df, text)
        .groupBy("column")
        .agg(
            F.count(F.lit(1)).alias("unique"),
            F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("top"),
            F.max("n").alias("freq"),
        )
    )
    return out.join(top, "column", "left")
