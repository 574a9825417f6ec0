"""Data-quality audit of cleaned tables, for one or many data sets at once."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.config import (
    FAIL_DUPLICATE_SHARE,
    FAIL_MISSING_SHARE,
    WARN_DUPLICATE_SHARE,
    WARN_MISSING_SHARE,
)
from sensorloom.functions.casts import to_moment, to_number
from sensorloom.functions.names import find_audit_role
from sensorloom.operators.checks import nan_as_missing
from sensorloom.operators.clean import col
from sensorloom.operators.ranking import ranked


def _moment(df: DataFrame, column: str) -> Column:
    return to_moment(col(column), day_first=False) if dict(df.dtypes)[column] == "string" else col(column)


def _number(df: DataFrame, column: str) -> Column:
    return to_number(col(column)) if dict(df.dtypes)[column] == "string" else col(column).cast("double")


def _role_columns(df: DataFrame) -> dict[str, Column]:
    """Column of each role, NULL where the role is absent."""
    found = {r: find_audit_role(df.columns, r) for r in ("timestamp", "latitude", "longitude", "station", "district")}
    readers = {"timestamp": _moment, "latitude": _number, "longitude": _number}
    types = {"timestamp": "timestamp_ntz", "latitude": "double", "longitude": "double"}
    out = {}
    for role, c in found.items():
        kind = types.get(role, "string")
        if c is None:
            out[role] = F.lit(None).cast(kind)
        elif role in readers:
            out[role] = readers[role](df, c).cast(kind)
        elif role == "district":
            out[role] = F.btrim(col(c).cast("string"))
        else:
            out[role] = col(c).cast("string")
    return out


def time_range(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    c = _role_columns(df)["timestamp"]
    return df.groupBy(*by).agg(F.min(c).alias("earliest"), F.max(c).alias("latest"))


def coordinate_ranges(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    roles = _role_columns(df)
    return df.groupBy(*by).agg(
        *[
            how(roles[role]).alias(f"{role}_{name}")
            for role in ("latitude", "longitude")
            for name, how in (("min", F.min), ("max", F.max))
        ]
    )


def distinct_in_role(df: DataFrame, role: str, by: Sequence[str] = ()) -> DataFrame:
    """Exact distinct values of a role; NULL if the table has no such column."""
    absent = find_audit_role(df.columns, role) is None
    counted = F.count_distinct(_role_columns(df)[role])
    found = df.groupBy(*by).agg(counted.alias("n_distinct"))
    return found.withColumn("n_distinct", F.lit(None).cast("bigint")) if absent else found


def district_list(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sorted distinct district names as a long table (rank, the by columns, district).

    Names are made distinct across the cluster and ranked by ranges, so they may be any number.
    """
    if find_audit_role(df.columns, "district") is None:
        return df.select(F.lit(0).cast("bigint").alias("rank"), *by, F.lit("").alias("district")).limit(0)
    names = df.select(*by, _role_columns(df)["district"].alias("district")).where("district IS NOT NULL").distinct()
    return ranked(names, ["district"], by)


def name_present(df: DataFrame, name: str, by: Sequence[str] = ()) -> DataFrame:
    """Whether a district holds the given name, in any case of letters; NULL if there is no such column."""
    district = _role_columns(df)["district"]
    held = F.coalesce(F.bool_or(F.lower(district).contains(name.lower())), F.lit(False))
    absent = find_audit_role(df.columns, "district") is None
    return df.groupBy(*by).agg((F.lit(None).cast("boolean") if absent else held).alias("name_present"))


def audit_status(rows: Column, cells: Column, missing: Column, duplicates: Column) -> Column:
    missing_share = F.coalesce(F.try_divide(missing, cells), F.lit(0.0))
    duplicate_share = F.coalesce(F.try_divide(duplicates, rows), F.lit(0.0))
    return (
        F.when(rows == 0, "FAIL")
        .when((missing_share >= FAIL_MISSING_SHARE) | (duplicate_share >= FAIL_DUPLICATE_SHARE), "FAIL")
        .when((missing_share >= WARN_MISSING_SHARE) | (duplicate_share >= WARN_DUPLICATE_SHARE), "WARNING")
        .otherwise("PASS")
    )


def audit_report(df: DataFrame, dataset: str, name: str | None = None) -> DataFrame:
    """One row: size, types, missing and repeated rows, ranges, stations, districts, verdict.

    Copies are folded first; every other figure is then weighted by how often a row occurs, so the
    table is read and shuffled once. With a name given, the report says whether a district holds
    it. The names themselves are a table of their own (district_list), whatever their number.
    """
    df = nan_as_missing(df)
    columns = df.columns
    folded = df.groupBy(*[col(c) for c in columns]).agg(F.count(F.lit(1)).alias("_copies"))
    roles = _role_columns(df)
    has_station = find_audit_role(columns, "station") is not None
    has_district = find_audit_role(columns, "district") is not None
    missing = [F.sum(F.when(col(c).isNull(), F.col("_copies")).otherwise(0)) for c in columns]
    held = F.bool_or(F.lower(roles["district"]).contains((name or "").lower()))
    stats = folded.agg(
        F.coalesce(F.sum("_copies"), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0)).alias("duplicate_rows"),
        F.min(roles["timestamp"]).alias("earliest"),
        F.max(roles["timestamp"]).alias("latest"),
        F.min(roles["latitude"]).alias("latitude_min"),
        F.max(roles["latitude"]).alias("latitude_max"),
        F.min(roles["longitude"]).alias("longitude_min"),
        F.max(roles["longitude"]).alias("longitude_max"),
        F.count_distinct(roles["station"]).alias("_stations"),
        F.count_distinct(roles["district"]).alias("_districts"),
        held.alias("_held"),
        *[F.coalesce(m, F.lit(0)).alias(f"_m{i}") for i, m in enumerate(missing)],
    )
    total = reduce(Column.__add__, [F.col(f"_m{i}") for i in range(len(columns))])
    by_column = F.map_from_arrays(
        F.array(*[F.lit(c) for c in columns]), F.array(*[F.col(f"_m{i}") for i in range(len(columns))])
    )
    cells = F.col("n_rows") * len(columns)
    return stats.select(
        F.lit(dataset).alias("dataset_name"),
        "n_rows",
        F.lit(len(columns)).alias("n_columns"),
        F.array(*[F.lit(c) for c in columns]).alias("column_names"),
        F.array(*[F.lit(t) for _, t in df.dtypes]).alias("column_types"),
        by_column.alias("missing_by_column"),
        total.alias("total_missing"),
        "duplicate_rows",
        "earliest",
        "latest",
        "latitude_min",
        "latitude_max",
        "longitude_min",
        "longitude_max",
        F.when(F.lit(has_station), F.col("_stations")).alias("n_stations"),
        F.when(F.lit(has_district), F.col("_districts").cast("int")).alias("n_districts"),
        F.when(F.lit(has_district and name is not None), F.coalesce("_held", F.lit(False))).alias("name_present"),
        audit_status(F.col("n_rows"), cells, total, F.col("duplicate_rows")).alias("status"),
    )
