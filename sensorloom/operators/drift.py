"""Schemas compared inside each category, against the alphabetically first data set."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sensorloom.functions.casts import to_number

NUMERIC_TYPES = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal(38,0)")


def schema_relation(spark: SparkSession, frames: Mapping[tuple[str, str], DataFrame]) -> DataFrame:
    """One row for each column of each (category, data set). Reads schemas only."""
    rows = [
        (category, dataset, f.name, f.dataType.simpleString(), i)
        for (category, dataset), df in frames.items()
        for i, f in enumerate(df.schema.fields)
    ]
    return spark.createDataFrame(
        rows, "category string, dataset string, column string, data_type string, position int"
    )


def observed_schema(cells: DataFrame) -> DataFrame:
    """Types read off the text itself: whole numbers, numbers or text, for each file and column.

    Takes (category, dataset, column, position, value) rows; all counts are combined before the
    shuffle. A column without values counts as numeric, as a CSV reader would have it.
    """
    whole = F.col("value").rlike(r"^[+-]?[0-9]+$")
    counts = cells.groupBy("category", "dataset", "column").agg(
        F.min("position").alias("position"),
        F.count(F.lit(1)).alias("n"),
        F.count("value").alias("n_values"),
        F.count_if(whole).alias("n_whole"),
        F.count(to_number(F.col("value"))).alias("n_numbers"),
    )
    # Whole numbers beside missing cells are read as floats.
    kind = (
        F.when((F.col("n_whole") == F.col("n")), "bigint")
        .when(F.col("n_numbers") == F.col("n_values"), "double")
        .otherwise("string")
    )
    return counts.select("category", "dataset", "column", kind.alias("data_type"), "position")


def _issues(schemas: DataFrame) -> DataFrame:
    """(category, dataset, issues): every data set beside its category's first one, as arrays.

    An array holds the columns of one file. The relation is read once and joined with nothing.
    """
    by_file = schemas.groupBy("category", "dataset").agg(
        F.sort_array(F.collect_list(F.struct("position", "column", "data_type"))).alias("found")
    )
    first = F.first("found").over(Window.partitionBy("category").orderBy("dataset"))
    both = by_file.withColumn("base", first).withColumns(
        {
            "names": F.transform("found", lambda x: x["column"]),
            "base_names": F.transform("base", lambda x: x["column"]),
        }
    )

    def issue(column: Column, text: Column, severity: Column) -> Column:
        return F.struct(column.alias("column"), text.alias("issue"), severity.alias("severity"))

    def one_sided(rows: str, others: str, text: str) -> Column:
        absent = F.filter(rows, lambda name: ~F.array_contains(F.col(others), name))
        return F.transform(absent, lambda name: issue(name, F.lit(text), F.lit("error")))

    def base_type(x: Column) -> Column:
        return F.get(F.filter("base", lambda b: b["column"] == x["column"]), F.lit(0))["data_type"]

    def retyped(x: Column) -> Column:
        numeric = base_type(x).isin(*NUMERIC_TYPES) & x["data_type"].isin(*NUMERIC_TYPES)
        text = F.when(numeric, "compatible numeric type").otherwise("type mismatch")
        return issue(x["column"], text, F.when(numeric, "warning").otherwise("error"))

    # Common columns are out of order if their baseline order differs from their own.
    own_order = F.filter("names", lambda name: F.array_contains(F.col("base_names"), name))
    base_order = F.filter("base_names", lambda name: F.array_contains(F.col("names"), name))
    nothing = F.filter(F.array(issue(F.lit(None).cast("string"), F.lit(""), F.lit(""))), lambda _: F.lit(False))
    order = F.array(issue(F.lit(None).cast("string"), F.lit("column order"), F.lit("warning")))
    return both.select(
        "category",
        "dataset",
        F.concat(
            one_sided("base_names", "names", "missing column"),
            one_sided("names", "base_names", "unexpected column"),
            F.transform(F.filter("found", lambda x: base_type(x) != x["data_type"]), retyped),
            F.when(own_order != base_order, order).otherwise(nothing),
        ).alias("issues"),
    )


def schema_issues(schemas: DataFrame) -> DataFrame:
    """Missing, unexpected, retyped and reordered columns, as errors or warnings."""
    return _issues(schemas).select("category", "dataset", F.inline("issues"))


def drift_status(schemas: DataFrame) -> DataFrame:
    """Errors, warnings and a verdict for each data set."""

    def count(severity: str) -> Column:
        return F.size(F.filter("issues", lambda x: x["severity"] == severity)).cast("bigint")

    counts = _issues(schemas).select("category", "dataset", count("error").alias("n_errors"), count("warning").alias("n_warnings"))
    verdict = F.when(F.col("n_errors") > 0, "FAIL").when(F.col("n_warnings") > 0, "PASS WITH WARNINGS").otherwise("PASS")
    return counts.withColumn("status", verdict)


def overall_status(status: DataFrame) -> DataFrame:
    sums = status.agg(
        F.count(F.lit(1)).alias("n_datasets"),
        F.sum("n_errors").alias("n_errors"),
        F.sum("n_warnings").alias("n_warnings"),
    )
    return sums.withColumn(
        "status",
        F.when(F.col("n_errors") > 0, "FAIL")
        .when(F.col("n_warnings") > 0, "PASS WITH WARNINGS")
        .otherwise("PASS"),
    )
