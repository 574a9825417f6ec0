"""Checks of prepared splits before models are trained on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.errors import DataCheckError
from sensorloom.functions.casts import nan_to_null
from sensorloom.operators.checks import float_columns
from sensorloom.operators.clean import col


def features_and_target(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """Features in the order given, then the target; no list means every other column."""
    if target not in df.columns:
        raise DataCheckError(f"target '{target}' is missing")
    features = list(features) or [c for c in df.columns if c != target]
    if not features:
        raise DataCheckError("no feature columns are left beside the target")
    missing = [c for c in features if c not in df.columns]
    if missing:
        raise DataCheckError(f"features {missing} are missing")
    return df.select(*[col(c) for c in features], col(target))


def constant_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns with at most one distinct value, NULL counting as one.

    A column is constant exactly if its smallest value is its largest, which takes one pass and
    no distinct counting.
    """
    floats = set(float_columns(df))
    value = {c: nan_to_null(col(c)) if c in floats else col(c) for c in columns}
    row = df.agg(
        *[F.min(value[c]).cast("string").alias(f"lo{i}") for i, c in enumerate(columns)],
        *[F.max(value[c]).cast("string").alias(f"hi{i}") for i, c in enumerate(columns)],
        *[F.count(value[c]).alias(f"n{i}") for i, c in enumerate(columns)],
        F.count(F.lit(1)).alias("n"),
    )
    spread = [
        F.struct(
            F.lit(c).alias("column"),
            (
                F.when(F.col(f"n{i}") == 0, 0).when(F.col(f"lo{i}") == F.col(f"hi{i}"), 1).otherwise(2)
                + (F.col(f"n{i}") < F.col("n")).cast("int")
            ).alias("at_least"),
        )
        for i, c in enumerate(columns)
    ]
    return row.select(F.inline(F.array(*spread))).where("at_least <= 1").select("column")


def split_nulls(split: DataFrame, columns: Sequence[str], by: str = "split") -> DataFrame:
    """Rows and missing values of each column in each split, in long form, from one pass."""
    floats = set(float_columns(split))
    counts = split.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[
            F.count_if((nan_to_null(col(c)) if c in floats else col(c)).isNull()).alias(f"n{i}")
            for i, c in enumerate(columns)
        ],
    )
    rows = [F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("n_null")) for i, c in enumerate(columns)]
    return counts.select(by, "n_rows", F.inline(F.array(*rows)))


def check_split_schema(df: DataFrame, name: str, target: str, features: Sequence[str]) -> None:
    """Not empty, target present and never NULL, features present and in order, no repeated name."""
    if df.isEmpty():
        raise DataCheckError(f"split '{name}' holds no rows")
    if len({c.lower() for c in df.columns}) < len(df.columns):
        raise DataCheckError(f"split '{name}' repeats column names")
    if target not in df.columns:
        raise DataCheckError(f"split '{name}' lacks the target '{target}'")
    if not df.where(nan_to_null(col(target).cast("double")).isNull()).isEmpty():
        raise DataCheckError(f"split '{name}' has rows without a target")
    missing = [c for c in features if c not in df.columns]
    if missing:
        raise DataCheckError(f"split '{name}' lacks features {missing[:5]}")
    if [c for c in df.columns if c != target] != list(features):
        raise DataCheckError(f"split '{name}' has its features in another order")


def check_same_schema(train: DataFrame, validation: DataFrame) -> None:
    """Names, types and order of the two splits agree."""
    if set(train.columns) != set(validation.columns):
        raise DataCheckError(
            f"only in train: {sorted(set(train.columns) - set(validation.columns))}; "
            f"only in validation: {sorted(set(validation.columns) - set(train.columns))}"
        )
    types, others = dict(train.dtypes), dict(validation.dtypes)
    wrong = {c: (types[c], others[c]) for c in train.columns if types[c] != others[c]}
    if wrong:
        raise DataCheckError(f"train and validation types differ: {wrong}")
    if train.columns != validation.columns:
        raise DataCheckError("train and validation have their columns in different orders")


def check_against_metadata(df: DataFrame, target: str, metadata: dict) -> None:
    """Features are those the preparation recorded; a recorded row count must agree too."""
    names = metadata["feature_names"]
    if len(set(names)) < len(names):
        raise DataCheckError("the preparation metadata repeats feature names")
    found = [c for c in df.columns if c != target]
    if found != names:
        raise DataCheckError(
            f"features differ from the metadata; only in data: {sorted(set(found) - set(names))}, "
            f"only in metadata: {sorted(set(names) - set(found))}"
        )
    if "n_train_rows" in metadata and df.count() != metadata["n_train_rows"]:
        raise DataCheckError(f"train rows differ from the {metadata['n_train_rows']} in the metadata")

