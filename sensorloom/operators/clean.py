"""Cleaning of raw text tables."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.config import CATEGORIES
from sensorloom.functions.casts import DAY_ONLY, MONTH_ONLY, canonical_number, clean_text, other_spelling, to_moment, to_number
from sensorloom.functions.names import (
    datetime_columns,
    find_by_keyword,
    find_coordinates,
    find_role,
    trimmed_names,
)
from sensorloom.sources.scratch import written

NUMERIC_VOTE_SHARE = 0.5
COPIES = "_copies"


def col(name: str) -> Column:
    """A column by its literal name, dots and all."""
    return F.col(f"`{name}`")


def text_columns(df: DataFrame) -> list[str]:
    return [c for c, t in df.dtypes if t == "string"]


def clean_missing(df: DataFrame) -> DataFrame:
    """Trim all text and null its sentinels, in one projection."""
    text = set(text_columns(df))
    return df.select(*[clean_text(col(c)).alias(c) if c in text else col(c) for c in df.columns])


def drop_repeated_rows(df: DataFrame) -> DataFrame:
    """Distinct rows; copies that share a task are dropped before the shuffle."""
    return df.dropDuplicates()


def drop_empty_rows(df: DataFrame) -> DataFrame:
    return df.na.drop("all")


def text_datetimes(df: DataFrame, hints: Iterable[str] = ()) -> list[str]:
    return [c for c in datetime_columns(df.columns, hints) if dict(df.dtypes)[c] == "string"]


def convert_datetimes(
    df: DataFrame, hints: Iterable[str] = (), day_first: Mapping[str, bool] | None = None
) -> DataFrame:
    """Columns named like a time become timestamps.

    Where text is ambiguous the day comes before the month, unless day_first says otherwise for the
    column (see date_votes).
    """
    wanted, orders = set(text_datetimes(df, hints)), dict(day_first or {})
    return df.select(*[to_moment(col(c), orders.get(c, True)).alias(c) if c in wanted else col(c) for c in df.columns])


def _date_counts(columns: Sequence[str]) -> list[Column]:
    out = []
    for i, c in enumerate(columns):
        out += [F.count_if(F.btrim(col(c)).rlike(DAY_ONLY)).alias(f"day{i}"), F.count_if(F.btrim(col(c)).rlike(MONTH_ONLY)).alias(f"month{i}")]
    return out


def date_votes(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """For each text column of dates: values whose first number must be the day, values whose second
    must, and whether the day comes first; where neither is more frequent, it does."""
    columns = text_datetimes(df) if columns is None else list(columns)
    if not columns:
        return df.sparkSession.createDataFrame([], "column string, n_day_first bigint, n_month_first bigint, day_first boolean")
    rows = [
        F.struct(F.lit(c).alias("column"), F.col(f"day{i}").alias("n_day_first"), F.col(f"month{i}").alias("n_month_first"))
        for i, c in enumerate(columns)
    ]
    counts = df.agg(*_date_counts(columns)).select(F.inline(F.array(*rows)))
    return counts.withColumn("day_first", F.col("n_day_first") >= F.col("n_month_first"))


def numeric_votes(df: DataFrame) -> DataFrame:
    """For each text column: values, values that read as numbers, and the verdict.

    One pass counts all columns at once; the counts are combined before they are shuffled.
    """
    text = text_columns(df)
    if not text:
        return df.sparkSession.createDataFrame(
            [], "column string, n_values bigint, n_numbers bigint, numeric boolean"
        )
    counts = df.agg(
        *[F.count(col(c)).alias(f"v{i}") for i, c in enumerate(text)],
        *[F.count(to_number(col(c))).alias(f"n{i}") for i, c in enumerate(text)],
    )
    rows = F.array(
        *[
            F.struct(F.lit(c).alias("column"), F.col(f"v{i}").alias("n_values"), F.col(f"n{i}").alias("n_numbers"))
            for i, c in enumerate(text)
        ]
    )
    return counts.select(F.inline(rows)).withColumn(
        "numeric",
        (F.col("n_values") == 0) | (F.col("n_numbers") >= NUMERIC_VOTE_SHARE * F.col("n_values")),
    )


def convert_numerics(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Cast the given text columns, or those that win the vote, to double."""
    if columns is None:
        columns = [r["column"] for r in numeric_votes(df).where("numeric").collect()]
    wanted = set(columns)
    return df.select(*[to_number(col(c)).alias(c) if c in wanted else col(c) for c in df.columns])


def valid_coordinates(df: DataFrame) -> Column | None:
    """Condition for a position on Earth, or None if a coordinate column is absent."""
    lat, lon = find_coordinates(df.columns)
    if lat is None or lon is None:
        return None
    types = dict(df.dtypes)
    lat_value, lon_value = [to_number(col(c)) if types[c] == "string" else col(c) for c in (lat, lon)]
    return F.coalesce((F.abs(lat_value) <= 90) & (F.abs(lon_value) <= 180), F.lit(False))


def keep_valid_coordinates(df: DataFrame) -> DataFrame:
    condition = valid_coordinates(df)
    return df if condition is None else df.where(condition)


def in_range(value: Column, low: float | None, high: float | None) -> Column:
    """The value, or NULL outside the bounds; an absent bound does not limit."""
    condition = F.lit(True)
    if low is not None:
        condition = condition & (value >= low)
    if high is not None:
        condition = condition & (value <= high)
    return F.when(condition, value)


def apply_range(df: DataFrame, category: str) -> DataFrame:
    """Null sensor values outside the category's range, in the first column its keywords find."""
    rule = next((c for c in CATEGORIES if _names_category(category, c.name)), None)
    column = find_by_keyword(df.columns, rule.sensor_keywords) if rule else None
    if column is None:
        return df
    value = to_number(col(column)) if dict(df.dtypes)[column] == "string" else col(column)
    return df.withColumn(column, in_range(value, rule.low, rule.high))


def _names_category(label: str, name: str) -> bool:
    low = label.lower()
    return "river" in low if name == "river_level" else name in low


def range_by_category(category: Column, value: Column) -> Column:
    """The same rules for a long table: each row follows its own category."""
    result = value
    for rule in CATEGORIES:
        result = F.when(category == rule.name, in_range(value, rule.low, rule.high)).otherwise(result)
    return result


def keep_column_order(df: DataFrame, original: Sequence[str]) -> DataFrame:
    """Original columns first and in their order, new ones after them."""
    first = [c for c in trimmed_names(original) if c in df.columns]
    rest = [c for c in df.columns if c not in first]
    return df.select(*[col(c) for c in first + rest])


def standardise(df: DataFrame, dataset: str, source_file: str | Column) -> DataFrame:
    """Add timestamp, district, station, latitude, longitude and origin; keep every column."""
    df = df.toDF(*trimmed_names(df.columns))
    types = dict(df.dtypes)

    def role(name: str, read, absent: str) -> Column:
        found = find_role(df.columns, name)
        if found is None:
            return F.lit(None).cast(absent)
        return read(col(found), types[found] == "string")

    def moment(c: Column, is_text: bool) -> Column:
        return to_moment(c) if is_text else c.cast("timestamp_ntz")

    def text(c: Column, is_text: bool) -> Column:
        return F.btrim(c if is_text else c.cast("string"))

    def number(c: Column, is_text: bool) -> Column:
        return to_number(c) if is_text else c.cast("double")

    return df.withColumns(
        {
            "timestamp": role("timestamp", moment, "timestamp_ntz"),
            "district": role("district", text, "string"),
            "station": role("station", text, "string"),
            "latitude": role("latitude", number, "double"),
            "longitude": role("longitude", number, "double"),
            "source_dataset": F.lit(dataset),
            "source_file": F.lit(source_file) if isinstance(source_file, str) else source_file,
        }
    )


def fold_copies(df: DataFrame) -> DataFrame:
    """Distinct rows of cleaned text and how often each occurs; copies are compared before any cast."""
    text = clean_missing(df.toDF(*trimmed_names(df.columns)))
    return text.groupBy(*[col(c) for c in text.columns]).agg(F.count(F.lit(1)).alias(COPIES))


def respelled(folded: DataFrame) -> tuple[list[str], list[str]]:
    """Columns of numbers in more than one spelling, and columns of dates in more than one format.

    A column counts as one of numbers if all its values are.
    """
    return _spellings(folded)[:2]


def _spellings(folded: DataFrame) -> tuple[list[str], list[str], dict[str, bool]]:
    """The columns of respelled, and for all columns of dates whether the day comes first; one aggregate for all."""
    rows = folded.drop(COPIES)
    dates = text_datetimes(rows)
    others = [c for c in text_columns(rows) if c not in dates]
    if not dates and not others:
        return [], [], {}
    form = {c: F.regexp_replace(F.translate(col(c), "012345678", "9" * 9), "[A-Za-z]+", "a") for c in dates}
    found = rows.agg(
        *[F.count_if(col(c).isNotNull() & to_number(col(c)).isNull()).alias(f"t{i}") for i, c in enumerate(others)],
        *[F.count_if(other_spelling(col(c))).alias(f"s{i}") for i, c in enumerate(others)],
        *[F.min(form[c]).alias(f"a{i}") for i, c in enumerate(dates)],
        *[F.max(form[c]).alias(f"z{i}") for i, c in enumerate(dates)],
        *_date_counts(dates),
    ).first()
    numbers = [c for i, c in enumerate(others) if not found[f"t{i}"] and found[f"s{i}"]]
    orders = {c: found[f"day{i}"] >= found[f"month{i}"] for i, c in enumerate(dates)}
    return numbers, [c for i, c in enumerate(dates) if found[f"a{i}"] != found[f"z{i}"]], orders


def fold_by_value(
    folded: DataFrame, numbers: Sequence[str], dates: Sequence[str], day_first: Mapping[str, bool] | None = None
) -> DataFrame:
    """Rows of fold_copies whose cells have the same values become one, and their copies add up.

    Cells of the columns named take the one spelling of their value (numbers without needless zeros,
    ISO dates), by which they are compared; what can't be read stays as it is.
    """
    orders = day_first or {}

    def spelled(c: str) -> Column:
        if c in numbers:
            return F.coalesce(canonical_number(col(c)), col(c)).alias(c)
        if c in dates:
            return F.coalesce(to_moment(col(c), orders.get(c, True)).cast("string"), col(c)).alias(c)
        return col(c)

    rows = folded.select(*[spelled(c) for c in folded.columns])
    return rows.groupBy(*[col(c) for c in rows.columns if c != COPIES]).agg(F.sum(COPIES).alias(COPIES))


def distinct_by_value(df: DataFrame) -> DataFrame:
    """Written: distinct rows of raw text, compared by the values of their cells, with their COPIES.

    Copies are folded as text first, so that only distinct rows are looked at again.
    """
    folded = written(fold_copies(df))
    numbers, dates, orders = _spellings(folded)
    if not numbers and not dates:
        return folded
    return written(fold_by_value(folded, numbers, dates, orders))


def column_votes(folded: DataFrame) -> tuple[list[str], dict[str, bool]]:
    """Columns the vote makes numeric, and for the columns of dates whether the day comes first.

    All text columns are counted in one aggregate: dates for their order, the others for numbers.
    """
    rows = folded.drop(COPIES)
    dates = text_datetimes(rows)
    others = [c for c in text_columns(rows) if c not in dates]
    if not dates and not others:
        return [], {}
    found = rows.agg(
        *_date_counts(dates),
        *[F.count(col(c)).alias(f"v{i}") for i, c in enumerate(others)],
        *[F.count(to_number(col(c))).alias(f"n{i}") for i, c in enumerate(others)],
    ).first()
    numeric = [c for i, c in enumerate(others) if found[f"v{i}"] == 0 or found[f"n{i}"] >= NUMERIC_VOTE_SHARE * found[f"v{i}"]]
    return numeric, {c: found[f"day{i}"] >= found[f"month{i}"] for i, c in enumerate(dates)}


def numeric_winners(folded: DataFrame) -> list[str]:
    """Columns the vote makes numeric, once the datetime columns have theirs."""
    return column_votes(folded)[0]


def clean_folded(
    folded: DataFrame, category: str, numeric: Sequence[str], day_first: Mapping[str, bool] | None = None
) -> DataFrame:
    """The cleaning steps after de-duplication, in their fixed order."""
    rows = convert_datetimes(drop_empty_rows(folded.drop(COPIES)), day_first=day_first)
    return apply_range(keep_valid_coordinates(convert_numerics(rows, numeric)), category)


def clean(
    df: DataFrame, category: str, numeric: Sequence[str] | None = None, day_first: Mapping[str, bool] | None = None
) -> DataFrame:
    """All cleaning steps.

    With the numeric columns given, nothing runs until the result is used. Otherwise the distinct
    rows are written once, because both the vote and the casts that follow it read them.
    """
    folded = fold_copies(df)
    if numeric is None:
        folded = written(folded)
        numeric, voted = column_votes(folded)
        day_first = {**voted, **(day_first or {})}
    return keep_column_order(clean_folded(folded, category, numeric, day_first), df.columns)


def cleaning_report(
    folded: DataFrame, dataset: str, category: str, numeric: Sequence[str], day_first: Mapping[str, bool] | None = None
) -> DataFrame:
    """Row counts of each cleaning step, in one pass over the folded rows."""
    names = [c for c in folded.columns if c != COPIES]
    filled = F.greatest(*[col(c).isNotNull() for c in names]) if len(names) > 1 else col(names[0]).isNotNull()
    typed = convert_numerics(convert_datetimes(folded.withColumn("_filled", filled), day_first=day_first), numeric)
    located = valid_coordinates(typed)
    typed = typed.withColumn("_located", F.lit(True) if located is None else located)

    rule = next((c for c in CATEGORIES if _names_category(category, c.name)), None)
    sensor = find_by_keyword(names, rule.sensor_keywords) if rule else None
    kept = F.col("_filled") & F.col("_located")
    if sensor:
        value = to_number(col(sensor)) if dict(typed.dtypes)[sensor] == "string" else col(sensor)
        ranged = in_range(value, rule.low, rule.high)
        typed = typed.withColumns(
            {"_changed": value.isNotNull() & ranged.isNull(), "_sensor_null": ranged.isNull()}
        )
    else:
        typed = typed.withColumns({"_changed": F.lit(False), "_sensor_null": F.lit(False)})
    has_null = F.col("_sensor_null")
    for c in names:
        has_null = has_null | col(c).isNull()
    counts = typed.agg(
        F.coalesce(F.sum(COPIES), F.lit(0)).alias("rows_before"),
        F.count_if(kept).alias("rows_after"),
        F.coalesce(F.sum(F.col(COPIES) - 1), F.lit(0)).alias("duplicate_rows_removed"),
        F.count_if(~F.col("_filled")).alias("empty_rows_removed"),
        F.count_if(F.col("_filled") & ~F.col("_located")).alias("invalid_coordinates_removed"),
        F.count_if(kept & F.col("_changed")).alias("invalid_sensor_values_removed"),
        F.count_if(kept & has_null).alias("rows_with_missing_values"),
    )
    removed = F.col("rows_before") - F.col("rows_after")
    return counts.select(
        F.lit(dataset).alias("dataset_name"),
        F.lit(category).alias("category"),
        "*",
        removed.alias("rows_removed"),
        F.when(F.col("rows_after") == 0, "EMPTY_AFTER_CLEANING")
        .when((removed == 0) & (F.col("invalid_sensor_values_removed") == 0), "CLEAN")
        .otherwise("CLEANED")
        .alias("status"),
    )
