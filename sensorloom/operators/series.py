"""Ordered windows over each group's rows.

A district has one row a day (its keys are checked to be unique), so a group of daily rows holds
at most 36,525 rows a century and one window over it is fine. Series without that bound, such as
raw readings of a busy station, name a segment length: the group is then cut into time segments
that are processed apart, each with the rows just outside it that its frames can reach.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorloom.config import DATE, DISTRICT_CODE
from sensorloom.errors import DataCheckError

WindowColumn = Callable[[WindowSpec], Column]

SEGMENT, HALO = "_segment", "_halo"
SECONDS_A_DAY = 86400


@dataclass(frozen=True)
class Series:
    """Rows of a group in the order of a date or time; a segment length in days splits groups."""

    group: tuple[str, ...] = (DISTRICT_CODE,)
    order: str = DATE
    segment_days: float | None = None

    def check(self, df: DataFrame) -> None:
        absent = [c for c in (*self.group, self.order) if c not in df.columns]
        if absent:
            raise DataCheckError(f"series columns {absent} are missing")
        daily = isinstance(df.schema[self.order].dataType, T.DateType)
        if not daily and self.segment_days is None:
            raise DataCheckError(
                f"'{self.order}' is finer than a day: give segment_days so that groups can be split"
            )

    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.group).orderBy(self.order)

    def segment_window(self) -> WindowSpec:
        return Window.partitionBy(*self.group, SEGMENT).orderBy(self.order)

    def segment(self, df: DataFrame) -> Column:
        """Number of the time segment a row lies in; it never falls as the order column rises."""
        c, kind = F.col(self.order), df.schema[self.order].dataType
        if isinstance(kind, T.DateType):
            days = F.unix_date(c)
        elif isinstance(kind, T.TimestampNTZType):
            # Read off the clock fields, because a conversion would pass through the session's zone.
            clock = F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)
            days = F.unix_date(F.to_date(c)) + clock / SECONDS_A_DAY
        else:
            days = F.unix_micros(c) / (SECONDS_A_DAY * 1e6)
        return F.floor(days / F.lit(float(self.segment_days)))


def with_window_columns(
    df: DataFrame,
    series: Series,
    columns: Mapping[str, WindowColumn],
    sources: Sequence[str],
    lookback: int = 0,
    lookahead: int = 0,
) -> DataFrame:
    """Add columns whose frames reach at most `lookback` rows back and `lookahead` rows on.

    All columns share one window specification: one exchange and one sort for all of them.
    """
    series.check(df)
    if not columns:
        return df
    if series.segment_days is None:
        w = series.window()
        return df.withColumns({name: make(w) for name, make in columns.items()})
    own = df.withColumn(SEGMENT, series.segment(df))
    w = series.segment_window()
    rows = own.withColumn(HALO, F.lit(False)).unionByName(
        _halo_rows(own, series, sources, lookback, lookahead), allowMissingColumns=True
    )
    return (
        rows.withColumns({name: make(w) for name, make in columns.items()})
        .where(~F.col(HALO))
        .drop(SEGMENT, HALO)
    )


def _halo_rows(
    own: DataFrame, series: Series, sources: Sequence[str], lookback: int, lookahead: int
) -> DataFrame:
    """The `lookback` rows before each segment and the `lookahead` rows after it.

    Rows are numbered through the group: by position in the segment and the rows of the segments
    before, of which there is one count each. A row then knows the segments that need it, those that
    begin less than `lookback` rows after it or end less than `lookahead` rows before it. A segment
    holds a row at least, so its row lists as many others as that at most, and gets as many rows.
    """
    keys = [*series.group, SEGMENT]
    fields = [series.order, *[c for c in dict.fromkeys(sources) if c not in (*keys, series.order)]]
    w = series.segment_window()
    over = Window.partitionBy(*series.group).orderBy(SEGMENT)
    sizes = own.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.withColumn("_before", F.sum("_n").over(over.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n"))
    sizes = sizes.withColumn("_end", F.col("_before") + F.col("_n"))
    one = F.struct(F.col(SEGMENT).alias("segment"), F.col("_before").alias("before"), F.col("_end").alias("end"))
    near = {"_next": (1, lookback), "_last": (-lookahead, -1)}
    for name, frame in near.items():
        reach = lookback if name == "_next" else lookahead
        listed = F.collect_list(one).over(over.rowsBetween(*frame)) if reach else F.array().cast("array<struct<segment:bigint,before:bigint,end:bigint>>")
        sizes = sizes.withColumn(name, listed)
    # Only segments that a row of this one can reach stay in the lists.
    sizes = sizes.withColumns(
        {
            "_next": F.filter("_next", lambda s: s["before"] < F.col("_end") + lookback),
            "_last": F.filter("_last", lambda s: s["end"] > F.col("_before") - lookahead),
        }
    )
    sizes = sizes.select(*[F.col(c).alias(f"_key_{c}") for c in keys], "_n", "_before", "_next", "_last")
    rows = own.select(*keys, *fields).withColumn("_pos", F.row_number().over(w))
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_key_{c}")) for c in keys])
    at = F.col("_before") + F.col("_pos")
    edges = rows.join(sizes, same).where((F.col("_pos") > F.col("_n") - lookback) | (F.col("_pos") <= lookahead))
    targets = F.concat(
        F.filter("_next", lambda s: s["before"] < at + lookback), F.filter("_last", lambda s: s["end"] >= at - lookahead)
    )
    edges = edges.withColumn("_target", F.explode(F.transform(targets, lambda s: s["segment"])))
    return edges.select(*series.group, F.col("_target").alias(SEGMENT), *fields, F.lit(True).alias(HALO))


def with_long_medians(df: DataFrame, series: Series, medians: Mapping[str, tuple[str, int]]) -> DataFrame:
    """For each name, the median of a column over the n rows before each row.

    Spark gathers and sorts a frame anew for each row, which long frames can't afford. Here a sorted
    list slides over the rows of a group (or of a segment with the rows before it), so that a row
    costs the logarithm of its frame.
    """
    series.check(df)
    if not medians:
        return df
    keys, rows = list(series.group), df.withColumn(HALO, F.lit(False))
    if series.segment_days is not None:
        keys.append(SEGMENT)
        own = df.withColumn(SEGMENT, series.segment(df))
        sources, lookback = [c for c, _ in medians.values()], max(n for _, n in medians.values())
        halo = _halo_rows(own, series, sources, lookback, 0)
        rows = own.withColumn(HALO, F.lit(False)).unionByName(halo, allowMissingColumns=True)
    columns, order, wanted = df.columns, series.order, dict(medians)

    def slide(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(order, kind="stable")
        out = {name: part[c].astype("float64").shift(1).rolling(n, min_periods=1).median() for name, (c, n) in wanted.items()}
        return part[columns].assign(**out)[~part[HALO].astype(bool)]

    fields = [*df.schema.fields, *[T.StructField(name, T.DoubleType()) for name in medians]]
    return rows.groupBy(*keys).applyInPandas(slide, T.StructType(fields))


def with_run_lengths(df: DataFrame, series: Series, conditions: Mapping[str, Column]) -> DataFrame:
    """For each condition, how many rows in a row have met it, this one included; else 0.

    A run's length is the distance to the last row that broke it. Position and last break use
    the same window, so no second exchange is needed.
    """
    series.check(df)
    met = {name: F.coalesce(c, F.lit(False)) for name, c in conditions.items()}
    whole = series.segment_days is None
    rows = df if whole else df.withColumn(SEGMENT, series.segment(df))
    w = series.window() if whole else series.segment_window()
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({"_pos": F.row_number().over(w), **{f"_met_{n}": c for n, c in met.items()}})
    rows = rows.withColumns(
        {
            f"_brk_{n}": F.max(F.when(~F.col(f"_met_{n}"), F.col("_pos"))).over(so_far)
            for n in conditions
        }
    )
    if not whole:
        rows = rows.join(_carried_runs(rows, series, list(conditions)), [*series.group, SEGMENT], "left")
    lengths = {}
    for n in conditions:
        carried = F.lit(0) if whole else F.coalesce(F.col(f"_carry_{n}"), F.lit(0))
        unbroken = F.col("_pos") + carried
        run = F.coalesce(F.col("_pos") - F.col(f"_brk_{n}"), unbroken)
        lengths[n] = F.when(F.col(f"_met_{n}"), run).otherwise(0).cast("int")
    return rows.withColumns(lengths).select(*df.columns, *conditions)


def _carried_runs(rows: DataFrame, series: Series, names: Sequence[str]) -> DataFrame:
    """Length of the run each segment starts in the middle of."""
    keys = [*series.group, SEGMENT]
    ends = rows.groupBy(*keys).agg(
        F.max("_pos").alias("n"), *[F.max(f"_brk_{n}").alias(f"b_{n}") for n in names]
    )
    by_segment = Window.partitionBy(*series.group).orderBy(SEGMENT)
    to_here = by_segment.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # Segments without a break continue the run of the last one that had a break.
    for n in names:
        ends = ends.withColumn(f"i_{n}", F.count(f"b_{n}").over(to_here))
        island = Window.partitionBy(*series.group, f"i_{n}").orderBy(SEGMENT)
        open_run = F.sum(F.col("n") - F.coalesce(F.col(f"b_{n}"), F.lit(0))).over(
            island.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        )
        ends = ends.withColumn(f"o_{n}", open_run)
    return ends.select(
        *keys, *[F.lag(f"o_{n}", 1).over(by_segment).alias(f"_carry_{n}") for n in names]
    )
