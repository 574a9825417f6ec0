"""Calendar, lag, rolling and trend features of a series of daily rows."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from sensorloom.config import FeatureSpec, RollingSpec, TrendSpec
from sensorloom.errors import DataCheckError
from sensorloom.functions.calendar import calendar_columns
from sensorloom.functions.scalars import rain_temp_ratio, relative_change, standard_anomaly
from sensorloom.operators.series import Series, WindowColumn, with_long_medians, with_run_lengths, with_window_columns

DRY_DAYS, WET_DAYS = "consecutive_dry_days", "consecutive_wet_days"

STATS: dict[str, Callable[[Column], Column]] = {
    "mean": F.avg,
    "median": lambda c: F.percentile(c, F.lit(0.5)),
    "std": F.stddev_samp,
    "min": F.min,
    "max": F.max,
    "sum": F.sum,
}


#: Frames of more rows than this have their median from a sorted list that slides over the rows.
LONG_FRAME = 100


def _positive(steps: Iterable[int], what: str) -> list[int]:
    found = sorted(set(steps))
    if any(isinstance(s, bool) or not isinstance(s, int) or s <= 0 for s in found):
        raise DataCheckError(f"{what} must be positive whole numbers, got {found}")
    return found


def _present(df: DataFrame, columns: Iterable[str], strict: bool) -> list[str]:
    wanted = list(columns)
    absent = [c for c in wanted if c not in df.columns]
    if absent and strict:
        raise DataCheckError(f"feature columns {absent} do not exist")
    return [c for c in wanted if c not in absent]


def _lag(column: str, k: int) -> WindowColumn:
    return lambda w: F.lag(column, k).over(w)


def _rolling(column: str, n: int, stat: str) -> WindowColumn:
    # The n rows before this one; the row itself stays out.
    return lambda w: STATS[stat](F.col(column)).over(w.rowsBetween(-n, -1))


def _change(column: str, k: int) -> WindowColumn:
    return lambda w: F.col(column) - F.lag(column, k).over(w)


def _pct_change(column: str, k: int) -> WindowColumn:
    return lambda w: relative_change(F.col(column), F.lag(column, k).over(w))


class WindowPlan:
    """Window columns of several families, to be added together."""

    def __init__(self) -> None:
        self.columns: dict[str, WindowColumn] = {}
        self.sources: list[str] = []
        self.lookback = 0
        self.medians: dict[str, tuple[str, int]] = {}

    def add(self, name: str, source: str, reach: int, make: Callable[[WindowSpec], Column]) -> None:
        self.columns[name] = make
        self.sources.append(source)
        self.lookback = max(self.lookback, reach)

    def apply(self, df: DataFrame, series: Series) -> DataFrame:
        out = with_window_columns(df, series, self.columns, self.sources, self.lookback)
        return with_long_medians(out, series, self.medians)


def plan_lags(plan: WindowPlan, df: DataFrame, lags: Mapping[str, Iterable[int]], strict: bool) -> None:
    for c in _present(df, lags, strict):
        for k in _positive(lags[c], f"lags of {c}"):
            plan.add(f"{c}_lag_{k}", c, k, _lag(c, k))


def plan_rolling(plan: WindowPlan, df: DataFrame, rolling: Mapping[str, RollingSpec], strict: bool) -> None:
    for c in _present(df, rolling, strict):
        unknown = set(rolling[c].stats) - set(STATS)
        if unknown:
            raise DataCheckError(f"unknown rolling statistics {sorted(unknown)}")
        for n in _positive(rolling[c].windows, f"windows of {c}"):
            for stat in sorted(set(rolling[c].stats)):
                if stat == "median" and n > LONG_FRAME:
                    plan.medians[f"{c}_rolling_{n}d_{stat}"] = (c, n)
                    continue
                plan.add(f"{c}_rolling_{n}d_{stat}", c, n, _rolling(c, n, stat))


def plan_changes(plan: WindowPlan, df: DataFrame, spec: TrendSpec, strict: bool) -> None:
    for c in _present(df, spec.columns, strict):
        for k in _positive(spec.intervals, "intervals"):
            plan.add(f"{c}_change_{k}d", c, k, _change(c, k))
            plan.add(f"{c}_pct_change_{k}d", c, k, _pct_change(c, k))


def calendar_features(df: DataFrame, date: str = "date") -> DataFrame:
    return df.withColumns(calendar_columns(F.col(date)))


def lag_features(
    df: DataFrame, lags: Mapping[str, Iterable[int]], series: Series = Series(), strict: bool = True
) -> DataFrame:
    """Value k rows earlier in the group."""
    plan = WindowPlan()
    plan_lags(plan, df, lags, strict)
    return plan.apply(df, series)


def rolling_features(
    df: DataFrame, rolling: Mapping[str, RollingSpec], series: Series = Series(), strict: bool = True
) -> DataFrame:
    """Statistics over the n rows before the current one; one value is enough, except for std."""
    plan = WindowPlan()
    plan_rolling(plan, df, rolling, strict)
    return plan.apply(df, series)


def change_features(
    df: DataFrame, spec: TrendSpec, series: Series = Series(), strict: bool = True
) -> DataFrame:
    plan = WindowPlan()
    plan_changes(plan, df, spec, strict)
    return plan.apply(df, series)


def spell_features(df: DataFrame, spec: TrendSpec, series: Series = Series()) -> DataFrame:
    """Length of the current run of dry and of wet rows; a NULL ends both."""
    if spec.dry_threshold < 0:
        raise DataCheckError("the dry threshold cannot be negative")
    rain = F.col(spec.rainfall)
    return with_run_lengths(
        df, series, {DRY_DAYS: rain < spec.dry_threshold, WET_DAYS: rain >= spec.dry_threshold}
    )


def derived_features(df: DataFrame, spec: TrendSpec) -> DataFrame:
    """Rain over temperature, and the rainfall anomaly where its rolling inputs exist."""
    new = {}
    if spec.ratio and {spec.rainfall, spec.temperature} <= set(df.columns):
        new["rain_temp_ratio"] = rain_temp_ratio(F.col(spec.rainfall), F.col(spec.temperature))
    mean, std = f"{spec.rainfall}_rolling_30d_mean", f"{spec.rainfall}_rolling_30d_std"
    if spec.anomaly and {spec.rainfall, mean, std} <= set(df.columns):
        new["rainfall_30d_anomaly"] = standard_anomaly(F.col(spec.rainfall), F.col(mean), F.col(std))
    return df.withColumns(new) if new else df


def build_features(
    df: DataFrame, spec: FeatureSpec, series: Series = Series(), strict: bool = True
) -> DataFrame:
    """All families. Lags, rolling statistics and changes share one window, one exchange, one sort."""
    plan = WindowPlan()
    if spec.lags is not None:
        plan_lags(plan, df, spec.lags, strict)
    if spec.rolling is not None:
        plan_rolling(plan, df, spec.rolling, strict)
    if spec.trends is not None:
        plan_changes(plan, df, spec.trends, strict)
    out = plan.apply(df, series)
    if spec.trends is not None:
        if spec.trends.spells and spec.trends.rainfall in df.columns:
            out = spell_features(out, spec.trends, series)
        out = derived_features(out, spec.trends)
    # Calendar columns need no window, so they are added after the rows were shuffled.
    return calendar_features(out, series.order)


def family_counts(before: DataFrame, after: DataFrame, spec: FeatureSpec) -> dict[str, int]:
    """How many columns each family added, read off the two schemas."""
    plans = {}
    for name, make, part in (
        ("lag", plan_lags, spec.lags),
        ("rolling", plan_rolling, spec.rolling),
    ):
        plan = WindowPlan()
        if part is not None:
            make(plan, before, part, strict=False)
        plans[name] = len(plan.columns) + len(plan.medians)
    n_calendar = len(calendar_columns(F.col("date")))
    total = len(after.columns) - len(before.columns)
    return {
        "calendar": n_calendar,
        **plans,
        "trend": total - n_calendar - sum(plans.values()),
        "total": total,
    }
