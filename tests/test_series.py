import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest

from sensorloom.config import RollingSpec, TrendSpec
from sensorloom.errors import DataCheckError
from sensorloom.operators import features, series
from sensorloom.operators.features import change_features, lag_features, rolling_features, spell_features
from sensorloom.operators.series import Series, with_window_columns
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def daily(spark):
    """Groups of uneven length with gaps, NULLs, one dense and one very sparse."""
    rng = random.Random(7)
    rows = []
    for g, (n, gap) in enumerate([(120, 1), (60, 9), (5, 200), (1, 1), (40, 3)]):
        day = dt.date(2020, 1, 1)
        for _ in range(n):
            day += dt.timedelta(days=rng.randint(1, gap))
            rows.append((g, day, None if rng.random() < 0.2 else float(rng.randint(0, 8)) / 4))
    return spark.createDataFrame(rows, "district_code int, date date, rainfall_mm double")


def same(a, b):
    key = ["district_code", "date"]
    left, right = [x.toPandas().sort_values(key).reset_index(drop=True) for x in (a, b)]
    pd.testing.assert_frame_equal(left[right.columns], right, check_exact=False, rtol=1e-12)


@pytest.mark.parametrize("days", [1, 3, 17, 64, 5000])
def test_segments_change_no_result(daily, days):
    cut = Series(segment_days=days)
    lags, rolling = {"rainfall_mm": (1, 7, 30)}, {"rainfall_mm": RollingSpec((7, 30), ("mean", "std", "median", "sum", "min", "max"))}
    same(lag_features(daily, lags), lag_features(daily, lags, cut))
    same(rolling_features(daily, rolling), rolling_features(daily, rolling, cut))
    spec = TrendSpec(columns=("rainfall_mm",))
    same(change_features(daily, spec), change_features(daily, spec, cut))
    same(spell_features(daily, spec), spell_features(daily, spec, cut))
    ahead = {"x": lambda w: F.lead("rainfall_mm", 7).over(w)}
    same(
        with_window_columns(daily, Series(), ahead, ["rainfall_mm"], lookahead=7),
        with_window_columns(daily, cut, ahead, ["rainfall_mm"], lookahead=7),
    )


def test_against_pandas(daily):
    spec = {"rainfall_mm": RollingSpec((7,), ("mean", "std", "median", "sum"))}
    out = rolling_features(lag_features(daily, {"rainfall_mm": (7,)}), spec).toPandas()
    out = out.sort_values(["district_code", "date"]).reset_index(drop=True)
    grouped = out.groupby("district_code")["rainfall_mm"]
    np.testing.assert_allclose(out["rainfall_mm_lag_7"], grouped.shift(7))
    for stat in ("mean", "std", "median", "sum"):
        want = grouped.transform(lambda x, s=stat: getattr(x.shift(1).rolling(7, min_periods=1), s)())
        np.testing.assert_allclose(out[f"rainfall_mm_rolling_7d_{stat}"], want, atol=1e-9)


def test_spells_by_hand(spark):
    rain = [0.0, 0.5, None, 2.0, 3.0, 0.0, 0.2]
    rows = [(1, dt.date(2024, 1, i + 1), r) for i, r in enumerate(rain)]
    df = spark.createDataFrame(rows, "district_code int, date date, rainfall_mm double")
    out = spell_features(df, TrendSpec()).orderBy("date").collect()
    assert [r["consecutive_dry_days"] for r in out] == [1, 2, 0, 0, 0, 1, 2]
    assert [r["consecutive_wet_days"] for r in out] == [0, 0, 0, 1, 2, 0, 0]


def test_a_run_longer_than_many_segments(spark):
    rows = [(1, dt.date(2024, 1, 1) + dt.timedelta(days=i), 5.0 if i == 3 else 0.0) for i in range(200)]
    df = spark.createDataFrame(rows, "district_code int, date date, rainfall_mm double")
    out = spell_features(df, TrendSpec(), Series(segment_days=10)).orderBy("date").collect()
    assert [r["consecutive_dry_days"] for r in out] == [1, 2, 3, 0, *range(1, 197)]


def test_finer_than_a_day_needs_segments(spark):
    df = spark.createDataFrame([(1, dt.datetime(2024, 1, 1), 1.0)], "g int, t timestamp_ntz, v double")
    with pytest.raises(DataCheckError):
        lag_features(df, {"v": (1,)}, Series(("g",), "t"))
    assert lag_features(df, {"v": (1,)}, Series(("g",), "t", 1)).count() == 1


@pytest.mark.parametrize("lags", [{"rainfall_mm": (0,)}, {"rainfall_mm": (-1,)}, {"rainfall_mm": (True,)}, {"nope": (1,)}])
def test_bad_lags_raise(daily, lags):
    with pytest.raises(DataCheckError):
        lag_features(daily, lags)


def test_missing_column_may_be_skipped(daily):
    assert lag_features(daily, {"nope": (1,)}, strict=False).columns == daily.columns


@pytest.mark.parametrize("kind", ["timestamp_ntz", "timestamp"])
def test_segments_of_times(spark, kind):
    """Readings seconds apart, one group with most of them, in segments of about four minutes."""
    rng = random.Random(11)
    rows, moment = [], dt.datetime(2024, 3, 30, 23, 0)
    for i in range(600):
        moment += dt.timedelta(seconds=rng.randint(1, 40))
        rows.append((0 if i % 3 else i % 9, moment.isoformat(sep=" "), float(i)))
    df = spark.createDataFrame(rows, "g int, t string, v double")
    df = df.withColumn("t", F.col("t").cast(kind))
    out = lag_features(df, {"v": (1, 5)}, Series(("g",), "t", segment_days=0.003)).toPandas()
    out = out.sort_values(["g", "t"])
    for k in (1, 5):
        np.testing.assert_allclose(out[f"v_lag_{k}"], out.groupby("g")["v"].shift(k))


@pytest.mark.parametrize("days", [None, 2, 40, 5000])
def test_long_medians_slide(daily, days, monkeypatch):
    monkeypatch.setattr(features, "LONG_FRAME", 5)
    spec = {"rainfall_mm": RollingSpec((3, 7, 90), ("median", "mean"))}
    names = [f"rainfall_mm_rolling_{n}d_median" for n in (3, 7, 90)]
    slid = rolling_features(daily, spec, Series(segment_days=days))
    assert set(names) <= set(slid.columns)
    monkeypatch.setattr(features, "LONG_FRAME", 1000)
    same(rolling_features(daily, spec), slid)


def test_a_segment_lists_no_more_than_it_can_reach(spark):
    rows = [(1, dt.date(2024, 1, 1) + dt.timedelta(days=i), float(i)) for i in range(400)]
    own = spark.createDataFrame(rows, "district_code int, date date, v double")
    for days, lookback, lookahead in ((1, 7, 3), (10, 7, 0), (10, 25, 25), (400, 7, 7)):
        cut = Series(segment_days=days)
        halo = series._halo_rows(own.withColumn(series.SEGMENT, cut.segment(own)), cut, ["v"], lookback, lookahead)
        sizes = halo.groupBy(series.SEGMENT).count().collect()
        assert all(r["count"] <= lookback + lookahead for r in sizes)
        assert halo.distinct().count() == halo.count()
        plan = halo._jdf.queryExecution().executedPlan().toString()
        assert "flatten" not in plan


def test_a_median_over_ten_thousand_rows(spark):
    values = np.random.default_rng(1).integers(0, 1000, 30_000).astype(float)
    df = spark.createDataFrame([(i % 2, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=i), float(x)) for i, x in enumerate(values)], "g int, t timestamp_ntz, v double")
    out = rolling_features(df, {"v": RollingSpec((10_000,), ("median",))}, Series(("g",), "t", segment_days=0.1)).toPandas().sort_values(["g", "t"])
    want = out.groupby("g")["v"].transform(lambda x: x.shift(1).rolling(10_000, min_periods=1).median())
    np.testing.assert_allclose(out["v_rolling_10000d_median"], want)
