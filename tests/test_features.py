import datetime as dt

import pytest
from pyspark.sql import functions as F

from sensorloom.config import FeatureSpec, TargetSpec, default_features
from sensorloom.errors import DataCheckError
from sensorloom.functions.calendar import calendar_columns
from sensorloom.functions.scalars import rain_temp_ratio, relative_change
from sensorloom.functions.transforms import get_transform, register_transform
from sensorloom.operators import target as t
from sensorloom.operators.feature_checks import feature_table_report, infinite_counts, require_valid_features
from sensorloom.operators.features import build_features, family_counts
from sensorloom.operators.split import check_cuts, continuity, cut_dates, sparse_train_groups, with_split
from sensorloom.config import SplitShares
from sensorloom.plans import views


def day(i):
    return dt.date(2023, 12, 28) + dt.timedelta(days=i)


def test_calendar(spark):
    df = spark.createDataFrame([(dt.date(2024, 2, 29),), (dt.date(2023, 12, 31),), (dt.date(2024, 7, 1),)], "d date")
    leap, sunday, monsoon = [r.asDict() for r in df.select("*", *[c.alias(n) for n, c in calendar_columns(F.col("d")).items()]).collect()]
    assert len(leap) == 19
    assert (leap["is_month_end"], leap["day_of_year"], leap["is_winter"]) == (1, 60, 1)
    assert leap["day_of_year_sin"] == pytest.approx(0.8574, abs=1e-4)  # 60 of 366 days
    assert (sunday["day_of_week"], sunday["is_weekend"], sunday["week"], sunday["quarter"]) == (6, 1, 52, 4)
    assert (monsoon["is_monsoon"], monsoon["is_month_start"], monsoon["is_summer"]) == (1, 1, 0)


def test_ratio(spark):
    inf = float("inf")
    rows = [(2.0, 1.0), (2.0, -1.0), (-2.0, -1.0), (0.0, -1.0), (2.0, None), (None, 3.0)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, r double, t double").orderBy("i")
    assert [r[0] for r in df.select(rain_temp_ratio(F.col("r"), F.col("t"))).collect()] == [1.0, inf, -inf, None, None, None]


def test_relative_change_of_zero(spark):
    row = spark.range(1).select(relative_change(F.lit(1.0), F.lit(0.0)).alias("x")).first()
    assert row["x"] == pytest.approx(1e5)


def test_transforms(spark):
    row = spark.range(1).select(get_transform("log1p").inverse(get_transform("log1p").forward(F.lit(3.0))).alias("x")).first()
    assert row["x"] == pytest.approx(3.0)
    with pytest.raises(ValueError):
        get_transform("nope")
    register_transform("twice", lambda c: c * 2, lambda c: c / 2)
    assert get_transform("twice")


def test_default_features_count(spark, sf):
    master = views.master(spark, sf)
    out = build_features(master, default_features())
    assert len(out.columns) - len(master.columns) == 65
    assert family_counts(master, out, default_features()) == {"calendar": 18, "lag": 8, "rolling": 15, "trend": 24, "total": 65}


def test_absent_families_are_skipped(spark, sf):
    master = views.master(spark, sf)
    assert len(build_features(master, FeatureSpec()).columns) == len(master.columns) + 18


def test_feature_table_checks(spark):
    df = spark.createDataFrame([(1, 1.0, "a"), (1, 1.0, "a"), (2, float("inf"), None)], "k int, x double, s string")
    assert {r["column"]: r["n_infinite"] for r in infinite_counts(df).collect()} == {"k": 0, "x": 1}
    r = feature_table_report(df, ["k", "gone"]).first()
    assert (r["duplicate_rows"], r["columns_with_infinities"], r["columns_with_nulls"], r["missing_required_columns"], r["is_valid"]) == (1, 1, 1, 1, False)
    with pytest.raises(DataCheckError):
        require_valid_features(df, ["k"])
    require_valid_features(df.where("k = 1").distinct(), ["k"])


SPEC = TargetSpec(source="v", group="g", date="d", horizon=2)


def series(spark, values, schema="g int, d date, v double"):
    return spark.createDataFrame([(1, day(i), x) for i, x in enumerate(values)], schema)


def test_target(spark):
    df = series(spark, [1.0, 2.0, None, 4.0])
    t.check_target_input(df, SPEC)
    assert [r["target"] for r in t.with_target(df, SPEC).orderBy("d").collect()] == [None, 4.0, None, None]
    assert t.check_target(t.with_target(df, SPEC), "target") == {"n_total": 4, "n_null": 3, "n_valid": 1}


@pytest.mark.parametrize(
    "rows, schema, spec",
    [
        ([(1, "2024-01-01", 1.0), (1, "x", 1.0)], "g int, d string, v double", SPEC),
        ([(1, "2024-01-01", "a")], "g int, d string, v string", SPEC),
        ([(1.0, "2024-01-01", 1.0)], "g double, d string, v double", SPEC),
        ([(1, "2024-01-01", 1.0)] * 2, "g int, d string, v double", SPEC),
        ([(1, "2024-01-01", -1.0)], "g int, d string, v double", TargetSpec("v", "g", "d", 2, "log1p")),
        ([(1, "2024-01-01", 1.0)], "g int, other string, v double", SPEC),
    ],
)
def test_bad_target_input_raises(spark, rows, schema, spec):
    with pytest.raises(DataCheckError):
        t.check_target_input(spark.createDataFrame(rows, schema), spec)


def test_bad_specs():
    for bad in (dict(horizon=0), dict(source="")):
        with pytest.raises(ValueError):
            TargetSpec(**bad)
    with pytest.raises(ValueError):
        SplitShares(0.5, 0.2, 0.2)


def test_null_target_raises(spark):
    with pytest.raises(DataCheckError):
        t.check_target(t.with_target(series(spark, [1.0]), SPEC), "target")


def test_leakage(spark):
    rows = [(float(i), float(i) * 3 + 1, 7.0, float(i), i, None if i == 2 else float(i % 3)) for i in range(9)]
    df = spark.createDataFrame(rows, "target double, linear double, constant double, copy double, whole int, weak double")
    audit = {r["column"]: r for r in t.leakage_audit(df, "target").collect()}
    assert [c for c, r in audit.items() if r["is_target"]] == ["copy"]
    assert sorted(c for c, r in audit.items() if r["flagged"]) == ["copy", "linear", "whole"]
    assert audit["constant"]["correlation"] is None and audit["weak"]["n_pairs"] == 8
    with pytest.raises(DataCheckError):
        t.check_leakage(t.leakage_audit(df, "target"))
    assert sorted(t.check_leakage(t.leakage_audit(df.drop("copy"), "target"))) == ["linear", "whole"]


@pytest.mark.parametrize("n, want", [(3, (1, 1, 1)), (10, (7, 1, 2)), (20, (14, 3, 3)), (100, (70, 15, 15))])
def test_cut_positions(spark, n, want):
    df = series(spark, [1.0] * n).withColumn("target", F.col("v"))
    counts = {r["split"]: r["count"] for r in with_split(df, date="d").groupBy("split").count().collect()}
    assert (counts["train"], counts["validation"], counts["test"]) == want


def test_too_few_dates(spark):
    df = series(spark, [1.0, 1.0]).withColumn("target", F.col("v"))
    with pytest.raises(DataCheckError):
        check_cuts(cut_dates(df, SplitShares(), "d"))


def test_continuity_and_sparse_groups(spark):
    rows = [(1, day(0)), (1, day(0)), (1, day(40)), (2, day(0)), (2, day(1))]
    df = spark.createDataFrame(rows, "g int, d date")
    found = {r["g"]: (r["n_dates"], r["max_gap_days"], r["large_gap"]) for r in continuity(df, "g", "d").collect()}
    assert found == {1: (2, 40, True), 2: (2, 1, False)}
    split = df.withColumn("split", F.lit("train"))
    assert {r["g"]: r["n_rows"] for r in sparse_train_groups(split, "g", 3).collect()} == {2: 2}
