import datetime as dt

import pytest
from pyspark.sql import functions as F

from sensorloom.config import CLEANING_FILE_KEYWORDS, SENTINELS
from sensorloom.functions import names
from sensorloom.functions.casts import clean_text, to_day, to_moment, to_number
from sensorloom.operators import clean as c

HUMIDITY = "Telemetry Hourly Relative Humidity (%)"


def values(spark, texts, fn):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("t"))).collect()]


def test_sentinels_and_blanks(spark):
    assert values(spark, [f" {s}\t" for s in SENTINELS] + ["", "  ", None], clean_text) == [None] * (len(SENTINELS) + 3)
    assert values(spark, [" a b ", "Na", "0", "\tx\r\n"], clean_text) == ["a b", "Na", "0", "x"]


def test_numbers(spark):
    texts = ["1.5", "-2", "1e3", "1.5d", "2f", "abc", "NaN", None, " 4 ", "inf"]
    assert values(spark, texts, to_number) == [1.5, -2.0, 1000.0, None, None, None, None, None, 4.0, float("inf")]


def test_moments(spark):
    day = lambda m, d, *t: dt.datetime(2024, m, d, *t)
    texts = ["2024-03-04 05:06:07", "04-03-2024 05:06", "4/3/2024", "2024/03/04", "13/12/2024", "12/13/2024", "31-02-2024", "soon", None]
    assert values(spark, texts, to_moment) == [
        day(3, 4, 5, 6, 7), day(3, 4, 5, 6), day(3, 4), day(3, 4), day(12, 13), day(12, 13), None, None, None,
    ]
    assert values(spark, ["03/04/2024", " 2024-03-04 23:59:59 ", "x"], to_day) == [dt.date(2024, 3, 4), dt.date(2024, 3, 4), None]


def test_vote(spark):
    rows = [("1", "a", None, "1"), ("2", "b", None, "x"), ("x", "3", None, None)]
    df = spark.createDataFrame(rows, "most string, few string, empty string, half string")
    verdict = {r["column"]: r["numeric"] for r in c.numeric_votes(df).collect()}
    assert verdict == {"most": True, "few": False, "empty": True, "half": True}
    assert dict(c.convert_numerics(df).dtypes) == {"most": "double", "few": "string", "empty": "double", "half": "double"}


def test_coordinates(spark):
    df = spark.createDataFrame([("90", "180"), ("90.1", "0"), ("0", "-180.1"), (None, "1"), ("x", "1"), ("-90", "-180")], "lat string, `My Longitude` string")
    assert c.keep_valid_coordinates(df).count() == 2
    assert c.keep_valid_coordinates(df.drop("lat")).count() == 6


@pytest.mark.parametrize(
    "category, column, inside, outside",
    [
        ("Humidity", HUMIDITY, [0.0, 100.0], [-0.1, 100.1]),
        ("Temperature", "Air Temperature", [-60.0, 60.0], [-60.1, 60.1]),
        ("Rainfall", "Rainfall (mm)", [0.0, 1e9], [-0.1]),
        ("Groundwater", "GWL", [-1000.0, 200.0], [-1000.1, 200.1]),
        ("River Level", "River Water Level", [-50.0, 10000.0], [-50.1, 10000.1]),
    ],
)
def test_ranges(spark, category, column, inside, outside):
    df = spark.createDataFrame([(i, x) for i, x in enumerate([*inside, *outside])], f"i int, `{column}` double")
    found = [r[1] for r in c.apply_range(df, category).orderBy("i").collect()]
    assert found == inside + [None] * len(outside)


def test_unknown_category_changes_nothing(spark):
    df = spark.createDataFrame([(-5.0,)], "rain double")
    assert c.apply_range(df, "Unknown").collect() == df.collect()


def test_clean_and_its_report(spark):
    time = "Data Acquisition Time"
    schema = f"` Station` string, Latitude string, Longitude string, `{time}` string, `{HUMIDITY}` string"
    rows = [
        (" A ", "20", "70", "2024-01-02 00:00:00", "50"),
        ("A", "20", "70", "2024-01-02 00:00:00", "50 "),  # a copy once trimmed
        ("B", "20", "70", "02-01-2024 00:00", "150"),  # out of range
        ("C", "95", "70", "2024-01-02 00:00:00", "50"),  # bad position
        ("D", "20", "70", "2024-01-02 00:00:00", "--"),  # missing value
        (None, "NA", "", " ", None),  # empty
    ]
    raw = spark.createDataFrame(rows, schema)
    numeric = ["Latitude", "Longitude", HUMIDITY]
    out = c.clean(raw, "Humidity")
    assert out.columns == ["Station", "Latitude", "Longitude", time, HUMIDITY]
    found = {r["Station"]: (r[time], r[HUMIDITY]) for r in out.collect()}
    day = dt.datetime(2024, 1, 2)
    assert found == {"A": (day, 50.0), "B": (day, None), "D": (day, None)}
    report = c.cleaning_report(c.fold_copies(raw), "x", "Humidity", numeric).first().asDict()
    assert report == {
        "dataset_name": "x", "category": "Humidity", "rows_before": 6, "rows_after": 3, "duplicate_rows_removed": 1,
        "empty_rows_removed": 1, "invalid_coordinates_removed": 1, "invalid_sensor_values_removed": 1,
        "rows_with_missing_values": 2, "rows_removed": 3, "status": "CLEANED",
    }


def test_cleaning_status(spark):
    schema = f"a string, `{HUMIDITY}` string"
    fine = spark.createDataFrame([("x", "5")], schema)
    assert c.cleaning_report(c.fold_copies(fine), "x", "Humidity", [HUMIDITY]).first()["status"] == "CLEAN"
    gone = spark.createDataFrame([(None, "NA")], schema)
    assert c.cleaning_report(c.fold_copies(gone), "x", "Humidity", [HUMIDITY]).first()["status"] == "EMPTY_AFTER_CLEANING"


def test_standardise(spark):
    df = spark.createDataFrame([(" S1 ", "5", "01-02-2024")], "site string, Latitude_deg string, `Reading Date` string")
    row = c.standardise(df, "ds", "f.csv").first().asDict()
    assert row["timestamp"] == dt.datetime(2024, 2, 1)
    assert (row["station"], row["latitude"], row["longitude"], row["district"]) == ("S1", 5.0, None, None)
    assert (row["source_dataset"], row["source_file"], row["site"]) == ("ds", "f.csv", " S1 ")


def test_names(spark):
    assert names.find_role(["x", "Sub District", "district"], "district") == "district"
    assert names.find_role(["x", "Sub District"], "district") == "Sub District"
    assert names.find_audit_role(["River Station Id", "Station"], "station") == "River Station Id"
    assert names.find_coordinates(["lat", "Latitude", "lon"]) == ("Latitude", "lon")
    found = values(spark, ["GWL_x", "my groundwater", "temp 2021", "zzz"], lambda n: names.category_of(n, CLEANING_FILE_KEYWORDS, "Unknown"))
    assert found == ["Groundwater", "Groundwater", "Temperature", "Unknown"]


def test_column_order(spark):
    df = spark.createDataFrame([(1, 2, 3)], "new int, b int, a int")
    assert c.keep_column_order(df, [" a ", "gone", "b"]).columns == ["a", "b", "new"]
