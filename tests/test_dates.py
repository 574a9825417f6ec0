import datetime as dt

import pytest

from sensorloom.functions.casts import to_moment
from sensorloom.operators.clean import clean, column_votes, convert_datetimes, date_votes, fold_copies

from pyspark.sql import functions as F

D = dt.datetime
CASES = [
    ("2024-03-05 06:07:08", D(2024, 3, 5, 6, 7, 8)),
    ("2024-03-05T06:07:08.250Z", D(2024, 3, 5, 6, 7, 8, 250_000)),
    ("2024-03-05 06:07:08+05:30", D(2024, 3, 5, 6, 7, 8)),
    ("2024-03-05 06:07 -0800", D(2024, 3, 5, 6, 7)),
    ("2024/3/5", D(2024, 3, 5)),
    ("05-03-2024 06:07", D(2024, 3, 5, 6, 7)),
    ("5.3.24", D(2024, 3, 5)),
    ("5/3/69", D(1969, 3, 5)),
    ("5/3/68 1:02", D(2068, 3, 5, 1, 2)),
    ("03/25/2024", D(2024, 3, 25)),
    ("5 March 2024", D(2024, 3, 5)),
    ("05-Mar-24 11:30 PM", D(2024, 3, 5, 23, 30)),
    ("Mar 5, 2024 12:05:09 am", D(2024, 3, 5, 0, 5, 9)),
    ("Tue, 05 Mar 2024 12:00:00 GMT", D(2024, 3, 5, 12)),
    ("5th Sept. 2024", D(2024, 9, 5)),
    ("2024-Mar-05 5 p.m.", D(2024, 3, 5, 17)),
    ("5/3/2024 9 AM", D(2024, 3, 5, 9)),
    ("5/3/2024 13:00 PM", None),
    ("32/01/2024", None),
    ("31 Feb 2024", None),
    ("not a time", None),
    ("marching 5", None),
    ("", None),
    (None, None),
]


def test_texts_of_moments(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "i int, t string")
    found = {r["i"]: r["m"] for r in df.select("i", to_moment(F.col("t")).alias("m")).collect()}
    assert [(CASES[i][0], found[i]) for i in range(len(CASES))] == CASES


@pytest.mark.parametrize(("texts", "day_first"), [(["01/02/2024", "02/13/2024"], False), (["01/02/2024", "13/02/2024"], True), (["01/02/2024"], True), ([None, "13/02/24", "02/13/24", "2/14/24"], False)])
def test_a_column_settles_the_order(spark, texts, day_first):
    df = spark.createDataFrame([(t, "1", "2024-01-02") for t in texts], "reading_time string, v string, `Date` string")
    votes = {r["column"]: r["day_first"] for r in date_votes(df).collect()}
    assert votes == {"reading_time": day_first, "Date": True}
    assert column_votes(fold_copies(df)) == (["v"], votes)
    rows = [r["reading_time"] for r in convert_datetimes(df, day_first=votes).collect()]
    cleaned = [r["reading_time"] for r in clean(df, "Humidity").collect()]
    if texts[0]:
        assert rows[0] == (D(2024, 2, 1) if day_first else D(2024, 1, 2)) and rows[0] in cleaned
    assert date_votes(df.select("v")).count() == 0


def test_few_patterns_read_a_moment(spark):
    # Each pattern is a pass over every text of a column; months and hours of two halves have one each.
    plan = spark.range(1).select(F.col("id").cast("string").alias("t")).select(to_moment(F.col("t")).alias("m"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_replace") < 25
    texts = ["Sat, 1 Feb 2020 12:05 am", "feb 1, 2020 011:05:06.5 P.M.", "2020-02-01T10:00:00Z", "1 Jan Feb 2020"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    found = [r["m"] for r in df.select("i", to_moment(F.col("t")).alias("m")).orderBy("i").collect()]
    assert found == [D(2020, 2, 1, 0, 5), D(2020, 2, 1, 23, 5, 6, 500_000), D(2020, 2, 1, 10), None]


@pytest.mark.parametrize("day_first", [True, False])
def test_years_and_named_months_share_the_patterns_of_their_order(spark, day_first):
    texts = ["5 Mar 69", "Mar 5, 68", "5/3/69", "2-Apr-2021 9 PM", "April 2nd, 21", "31 Feb 21", "2021 Apr 2", "5 Mar 123"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", to_moment(F.col("t"), day_first).alias("m"))
    assert df._jdf.queryExecution().analyzed().toString().count("regexp_replace") < 16
    ambiguous = D(1969, 3, 5) if day_first else D(1969, 5, 3)
    want = [D(1969, 3, 5), D(2068, 3, 5), ambiguous, D(2021, 4, 2, 21), D(2021, 4, 2), None, D(2021, 4, 2), None]
    assert [r["m"] for r in df.orderBy("i").collect()] == want
