import pytest

from sensorloom.functions.casts import canonical_number
from sensorloom.operators.clean import COPIES, distinct_by_value, respelled, fold_copies
from pyspark.sql import functions as F

SAME = [("1", ["1", "1.0", "+1.00", "01", "1.", "001.000", "1e0", "10e-1"]), ("0", ["0", "-0", "0.0", "-0.00", ".0"]), ("-0.5", ["-0.5", "-.5", "-00.50", "-5e-1"]),
        ("100", ["100", "1e2", "100.0"]), ("9007199254740993", ["9007199254740993", "9007199254740993.0"]), ("9007199254740992", ["9007199254740992"]), (None, ["x", "", "1,5", "nan", "1.5d"])]


def test_one_spelling_for_each_number(spark):
    df = spark.createDataFrame([(want, text) for want, texts in SAME for text in texts], "want string, text string")
    rows = df.select("want", "text", canonical_number(F.col("text")).alias("found")).collect()
    assert [(r["text"], r["found"]) for r in rows] == [(r["text"], r["want"]) for r in rows]


def test_rows_of_equal_values_are_one(spark):
    rows = [("A", "1.0", "2024-01-02"), ("A", "1.00", "02/01/2024"), ("A", "1", "2 Jan 2024"), ("A", "2", "13/01/2024"), ("A", None, None), ("A", "NA", ""), ("007", "1", "2024-01-02")]
    df = spark.createDataFrame(rows, "station string, value string, reading_time string")
    assert respelled(fold_copies(df)) == (["value"], ["reading_time"])
    found = sorted((r["station"], r["value"] or "", r["reading_time"] or "", r[COPIES]) for r in distinct_by_value(df).collect())
    assert found == [("007", "1", "2024-01-02 00:00:00", 1), ("A", "", "", 2), ("A", "1", "2024-01-02 00:00:00", 3), ("A", "2", "2024-01-13 00:00:00", 1)]


@pytest.mark.parametrize("other", ["x", "-1 m"])
def test_a_column_with_words_is_compared_as_text(spark, other):
    df = spark.createDataFrame([("1.0",), ("1.00",), (other,)], "value string")
    assert sorted(r["value"] for r in distinct_by_value(df).collect()) == sorted(["1.0", "1.00", other])
    assert distinct_by_value(df.limit(0)).count() == 0


def test_other_spellings_are_those_canonical_number_changes(spark):
    from sensorloom.functions.casts import other_spelling

    texts = ["0", "-0", "00", "1", "+1", "01", "1.", "1.0", "0.5", "-.5", "-0.50", "1e3", "1000", "1.0E20", "inf", "NaN", "abc", "", None]
    c = F.col("text")
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select(c, (canonical_number(c) != c).alias("changed"), other_spelling(c).alias("other")).collect()
    assert [(r["text"], bool(r["changed"])) for r in rows] == [(r["text"], bool(r["other"])) for r in rows]
