from sensorloom.operators.checks import null_counts
from sensorloom.operators.profile import column_profile, describe_all


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(1.0, 1.5), (float("nan"), float("nan")), (3.0, None)], "x double, y float")
    x, y = column_profile(df).orderBy("column").collect()
    assert (x["n_missing"], x["n_distinct"], x["minimum"], x["maximum"], x["mean"]) == (1, 2, 1.0, 3.0, 2.0)
    assert (y["data_type"], y["n_missing"], y["n_distinct"]) == ("float", 2, 1)
    d = describe_all(df).where("column = 'x'").first()
    assert (d["count"], d["mean"], d["max"], d["p50"]) == (2, 2.0, 3.0, 2.0)
    assert {r["column"]: r["n_null"] for r in null_counts(df).collect()} == {"x": 1, "y": 2}
