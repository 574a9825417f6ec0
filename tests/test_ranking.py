import pytest

from sensorloom.operators.audit import audit_report, district_list, name_present
from sensorloom.operators.ranking import ranked


def test_ranks_follow_the_order_over_all_ranges(spark):
    df = spark.range(5_000).selectExpr("(id * 7919) % 5000 as v").repartition(7)
    rows = ranked(df, ["v"]).collect()
    assert sorted((r["rank"], r["v"]) for r in rows) == [(i + 1, i) for i in range(5_000)]


def test_ranks_begin_anew_in_each_group(spark):
    data = [(g, x) for g, n in ((None, 3), ("a", 400), ("b", 1)) for x in range(n)]
    rows = ranked(spark.createDataFrame(data, "g string, x int").repartition(5), ["x"], ["g"]).collect()
    assert sorted(((r["g"] or "", r["x"], r["rank"]) for r in rows)) == sorted((g or "", x, x + 1) for g, x in data)
    assert ranked(spark.createDataFrame([], "g string, x int"), ["x"], ["g"]).count() == 0


def test_lists_of_districts(spark):
    df = spark.createDataFrame([(" B ", 1), ("A", 2), (None, 3), ("B", 4), ("Ahmedabad City", 5)], "District string, v int")
    assert [(r["rank"], r["district"]) for r in district_list(df).orderBy("rank").collect()] == [(1, "A"), (2, "Ahmedabad City"), (3, "B")]
    assert name_present(df, "AHMEDABAD").first()[0] is True and name_present(df, "x").first()[0] is False
    report = audit_report(df, "d", "ahmedabad").first()
    assert (report["n_districts"], report["name_present"]) == (3, True)
    bare = df.select("v")
    assert district_list(bare).count() == 0 and name_present(bare, "x").first()[0] is None
    assert audit_report(bare, "d", "x").first()["n_districts"] is None


@pytest.mark.parametrize("word", ["collect_list", "collect_set"])
def test_no_names_are_gathered(spark, word):
    from sensorloom.operators import audit

    assert word not in open(audit.__file__).read()
