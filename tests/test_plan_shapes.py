"""What Spark plans for the heavy steps."""

import re

import pytest

from sensorloom.config import CATEGORIES, TargetSpec, default_features
from sensorloom.operators.district_day import district_day, station_days
from sensorloom.operators.drift import drift_status
from sensorloom.operators.features import build_features
from sensorloom.operators.master import join_categories, join_stored, master_table, one_category, outer_join, store_by_key
from sensorloom.operators.merge import merge_all, merge_pair
from sensorloom.operators.target import with_target
from sensorloom.plans import registry, views
from sensorloom.sources.scratch import written

registry.load_all()


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def count(pattern: str, text: str) -> int:
    return len(re.findall(pattern, text))


def test_all_features_share_one_exchange_and_one_sort(spark, sf):
    master = written(views.master(spark, sf))
    text = plan(with_target(build_features(master, default_features()), TargetSpec()))
    assert count(r"Exchange hashpartitioning", text) == 1
    assert count(r"\bSort \[", text) == 1


def test_readings_are_hashed_before_they_are_shuffled(spark, sf):
    text = plan(station_days(views.readings(spark, sf)))
    assert "SortAggregate" not in text and "ObjectHashAggregate" not in text
    # The first aggregate sits below the only exchange of the readings themselves.
    assert text.index("Exchange hashpartitioning") < text.rindex("HashAggregate")


def test_filters_and_columns_reach_the_scan(spark, sf):
    text = plan(views.table(spark, sf, "lineitem").where("l_quantity > 40").select("l_orderkey"))
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,40.0)]" in text
    scan = plan(station_days(views.readings(spark, sf)))
    assert "l_comment" not in scan and "l_returnflag" not in scan


def test_split_folders_are_pruned(spark, sf):
    table = written(views.split(spark, sf), "split")
    assert "PartitionFilters: [isnotnull(split" in plan(table.where("split = 'test'"))


@pytest.mark.parametrize("name", ["d01_district_day", "c02b_master_by_pivot", "e16_feature_table", "e13_chronological_split", "b01_sentinels_to_null", "d12_audit_report", "g04_schema_drift", "g04b_schema_status"])
def test_no_python_and_no_cross_join(spark, sf, name):
    text = plan(registry.QUERIES[name](spark, sf))
    assert not re.search(r"Python|Pandas|CartesianProduct|BroadcastNestedLoopJoin", text)


def test_drift_reads_its_relation_once(spark):
    rows = spark.createDataFrame([("c", "f", "x", "int", 0)], "category string, dataset string, column string, data_type string, position int")
    text = plan(drift_status(written(rows)))
    assert count(r"Scan parquet", text) == 1 and "Join" not in text


def test_district_day_shuffles_twice(spark, sf):
    text = plan(district_day(views.readings(spark, sf)))
    assert count(r"Exchange hashpartitioning", text) == 2


def test_stored_categories_meet_without_an_exchange(spark, sf):
    daily = views.daily(spark, sf)
    stored = store_by_key(daily, 4)
    names = [c.name for c in CATEGORIES]
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as tables of any size are joined
    try:
        pair = plan(outer_join(one_category(stored, names[0]), one_category(stored, names[1])))
        folded, joined, pivot = plan(join_categories({n: one_category(stored, n) for n in names})), join_stored(stored), master_table(stored)
        assert "Exchange" not in pair and "Exchange" not in plan(joined) and "Exchange" not in plan(pivot)
        # Only results of joins are shuffled, never a scan.
        assert not re.search(r"Exchange[^\n]*\n[^\n]*(?:Project|Filter|FileScan)[^\n]*(?:\n[^\n]*(?:Project|Filter|ColumnarToRow)[^\n]*)*\n[^\n]*FileScan", folded)
        assert joined.select(*pivot.columns).exceptAll(pivot).count() == 0 and joined.count() == pivot.count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def scans(spark, run) -> list[tuple[str, str]]:
    """Folder and columns of every file scan that run() executes, by the plans Spark ended with."""
    store = spark._jsparkSession.sharedState().statusStore()
    plans = store.executionsList()
    before = max((plans.apply(i).executionId() for i in range(plans.size())), default=-1)
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    found, plans = [], store.executionsList()
    for i in range(plans.size()):  # the last thousand are kept
        if plans.apply(i).executionId() <= before:
            continue
        text = plans.apply(i).physicalPlanDescription()
        tree = text.split("\n\n\n")[0].split("Initial Plan")[0]
        for node in re.findall(r"Scan parquet\s+\((\d+)\)", tree):
            detail = re.search(rf"\n\({node}\) Scan parquet.*?(?=\n\n)", text, re.S)[0]
            found.append((re.search(r"Location: .*?/([^/\]]+)\]", detail)[1], re.search(r"ReadSchema: (.*)", detail)[1]))
    return found


def folder(df) -> str:
    return df.inputFiles()[0].rsplit("/", 2)[-2]


@pytest.mark.parametrize("many", [None, 0, 1])
def test_a_merge_reads_keys_once_and_rows_once(spark, many):
    rows = "timestamp timestamp_ntz, station string, {} double"
    day = "2024-01-0{}T00:00:00"
    sides = []
    for i, name in enumerate(("value", "other")):
        data = [(day.format(d), f"S{d}", float(d)) for d in range(1 + i, 6 + i)] + ([(day.format(3), "S3", 9.0)] if many == i else [])
        df = spark.createDataFrame(data, rows.format(name).replace("timestamp_ntz", "string"))
        sides.append(written(df.withColumn("timestamp", df["timestamp"].cast("timestamp_ntz"))))
    names = [folder(s) for s in sides]
    step = {}
    read = scans(spark, lambda: step.update(merge_pair(*sides, "a", "b")[1]))
    for name, column in zip(names, ("value", "other"), strict=True):
        mine = [schema for at, schema in read if at == name]
        assert sorted(column in schema for schema in mine) == [False, True], mine
    assert (step["matched_rows"], step["left_only_rows"], step["right_only_rows"]) == ((4, 1, 1) if many is None else (5, 1, 1))


def test_a_fold_reads_no_result_for_its_guard(spark):
    frames = []
    for i in range(3):
        df = spark.createDataFrame([(f"2024-01-0{d}T00:00:00", f"S{d}", float(d)) for d in range(1 + i, 6 + i)], f"timestamp string, station string, v{i} double")
        frames.append(written(df.withColumn("timestamp", df["timestamp"].cast("timestamp_ntz"))))
    names = [folder(f) for f in frames]
    read = scans(spark, lambda: merge_all(frames))
    assert sorted(at for at, _ in read if at in names) == sorted(names * 2)
    # The first result is read by the second join only: all its columns, once.
    assert sum("v0" in schema and "v1" in schema for _, schema in read) == 1
