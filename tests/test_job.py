import pytest
from pyspark.sql import functions as F

from sensorloom.config import CATEGORIES, COUNTS, MASTER_COLUMNS, MEASURES
from sensorloom.errors import DataCheckError
from sensorloom.operators.district_day import aggregate_violations, district_day, require_categories, sorted_for_people
from sensorloom.operators.master import join_categories, join_steps, match_counts, master_table, one_category
from sensorloom.plans import views
from sensorloom.plans.build import JobSpec, clean_readings, run_job, score
from sensorloom.sources.files import SplitBundle, file_inventory, read_master, read_table
from sensorloom.sources.fingerprint import table_fingerprint
from sensorloom.sources.scratch import written
from sensorloom.sources.sinks import write_cleaned_csv

STEMS = {"groundwater": "gwl_tel", "humidity": "humid_tel", "rainfall": "rainfall_tel", "river_level": "rwl_tel", "temperature": "temperature"}


@pytest.fixture(scope="module")
def raw_files(spark, sf, tmp_path_factory):
    """The readings as raw CSV files, one folder for each category."""
    root = tmp_path_factory.mktemp("raw")
    rows = views.readings(spark, sf)
    paths = {}
    for c in CATEGORIES:
        path = str(root / STEMS[c.name])
        rows.where(F.col("category") == c.name).select(
            F.concat(F.lit(" S"), F.col("station")).alias(" Station"),
            F.col("district_code").alias("District LGD Code"),
            F.col("district").alias("District"),
            F.lit("22.5").alias("Latitude"),
            F.lit("71.5").alias("Longitude"),
            F.date_format("ts", "dd-MM-yyyy HH:mm").alias("Data Acquisition Time"),
            F.coalesce(F.col("measurement").cast("string"), F.lit("--")).alias(c.raw_column),
        ).write.csv(path, header=True)
        paths[c.name] = path
    return paths


@pytest.fixture(scope="module")
def job(spark, raw_files, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("job"))
    spec = JobSpec(models={"RandomForestRegressor": {"numTrees": 3, "maxDepth": 3}, "GBTRegressor": {"maxIter": 2, "maxDepth": 2}})
    return out, run_job(spark, raw_files, out, spec)


def test_job_writes_every_stage(spark, job):
    out, champion = job
    assert champion in ("RandomForestRegressor", "GBTRegressor")
    features = read_table(spark, f"{out}/features")
    assert len(features.columns) == len(MASTER_COLUMNS) + 65
    splits = {r["split"]: r["n_rows"] for r in spark.read.json(f"{out}/reports/splits").collect()}
    stats = read_table(spark, f"{out}/targeted").where("target IS NOT NULL").count()
    assert sum(splits.values()) == stats
    prep = spark.read.json(f"{out}/reports/preparation").first()
    ready = SplitBundle.load(spark, f"{out}/prepared")
    assert len(ready.train.columns) - 1 == prep["output_feature_count"]


def test_job_reports_on_every_file(spark, job, raw_files):
    out, _ = job
    for name in STEMS.values():
        cleaning = spark.read.json(f"{out}/reports/cleaning/{name}").first()
        assert cleaning["rows_after"] == read_table(spark, f"{out}/cleaned/{name}").count()
        assert cleaning["rows_before"] - cleaning["duplicate_rows_removed"] == cleaning["rows_after"]
        audit = spark.read.json(f"{out}/reports/audit/{name}").first()
        assert (audit["duplicate_rows"], audit["latitude_min"], audit["longitude_max"]) == (0, 22.5, 71.5)
        assert spark.read.json(f"{out}/reports/profile/{name}").count() == 7
    assert {r["status"] for r in spark.read.json(f"{out}/reports/schemas").collect()} == {"PASS"}


def test_files_of_a_category_may_order_their_columns_differently(spark, raw_files, tmp_path):
    first = spark.read.csv(raw_files["rainfall"], header=True)
    a, b = str(tmp_path / "rainfall_2021"), str(tmp_path / "rainfall_2022")
    first.where("`District LGD Code` % 2 = 0").write.csv(a, header=True)
    first.where("`District LGD Code` % 2 = 1").select(*reversed(first.columns)).write.csv(b, header=True)
    split = clean_readings(spark, {"rainfall": [a, b]}, str(tmp_path / "two"))
    whole = clean_readings(spark, {"rainfall": raw_files["rainfall"]}, str(tmp_path / "one"))
    assert split.exceptAll(whole).count() == 0 and split.count() == whole.count()


def test_job_scores_new_rows(spark, job):
    out, _ = job
    ready = SplitBundle.load(spark, f"{out}/prepared")
    scored = score(spark, ready.test, f"{out}/champion", keep=["target"])
    assert scored.count() == ready.test.count()
    assert scored.where("prediction IS NULL").count() == 0


def test_master_from_files_is_the_master_from_views(spark, sf, job):
    # The raw files go through de-duplication, so the readings are made distinct here as well.
    out, _ = job
    rows = views.readings(spark, sf).distinct().where("measurement IS NOT NULL")
    want = master_table(district_day(rows.withColumn("station", F.concat(F.lit("S"), "station"))))
    got = read_table(spark, f"{out}/master")
    assert got.exceptAll(want.select(*got.columns)).count() == 0 and got.count() == want.count()


def test_identities(spark, sf):
    daily = written(views.daily(spark, sf))
    frames = {c.name: one_category(daily, c.name) for c in CATEGORIES}
    steps = join_steps(frames).orderBy("step").collect()
    for s in steps:
        assert s["matched_rows"] + s["left_only_rows"] + s["right_only_rows"] == s["rows_after"]
        assert s["matched_rows"] + s["left_only_rows"] == s["rows_before_left"]
        assert s["matched_rows"] + s["right_only_rows"] == s["rows_before_right"]
    first = match_counts(frames["groundwater"], frames["humidity"]).first()
    assert first["rows_after"] == steps[0]["rows_after"]
    master = master_table(daily)
    assert steps[-1]["rows_after"] == master.count()
    folded = join_categories(frames).select(*MASTER_COLUMNS)
    assert folded.exceptAll(master).count() == 0 and folded.count() == master.count()
    for measure, count in zip(MEASURES, COUNTS):
        assert master.where(f"({measure} IS NULL) <> ({count} IS NULL)").count() == 0
    assert aggregate_violations(daily).where("n_rows > 0").count() == 0


def test_missing_category_raises(spark, sf):
    with pytest.raises(DataCheckError):
        require_categories(views.readings(spark, sf).where("category <> 'rainfall'"))


def test_label_skips_missing_names_and_takes_the_earliest(spark):
    rows = [
        ("humidity", 1, None, "A", "2024-01-01 00:00:00", 1.0),
        ("humidity", 1, "late", "A", "2024-01-01 09:00:00", 3.0),
        ("humidity", 1, "early", "B", "2024-01-01 05:00:00", 5.0),
        ("humidity", 1, "unused", "C", "2024-01-01 01:00:00", None),
        ("rainfall", 1, None, "A", "2024-01-01 01:00:00", 2.0),
        ("rainfall", 1, None, "A", "2024-01-01 02:00:00", 2.5),
    ]
    df = spark.createDataFrame(rows, "category string, district_code bigint, district string, station string, ts string, measurement double")
    out = {r["category"]: r for r in district_day(df.withColumn("ts", F.col("ts").cast("timestamp_ntz"))).collect()}
    assert (out["humidity"]["measurement"], out["humidity"]["station_count"], out["humidity"]["district"]) == (3.0, 2, "early")
    assert (out["rainfall"]["measurement"], out["rainfall"]["station_count"], out["rainfall"]["district"]) == (4.5, 1, None)


def test_inventory(spark, raw_files, tmp_path):
    folder = tmp_path / "raw data"
    (folder / "sub").mkdir(parents=True)
    (folder / "GWL tel.csv").write_text("a\n1\n")
    (folder / "sub" / "other.csv").write_text("a\n")
    (folder / "sub" / "note.txt").write_text("x")
    found = {r["dataset_name"]: r for r in file_inventory(spark, str(folder)).collect()}
    assert set(found) == {"GWL tel", "other"}
    gwl = found["GWL tel"]
    assert (gwl["category"], gwl["relative_path"], gwl["file_size"], gwl["extension"], gwl["status"]) == (
        "Groundwater", "raw data/GWL tel.csv", 4, ".csv", "RAW",
    )
    assert gwl["absolute_path"] == str(folder / "GWL tel.csv")
    assert (found["other"]["category"], found["other"]["parent_folder"]) == ("Unknown", "sub")


def test_sinks_and_guards(spark, tmp_path):
    one, two = spark.range(1), spark.range(5)
    path = str(tmp_path / "x")
    write_cleaned_csv(one, path)
    write_cleaned_csv(two, path)
    assert spark.read.csv(path, header=True).count() == 1
    write_cleaned_csv(two, path, force=True)
    assert spark.read.csv(path, header=True).count() == 5
    two.where("id > 9").write.parquet(str(tmp_path / "empty"))
    with pytest.raises(DataCheckError):
        read_table(spark, str(tmp_path / "empty"))
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        read_master(spark, str(tmp_path / "absent"))


def test_fingerprint_ignores_order_and_partitions(spark, sf):
    line = views.table(spark, sf, "lineitem")
    for secure in (True, False):
        a = table_fingerprint(line, secure=secure).first()
        assert a == table_fingerprint(line.repartition(7).orderBy("l_partkey"), secure=secure).first()
        changed = line.withColumn("l_tax", F.when(F.col("l_orderkey") == 1, 9.0).otherwise(F.col("l_tax")))
        assert a != table_fingerprint(changed, secure=secure).first()


def test_sorted_for_people_puts_null_last(spark):
    df = spark.createDataFrame([(None,), (2,), (1,)], "k int")
    assert [r[0] for r in sorted_for_people(df, "k").collect()] == [1, 2, None]


def test_fingerprint_tells_cells_apart(spark):
    rows = [("a|b", "c"), ("a", "b|c"), ("a", None), ("a", "\\N"), ("a", "-"), ("a", ""), ("1:a", "")]
    digests = {table_fingerprint(spark.createDataFrame([r], "x string, y string")).first()["digest_sum_4"] for r in rows}
    assert len(digests) == len(rows)
    typed = [table_fingerprint(spark.createDataFrame([(1,)], f"x {t}")).first() for t in ("int", "bigint")]
    assert typed[0] != typed[1]
