"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from sensorloom.config import CATEGORIES, MEASURES, TargetSpec, default_features
from sensorloom.operators.audit import audit_report
from sensorloom.operators.clean import clean
from sensorloom.operators.district_day import district_day
from sensorloom.operators.features import build_features, lag_features, rolling_features, spell_features
from sensorloom.operators.master import join_categories, join_stored, master_table, one_category, store_by_key
from sensorloom.operators.prep import fit_transform
from sensorloom.operators.profile import column_profile, describe_all
from sensorloom.operators.target import with_target
from sensorloom.plans import registry, views
from sensorloom.session import SETTINGS
from sensorloom.sources.files import read_raw_csv
from sensorloom.sources.scratch import scratch_folder, written

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "2"))
BASELINE_READINGS = 27_000_000


def session() -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("sensorloom-bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def run(df) -> None:
    """Compute every row of every column, and keep none."""
    df.write.format("noop").mode("overwrite").save()


def baseline_readings(spark: SparkSession, readings):
    """As many readings as the baseline has (27 million), in 16 files: copies at other hours of the day and stations."""
    n = readings.count()
    copies = max(1, round(BASELINE_READINGS / n)) if n > 100_000 else 1
    rows = readings.crossJoin(F.broadcast(spark.range(copies).withColumnRenamed("id", "copy")))  # a few dozen numbers
    hour = F.make_dt_interval(hours=(F.col("copy") % 24).cast("int"))
    rows = rows.withColumns({"ts": F.date_trunc("day", "ts").cast("timestamp_ntz") + hour, "station": F.col("station") + F.floor(F.col("copy") / 24) * 100_000})
    return written(rows.drop("copy").repartition(16))


def cases(spark: SparkSession) -> dict:
    """Each case with the table it starts from, as the stages of the job do."""
    readings = written(views.readings(spark, SF_DIR))
    daily = written(views.daily(spark, SF_DIR))
    master = written(views.master(spark, SF_DIR))
    split = written(views.split(spark, SF_DIR))
    # Raw files come in several parts, as the yearly files of a category do.
    raw = scratch_folder(spark)
    verbatim = {"header": True, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    views.dirty(spark, SF_DIR).repartition(int(CPUS)).write.options(**verbatim).csv(raw)
    text = read_raw_csv(spark, raw, columns=views.DIRTY_COLUMNS)
    cleaned = written(clean(text, "Humidity", views.DIRTY_NUMERIC))
    spec = default_features()
    many = baseline_readings(spark, readings)
    features = written(with_target(build_features(master, default_features()), TargetSpec()))
    dated = features.withColumn("split", F.when(F.col("date") < "1996-01-01", "train").when(F.col("date") < "1997-06-01", "validation").otherwise("test"))
    wide = written(dated.where("target IS NOT NULL"))
    frames = {c.name: one_category(daily, c.name) for c in CATEGORIES}
    stored = store_by_key(daily)
    queries = registry.QUERIES
    return {
        "d01_district_day": lambda: run(queries["d01_district_day"](spark, SF_DIR)),
        "d01_from_readings": lambda: run(district_day(readings)),
        "d01_27m_readings": lambda: run(district_day(many)),
        "c02_master_by_joins": lambda: run(join_categories(frames)),
        "c02b_master_by_pivot": lambda: run(master_table(daily)),
        "c02c_master_from_stored": lambda: run(join_stored(stored)),
        "c02d_pivot_of_stored": lambda: run(master_table(stored)),
        "e01_lags": lambda: run(lag_features(master, spec.lags)),
        "e02_to_e06_rolling": lambda: run(rolling_features(master, spec.rolling)),
        "e09_spells": lambda: run(spell_features(master, spec.trends)),
        "e16_feature_table": lambda: run(build_features(master, spec)),
        "e13_chronological_split": lambda: run(queries["e13_chronological_split"](spark, SF_DIR)),
        "k06_preparation": lambda: run(fit_transform(split.select("district_code", "date", "district", *MEASURES, "split", "target"))[0]),
        "k06_all_features": lambda: run(fit_transform(wide)[0]),
        "b22_clean_with_vote": lambda: run(clean(text, "Humidity")),
        "b22_clean": lambda: run(clean(text, "Humidity", views.DIRTY_NUMERIC)),
        "d04_profile": lambda: run(column_profile(readings)),
        "d12_audit": lambda: run(audit_report(cleaned, "humidity", "ahmedabad")),
        "d18_describe": lambda: run(describe_all(master)),
        "chain_readings_to_features": lambda: run(queries["e16_feature_table"](spark, SF_DIR)),
    }


def main() -> None:
    registry.load_all()
    spark = session()
    seconds = {}
    for name, case in cases(spark).items():
        case()  # the first run compiles code
        times = []
        for _ in range(RUNS):
            start = time.perf_counter()
            case()
            times.append(time.perf_counter() - start)
        seconds[name] = round(min(times), 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "total_query_time", "value": total, "unit": "sec", "queries": seconds, "sf": SF_DIR.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
