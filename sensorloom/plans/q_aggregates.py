"""Queries of aggregates, profiles, audits and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.config import CATEGORIES, COUNTS, MASTER_COLUMNS, MEASURES
from sensorloom.functions.scalars import rain_temp_ratio
from sensorloom.operators.audit import (
    audit_report,
    coordinate_ranges,
    distinct_in_role,
    district_list,
    name_present,
    time_range,
)
from sensorloom.operators.checks import null_counts, repeated_keys, repeated_row_count
from sensorloom.operators.clean import clean, clean_missing, cleaning_report, fold_copies
from sensorloom.operators.district_day import (
    aggregate_violations,
    aggregation_report,
    district_day,
    uncovered_categories,
)
from sensorloom.operators.evaluate import prediction_problems, regression_metrics
from sensorloom.operators.feature_checks import feature_table_report, infinite_counts
from sensorloom.operators.master import master_report
from sensorloom.operators.profile import column_profile, describe_all
from sensorloom.operators.ranking import ranked
from sensorloom.operators.split import sparse_train_groups, split_report
from sensorloom.operators.split_checks import constant_columns, split_nulls
from sensorloom.operators.target import leakage_audit, missing_by_group, target_stats
from sensorloom.plans import views as v
from sensorloom.plans.q_windows import METRICS_SQL, PREDICTIONS_SQL, predictions
from sensorloom.plans.registry import query, rounded, sql_r6
from sensorloom.sources.scratch import written

TIME, HUMIDITY = "Data Acquisition Time", v.HUMIDITY_COLUMN


@query(
    "d01_district_day",
    v.on_readings(f"SELECT category, district_code, district, date, {sql_r6('measurement')} AS measurement, station_count FROM district_day"),
)
def district_day_of_lines(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(v.daily(spark, sf))


_EVENT_DAYS_SQL = f"""SELECT category, district_code, CAST(ts AS DATE) AS date, arg_min(district, ts) FILTER (WHERE district IS NOT NULL) AS district,
  {sql_r6("CASE WHEN category = 'rainfall' THEN sum(measurement) ELSE avg(measurement) END")} AS measurement, count(DISTINCT station) AS station_count
  FROM readings_events WHERE measurement IS NOT NULL GROUP BY 1, 2, 3"""


@query("d01b_district_day_of_events", v.on_events(_EVENT_DAYS_SQL))
def district_day_of_events(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(district_day(v.readings_events(spark, sf)))


@query("d02_station_count", v.on_events("SELECT category, district_code, CAST(ts AS DATE) AS date, count(DISTINCT station) AS station_count FROM readings_events WHERE measurement IS NOT NULL GROUP BY 1, 2, 3"))
def station_count(spark: SparkSession, sf: str) -> DataFrame:
    return district_day(v.readings_events(spark, sf)).select("category", "district_code", "date", "station_count")


@query("d03_representative_label", v.on_events("SELECT category, district_code, CAST(ts AS DATE) AS date, arg_min(district, ts) FILTER (WHERE district IS NOT NULL) AS district FROM readings_events WHERE measurement IS NOT NULL GROUP BY 1, 2, 3"))
def representative_label(spark: SparkSession, sf: str) -> DataFrame:
    return district_day(v.readings_events(spark, sf)).select("category", "district_code", "date", "district")


def _profile_sql() -> str:
    parts = []
    for c, t in {"category": "string", "district_code": "bigint", "district": "string", "station": "bigint", "ts": "timestamp_ntz", "measurement": "double"}.items():
        numeric = t in ("bigint", "double")
        lo, hi, mean, std, n = (
            (f"CAST(min({c}) AS DOUBLE)", f"CAST(max({c}) AS DOUBLE)", f"round_even(avg({c}), 4)", f"round_even(stddev_samp({c}), 4)", f"count({c})")
            if numeric
            else ("CAST(NULL AS DOUBLE)",) * 4 + ("CAST(NULL AS BIGINT)",)
        )
        parts.append(
            f"""SELECT '{c}' AS "column", '{t}' AS data_type, count(*) - count({c}) AS n_missing, round_even(100.0 * (count(*) - count({c})) / count(*), 2) AS missing_percent,
            count(DISTINCT {c}) AS n_distinct, {lo} AS minimum, {hi} AS maximum, {mean} AS mean, {std} AS std, {n} AS n_values FROM readings"""
        )
    return " UNION ALL ".join(parts)


@query("d04_column_profile", v.on_readings(_profile_sql()))
def profile(spark: SparkSession, sf: str) -> DataFrame:
    return column_profile(v.readings(spark, sf))


def _cleaned(spark: SparkSession, sf: str) -> DataFrame:
    return clean(v.dirty(spark, sf), "Humidity", v.DIRTY_NUMERIC)


@query("d05_time_range", v.on_dirty(f'SELECT min("{TIME}") AS earliest, max("{TIME}") AS latest FROM cleaned'))
def timestamps(spark: SparkSession, sf: str) -> DataFrame:
    return time_range(_cleaned(spark, sf))


@query(
    "d06_coordinate_ranges",
    v.on_dirty("""SELECT min(TRY_CAST("Latitude" AS DOUBLE)) AS latitude_min, max(TRY_CAST("Latitude" AS DOUBLE)) AS latitude_max,
      min(TRY_CAST("Longitude" AS DOUBLE)) AS longitude_min, max(TRY_CAST("Longitude" AS DOUBLE)) AS longitude_max FROM stripped"""),
)
def coordinates(spark: SparkSession, sf: str) -> DataFrame:
    return coordinate_ranges(clean_missing(v.dirty(spark, sf)))


@query("d07_distinct_stations", v.on_dirty('SELECT count(DISTINCT "Station") AS n_distinct FROM cleaned'))
def distinct_stations(spark: SparkSession, sf: str) -> DataFrame:
    return distinct_in_role(_cleaned(spark, sf), "station")


@query(
    "d08_district_names",
    v.on_dirty("""SELECT row_number() OVER (ORDER BY name) AS rank, name AS district FROM (SELECT DISTINCT "District" AS name FROM cleaned WHERE "District" IS NOT NULL)"""),
)
def names_of_districts(spark: SparkSession, sf: str) -> DataFrame:
    return district_list(_cleaned(spark, sf))


@query(
    "d08b_name_present",
    v.on_dirty("""SELECT coalesce(bool_or(contains(lower("District"), 'district 17')), FALSE) AS name_present FROM cleaned"""),
)
def name_is_present(spark: SparkSession, sf: str) -> DataFrame:
    return name_present(_cleaned(spark, sf), "District 17")


@query(
    "d08c_stations_by_category",
    v.on_events("""SELECT category, station, row_number() OVER (PARTITION BY category ORDER BY station) AS rank FROM (SELECT DISTINCT category, station FROM readings_events)"""),
)
def stations_by_category(spark: SparkSession, sf: str) -> DataFrame:
    """The sorted list of each category's stations, ranked by ranges."""
    return ranked(v.readings_events(spark, sf).select("category", "station").distinct(), ["station"], ["category"])


@query("d09_null_counts", v.on_dirty(" UNION ALL ".join(f"""SELECT '{c}' AS "column", count(*) - count("{c}") AS n_null FROM cleaned""" for c in v.DIRTY_COLUMNS)))
def nulls(spark: SparkSession, sf: str) -> DataFrame:
    return null_counts(_cleaned(spark, sf))


@query("d10_repeated_rows", v.on_dirty("SELECT CAST(sum(copies - 1) AS BIGINT) AS duplicate_rows FROM (SELECT *, count(*) AS copies FROM dirty GROUP BY ALL)"))
def repeated_rows(spark: SparkSession, sf: str) -> DataFrame:
    return repeated_row_count(v.dirty(spark, sf))


_STATUS = """CASE WHEN n_rows = 0 OR total_missing >= 0.5 * n_rows * n_columns OR duplicate_rows >= 0.2 * n_rows THEN 'FAIL'
  WHEN total_missing >= 0.2 * n_rows * n_columns OR duplicate_rows >= 0.05 * n_rows THEN 'WARNING' ELSE 'PASS' END"""


def _audit_sql(source: str, extra: str = "") -> str:
    missing = " + ".join(f'count(*) - count("{c}")' for c in v.DIRTY_COLUMNS)
    return f"""SELECT dataset_name, n_rows, n_columns, total_missing, duplicate_rows, {extra} {_STATUS} AS status FROM (
      SELECT '{source}' AS dataset_name, count(*) AS n_rows, {len(v.DIRTY_COLUMNS)} AS n_columns, {missing} AS total_missing, count(*) -
        (SELECT count(*) FROM (SELECT DISTINCT * FROM {source})) AS duplicate_rows, min("{TIME}") AS earliest, max("{TIME}") AS latest,
        min("Latitude") AS latitude_min, max("Latitude") AS latitude_max, min("Longitude") AS longitude_min, max("Longitude") AS longitude_max,
        count(DISTINCT "Station") AS n_stations, CAST(count(DISTINCT trim("District")) AS INT) AS n_districts FROM {source})"""


@query("d11_audit_status", v.on_dirty(_audit_sql("stripped") + " UNION ALL " + _audit_sql("cleaned")))
def status_of_tables(spark: SparkSession, sf: str) -> DataFrame:
    columns = ("dataset_name", "n_rows", "n_columns", "total_missing", "duplicate_rows", "status")
    raw = audit_report(clean_missing(v.dirty(spark, sf)), "stripped", "ahmedabad")
    return raw.select(*columns).unionByName(audit_report(_cleaned(spark, sf), "cleaned", "ahmedabad").select(*columns))


_RANGES = ("earliest", "latest", "latitude_min", "latitude_max", "longitude_min", "longitude_max", "n_stations", "n_districts")


@query("d12_audit_report", v.on_dirty(_audit_sql("cleaned", ", ".join(_RANGES) + ",")))
def full_audit(spark: SparkSession, sf: str) -> DataFrame:
    report = audit_report(_cleaned(spark, sf), "cleaned", "ahmedabad")
    return report.select("dataset_name", "n_rows", "n_columns", "total_missing", "duplicate_rows", *_RANGES, "status")


@query(
    "d13_cleaning_report",
    v.on_dirty(f"""SELECT 'humid' AS dataset_name, 'Humidity' AS category, *, rows_before - rows_after AS rows_removed, 'CLEANED' AS status FROM (SELECT
      (SELECT count(*) FROM dirty) AS rows_before, (SELECT count(*) FROM cleaned) AS rows_after,
      (SELECT CAST(sum(copies - 1) AS BIGINT) FROM folded) AS duplicate_rows_removed,
      (SELECT count(*) FROM folded) - (SELECT count(*) FROM filled) AS empty_rows_removed,
      (SELECT count(*) FROM typed) - (SELECT count(*) FROM located) AS invalid_coordinates_removed,
      (SELECT count("{HUMIDITY}") FROM located) - (SELECT count("{HUMIDITY}") FROM cleaned) AS invalid_sensor_values_removed,
      (SELECT count(*) FROM cleaned WHERE {" OR ".join(f'"{c}" IS NULL' for c in v.DIRTY_COLUMNS)}) AS rows_with_missing_values)"""),
)
def cleaning(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning_report(fold_copies(v.dirty(spark, sf)), "humid", "Humidity", v.DIRTY_NUMERIC)


@query(
    "d14_aggregation_report",
    v.sql_with(
        v.READINGS_VIEW
        + f""", i AS (SELECT category, count(*) AS input_rows, count(*) - count(measurement) AS missing_measurements FROM readings GROUP BY 1),
      o AS (SELECT category, count(*) AS output_rows, min(station_count) AS station_count_min, max(station_count) AS station_count_max,
        {sql_r6('avg(station_count)')} AS station_count_mean, median(station_count) AS station_count_median,
        count(DISTINCT district_code) AS district_count, min(date) AS first_date, max(date) AS last_date FROM district_day GROUP BY 1)""",
        f"""SELECT i.*, o.* EXCLUDE (category), {sql_r6('input_rows / output_rows')} AS compression_ratio FROM i JOIN o ON i.category = o.category
      UNION ALL SELECT NULL, CAST(sum(input_rows) AS BIGINT), CAST(sum(missing_measurements) AS BIGINT), CAST(sum(output_rows) AS BIGINT),
        NULL, NULL, NULL, NULL, NULL, NULL, NULL, {sql_r6('sum(input_rows) / sum(output_rows)')} FROM i JOIN o ON i.category = o.category""",
    ),
)
def aggregation(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(aggregation_report(v.readings(spark, sf), written(v.daily(spark, sf))))


@query("d15_repeated_keys", v.on_events("""SELECT district_code, CAST(ts AS DATE) AS date, count(*) AS "count" FROM readings_events GROUP BY 1, 2 HAVING count(*) > 1"""))
def keys_repeated(spark: SparkSession, sf: str) -> DataFrame:
    return repeated_keys(v.readings_events(spark, sf).withColumn("date", F.to_date("ts")), ["district_code", "date"])


@query(
    "d16_value_checks",
    v.on_events("""SELECT unnest(['station count is not positive', 'district code is missing', 'date is missing', 'key is repeated']) AS "rule",
      unnest([count(*) FILTER (WHERE station_count <= 0), count(*) FILTER (WHERE district_code IS NULL), count(*) FILTER (WHERE date IS NULL),
        (SELECT CAST(coalesce(sum(n) FILTER (WHERE n > 1), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM readings_events GROUP BY category, district_code, CAST(ts AS DATE)))]) AS n_rows
      FROM (SELECT district_code, CAST(ts AS DATE) AS date, station % 5 AS station_count FROM readings_events)"""),
)
def value_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Run on rows that break the rules: raw events with a count that may be 0 and keys that repeat."""
    rows = v.readings_events(spark, sf).select(
        "category", "district_code", F.to_date("ts").alias("date"), (F.col("station") % 5).alias("station_count")
    )
    return aggregate_violations(rows)


@query(
    "d17_master_report",
    v.on_readings("""SELECT 'total_rows' AS metric, count(*) AS value FROM master
      UNION ALL SELECT 'duplicate_keys', count(*) - count(DISTINCT (district_code, date)) FROM master """
      + " ".join(f"UNION ALL SELECT 'missing {c}', count(*) - count({c}) FROM master" for c in MASTER_COLUMNS)),
)
def master_validation(spark: SparkSession, sf: str) -> DataFrame:
    return master_report(v.master(spark, sf))


def _describe_sql() -> str:
    parts = []
    for c in ("district_code", *MEASURES, *COUNTS):
        parts.append(f"""SELECT '{c}' AS "column", count({c}) AS "count", {sql_r6(f'avg({c})')} AS mean, {sql_r6(f'stddev_samp({c})')} AS std, {sql_r6(f'CAST(min({c}) AS DOUBLE)')} AS "min",
          {sql_r6(f'CAST(max({c}) AS DOUBLE)')} AS "max", {sql_r6(f'quantile_cont({c}, 0.25)')} AS p25, {sql_r6(f'quantile_cont({c}, 0.5)')} AS p50, {sql_r6(f'quantile_cont({c}, 0.75)')} AS p75,
          CAST(NULL AS BIGINT) AS "unique", CAST(NULL AS VARCHAR) AS top, CAST(NULL AS BIGINT) AS freq FROM master""")
    for c in ("district", "date"):
        parts.append(f"""SELECT '{c}', (SELECT count({c}) FROM master), NULL, NULL, NULL, NULL, NULL, NULL, NULL, count(*),
          arg_min(x, (-n, x)), max(n) FROM (SELECT CAST({c} AS VARCHAR) AS x, count(*) AS n FROM master WHERE {c} IS NOT NULL GROUP BY 1)""")
    return " UNION ALL ".join(parts)


@query("d18_describe", v.on_readings(_describe_sql()))
def describe(spark: SparkSession, sf: str) -> DataFrame:
    # The description takes several passes, so the table is written once.
    return rounded(describe_all(written(v.master(spark, sf))))


_RATIO_SQL = """
ratios AS (SELECT l_quantity AS rain, round(l_tax * 100) - 1 AS temp, CASE WHEN round(l_tax * 100) <> 0 THEN l_quantity / round(l_tax * 100) ELSE CAST('Infinity' AS DOUBLE) END AS ratio,
  l_linenumber AS line, l_linestatus AS status FROM lineitem)"""


def _ratios(spark: SparkSession, sf: str) -> DataFrame:
    rain, temp = F.col("l_quantity"), F.round(F.col("l_tax") * 100) - 1
    return v.table(spark, sf, "lineitem").select(
        rain.alias("rain"),
        temp.alias("temp"),
        rain_temp_ratio(rain, temp).alias("ratio"),
        F.col("l_linenumber").alias("line"),
        F.col("l_linestatus").alias("status"),
    )


@query("d19_infinite_values", v.sql_with(_RATIO_SQL, " UNION ALL ".join(f"""SELECT '{c}' AS "column", count(*) FILTER (WHERE isinf(CAST({c} AS DOUBLE))) AS n_infinite FROM ratios""" for c in ("rain", "temp", "ratio", "line"))))
def infinite_values(spark: SparkSession, sf: str) -> DataFrame:
    return infinite_counts(_ratios(spark, sf))


@query(
    "d20_feature_table_report",
    v.sql_with(
        _RATIO_SQL,
        """SELECT count(*) AS total_rows, 5 AS total_columns, 4 AS numeric_columns, 1 AS text_columns, 0 AS date_columns, 0 AS missing_required_columns,
        CAST(bool_or(isinf(ratio)) AS INT) AS columns_with_infinities, 0 AS columns_with_nulls,
        count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM ratios)) AS duplicate_rows, FALSE AS is_valid FROM ratios""",
    ),
)
def feature_report(spark: SparkSession, sf: str) -> DataFrame:
    return feature_table_report(_ratios(spark, sf), ["rain", "temp"])


@query("d21_target_stats", v.on_readings("SELECT count(*) AS n_total, count(*) - count(target) AS n_null, count(target) AS n_valid FROM targeted"))
def statistics_of_target(spark: SparkSession, sf: str) -> DataFrame:
    return target_stats(v.targeted(spark, sf), "target")


@query(
    "d22_missing_by_group",
    v.on_readings(f"""SELECT district_code, count(*) AS n_missing, {sql_r6('100.0 * count(*) / (SELECT count(*) FROM master)')} AS percent_of_rows
      FROM master WHERE groundwater_level IS NULL GROUP BY 1"""),
)
def missing_in_groups(spark: SparkSession, sf: str) -> DataFrame:
    master = written(v.master(spark, sf).select("district_code", "groundwater_level"))
    return rounded(missing_by_group(master, "groundwater_level", "district_code"))


_LEAK = ("groundwater_level", "rainfall_mm", "leaked", "constant", "copy")


def _leak_sql() -> str:
    parts = []
    for c in _LEAK:
        corr = "NULL" if c == "constant" else f"corr({c}, target)"
        parts.append(
            f"""SELECT '{c}' AS "column", count({c}) AS n_pairs, {sql_r6(corr)} AS correlation, coalesce(bool_and({c} IS NOT DISTINCT FROM target), FALSE) AS is_target,
            coalesce(abs({corr}) >= 0.999, FALSE) AS flagged FROM leaky"""
        )
    return v.sql_with(
        v.READINGS_VIEW + ", leaky AS (SELECT groundwater_level, rainfall_mm, target * 2 + 1 AS leaked, CAST(1.0 AS DOUBLE) AS constant, target AS copy, target FROM targeted WHERE target IS NOT NULL)",
        " UNION ALL ".join(parts),
    )


@query("d23_leakage_audit", _leak_sql())
def leakage(spark: SparkSession, sf: str) -> DataFrame:
    rows = v.targeted(spark, sf).select(
        "groundwater_level",
        "rainfall_mm",
        (F.col("target") * 2 + 1).alias("leaked"),
        F.lit(1.0).alias("constant"),
        F.col("target").alias("copy"),
        "target",
    )
    return rounded(leakage_audit(rows, "target"))


@query("d24_sparse_groups", v.on_readings("SELECT station, count(*) AS n_rows FROM readings WHERE ts < TIMESTAMP '1996-06-01' GROUP BY 1 HAVING count(*) < 125"))
def sparse_groups(spark: SparkSession, sf: str) -> DataFrame:
    rows = v.readings(spark, sf).select(
        "station",
        F.when(F.col("ts") < F.lit("1996-06-01").cast("timestamp_ntz"), "train").otherwise("test").alias("split"),
    )
    return sparse_train_groups(rows, "station", fewer_than=125)


@query("d25_split_report", v.on_readings("SELECT split, count(*) AS n_rows, min(date) AS first_date, max(date) AS last_date FROM split GROUP BY 1"))
def report_of_split(spark: SparkSession, sf: str) -> DataFrame:
    return split_report(v.split(spark, sf))


_CONSTANT_SQL = """
flags AS (SELECT l_quantity AS a, CAST(1.0 AS DOUBLE) AS b, CAST(NULL AS VARCHAR) AS c, CASE WHEN l_linenumber = 1 THEN 5 END AS d, 'x' AS e, l_linenumber * 0 AS f FROM lineitem)"""


@query(
    "d26_constant_columns",
    v.sql_with(_CONSTANT_SQL, """SELECT "column" FROM (""" + " UNION ALL ".join(f"""SELECT '{c}' AS "column", count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS n FROM flags""" for c in "abcdef") + ") WHERE n <= 1"),
)
def constants(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("l_linenumber")
    rows = v.table(spark, sf, "lineitem").select(
        F.col("l_quantity").alias("a"), F.lit(1.0).alias("b"), F.lit(None).cast("string").alias("c"),
        F.when(n == 1, 5).alias("d"), F.lit("x").alias("e"), (n * 0).alias("f"),
    )
    return constant_columns(rows, list("abcdef"))


_SPLIT_COLUMNS = [c.measure for c in CATEGORIES] + ["target"]


@query(
    "d27_split_nulls",
    v.on_readings(" UNION ALL ".join(f"""SELECT split, count(*) AS n_rows, '{c}' AS "column", count(*) - count({c}) AS n_null FROM split GROUP BY split""" for c in _SPLIT_COLUMNS)),
)
def nulls_of_splits(spark: SparkSession, sf: str) -> DataFrame:
    return split_nulls(v.split(spark, sf), _SPLIT_COLUMNS)


@query("d28_regression_metrics", v.sql_with(METRICS_SQL, f"SELECT model, n_rows, {sql_r6('rmse')} AS rmse, {sql_r6('mae')} AS mae, {sql_r6('r2')} AS r2, n_bad FROM metrics"))
def metrics(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(regression_metrics(predictions(spark, sf)))


@query(
    "d29_prediction_problems",
    v.sql_with(
        PREDICTIONS_SQL + ", spoiled AS (SELECT model, y, CASE WHEN y = 7 THEN NULL WHEN y = 8 THEN CAST('NaN' AS DOUBLE) WHEN y = 9 THEN CAST('Infinity' AS DOUBLE) ELSE prediction END AS p FROM predictions)",
        "SELECT model, count(*) AS n_rows, 0 AS bad_targets, count(*) FILTER (WHERE p IS NULL OR isnan(p) OR isinf(p)) AS bad_predictions FROM spoiled GROUP BY model",
    ),
)
def problems(spark: SparkSession, sf: str) -> DataFrame:
    p = F.when(F.col("y") == 7, None).when(F.col("y") == 8, float("nan")).when(F.col("y") == 9, float("inf")).otherwise(F.col("prediction"))
    return prediction_problems(predictions(spark, sf).withColumn("prediction", p))


@query("g02b_uncovered_categories", v.on_readings("""SELECT 'wind' AS category FROM readings HAVING count(*) > 0"""))
def uncovered(spark: SparkSession, sf: str) -> DataFrame:
    return uncovered_categories(v.readings(spark, sf), [c.name for c in CATEGORIES] + ["wind"])
