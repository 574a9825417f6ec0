"""Queries of casts, filters, cleaning rules and row-level set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.functions.casts import to_day, to_number
from sensorloom.operators.clean import (
    COPIES,
    apply_range,
    clean,
    clean_missing,
    col,
    convert_datetimes,
    date_votes,
    distinct_by_value,
    convert_numerics,
    drop_empty_rows,
    drop_repeated_rows,
    keep_column_order,
    keep_valid_coordinates,
    numeric_votes,
    range_by_category,
    standardise,
)
from sensorloom.config import CATEGORIES
from sensorloom.operators.district_day import reading_violations, union_files, valid_readings
from sensorloom.operators.drift import drift_status, observed_schema, overall_status, schema_issues
from sensorloom.operators.master import key_violations, normalised_keys, one_category
from sensorloom.operators.scoring import accepted, check_payload_schema, rejected, with_payload_error
from sensorloom.operators.split_checks import features_and_target
from sensorloom.operators.target import valid_targets
from sensorloom.plans import views as v
from sensorloom.plans.registry import query, rounded, sql_r6
from sensorloom.sources.scratch import written

TIME = "Data Acquisition Time"


@query("b01_sentinels_to_null", v.on_dirty("SELECT * FROM stripped"))
def sentinels_to_null(spark: SparkSession, sf: str) -> DataFrame:
    return clean_missing(v.dirty(spark, sf))


@query(
    "b02_numeric_vote",
    v.on_dirty(
        " UNION ALL ".join(
            f"""SELECT '{c}' AS "column", count("{c}") AS n_values, count(TRY_CAST("{c}" AS DOUBLE)) AS n_numbers,
            (count("{c}") = 0 OR count(TRY_CAST("{c}" AS DOUBLE)) >= 0.5 * count("{c}")) AS "numeric" FROM stripped"""
            for c in v.DIRTY_COLUMNS
        )
    ),
)
def numeric_vote(spark: SparkSession, sf: str) -> DataFrame:
    return numeric_votes(clean_missing(v.dirty(spark, sf)))


@query(
    "b02b_numeric_cast",
    v.on_dirty(
        "SELECT "
        + ", ".join(f'TRY_CAST("{c}" AS DOUBLE) AS "{c}"' if c in v.DIRTY_NUMERIC else f'"{c}"' for c in v.DIRTY_COLUMNS)
        + " FROM stripped"
    ),
)
def numeric_cast(spark: SparkSession, sf: str) -> DataFrame:
    return convert_numerics(clean_missing(v.dirty(spark, sf)))


@query(
    "b03_datetime_cast",
    v.on_dirty(
        f"""SELECT coalesce(try_strptime("{TIME}", '%Y-%m-%d %H:%M:%S'), try_strptime("{TIME}", '%d-%m-%Y %H:%M')) AS moment,
        count(*) AS n_rows FROM stripped GROUP BY 1"""
    ),
)
def datetime_cast(spark: SparkSession, sf: str) -> DataFrame:
    typed = convert_datetimes(clean_missing(v.dirty(spark, sf)))
    return typed.groupBy(col(TIME).alias("moment")).agg(F.count(F.lit(1)).alias("n_rows"))


# Moments as text in eleven formats: in one column the day comes first, in the other the month.
_FORMATS = {
    "day_time": ("dd/MM/yyyy HH:mm", "d MMMM yyyy", "dd-MMM-yy hh:mm a", "MMM d, yyyy h:mm a", "yyyy-MM-dd'T'HH:mm:ss'+05:30'", "EEE, dd MMM yyyy", "dd.MM.yy", "yyyy/MM/dd HH:mm:ss", "d-M-yyyy h a"),
    "month_time": ("MM/dd/yyyy HH:mm", "M-d-yy h:mm a", "MM/dd/yyyy"),
}


def _precision(fmt: str) -> str:
    return "second" if "ss" in fmt else "minute" if "mm" in fmt else "hour" if " a" in fmt else "day"


def _truth(column: str) -> str:
    cases = " ".join(f"WHEN {i} THEN date_trunc('{_precision(f)}', moment)" for i, f in enumerate(_FORMATS[column]))
    return f"CASE l_orderkey % {len(_FORMATS[column])} {cases} END AS {column}"


@query(
    "b03b_date_formats",
    v.sql_with(
        "moments AS (SELECT l_orderkey, l_linenumber, l_shipdate + to_seconds((l_orderkey * 4001 + l_linenumber) % 86400) AS moment FROM lineitem)",
        f"SELECT {_truth('day_time')}, {_truth('month_time')}, count(*) AS n_rows FROM moments GROUP BY 1, 2",
    ),
)
def date_formats(spark: SparkSession, sf: str) -> DataFrame:
    """The order of day and month is settled by each column's vote."""
    second = (F.col("l_orderkey") * 4001 + F.col("l_linenumber")) % 86400
    moment = F.col("l_shipdate") + F.make_dt_interval(secs=second.cast("decimal(18, 6)"))
    rows = v.table(spark, sf, "lineitem").select("l_orderkey", moment.cast("timestamp_ntz").alias("moment"))
    texts = []
    for name, formats in _FORMATS.items():
        text = F.lit(None).cast("string")
        for i, fmt in enumerate(formats):
            text = F.when(F.col("l_orderkey") % len(formats) == i, F.date_format("moment", fmt)).otherwise(text)
        texts.append(text.alias(name))
    rows = written(rows.select(*texts))
    orders = {r["column"]: r["day_first"] for r in date_votes(rows).collect()}
    typed = convert_datetimes(rows, day_first=orders)
    return typed.groupBy(*_FORMATS).agg(F.count(F.lit(1)).alias("n_rows"))


@query("b04_drop_empty_rows", v.on_dirty("SELECT * EXCLUDE (copies) FROM folded f WHERE (SELECT count(*) FROM filled) > 0 AND " + "(" + " OR ".join(f'"{c}" IS NOT NULL' for c in v.DIRTY_COLUMNS) + ")"))
def drop_empty(spark: SparkSession, sf: str) -> DataFrame:
    return drop_empty_rows(drop_repeated_rows(clean_missing(v.dirty(spark, sf))))


@query("b05_coordinate_filter", v.on_dirty('SELECT "SlNo", "Latitude", "Longitude" FROM located'))
def coordinate_filter(spark: SparkSession, sf: str) -> DataFrame:
    rows = drop_repeated_rows(clean_missing(v.dirty(spark, sf)))
    kept = keep_valid_coordinates(rows)
    return kept.select(*[to_number(col(c)).alias(c) for c in ("SlNo", "Latitude", "Longitude")])


# The range rules run on the readings of their category, stretched so that some fall outside.
_STRETCH = {"groundwater": (-40.0, 400.0), "humidity": (3.0, -20.0), "rainfall": (1.0, -0.5), "river_level": (30.0, -100.0), "temperature": (3.0, -70.0)}


def _range_rule(rule) -> None:
    a, b = _STRETCH[rule.name]
    low = f"value >= {rule.low}" if rule.low is not None else "TRUE"
    high = f"value <= {rule.high}" if rule.high is not None else "TRUE"
    number = {"humidity": 6, "temperature": 7, "rainfall": 8, "groundwater": 9, "river_level": 10}[rule.name]

    @query(
        f"b{number:02d}_{rule.name}_range",
        v.on_readings(
            f"""SELECT station, value AS raw, CASE WHEN {low} AND {high} THEN value END AS "{rule.raw_column}", count(*) AS n_rows
            FROM (SELECT station, measurement * {a} + {b} AS value FROM readings WHERE category = '{rule.name}') GROUP BY 1, 2, 3"""
        ),
    )
    def run(spark: SparkSession, sf: str) -> DataFrame:
        value = F.col("measurement") * a + b
        rows = v.readings(spark, sf).where(F.col("category") == rule.name)
        rows = rows.select("station", value.alias("raw"), value.alias(rule.raw_column))
        return apply_range(rows, rule.name).groupBy("station", "raw", col(rule.raw_column)).agg(F.count(F.lit(1)).alias("n_rows"))


for _rule in CATEGORIES:
    _range_rule(_rule)


_DISPATCH_SQL = "CASE category " + " ".join(
    f"WHEN '{c.name}' THEN CASE WHEN {'x >= ' + str(c.low) if c.low is not None else 'TRUE'} AND {'x <= ' + str(c.high) if c.high is not None else 'TRUE'} THEN x END"
    for c in CATEGORIES
) + " END"


@query(
    "b11_range_dispatch",
    v.on_readings(
        f"""SELECT category, count(x) AS n_values, count(x) - count({_DISPATCH_SQL}) AS n_invalid, {sql_r6(f'sum({_DISPATCH_SQL})')} AS valid_sum
        FROM (SELECT category, measurement * 8 - 100 AS x FROM readings) GROUP BY category"""
    ),
)
def range_dispatch(spark: SparkSession, sf: str) -> DataFrame:
    rows = v.readings(spark, sf).select("category", (F.col("measurement") * 8 - 100).alias("x"))
    rows = rows.withColumn("valid", range_by_category(F.col("category"), F.col("x")))
    return rounded(
        rows.groupBy("category").agg(
            F.count("x").alias("n_values"),
            (F.count("x") - F.count("valid")).alias("n_invalid"),
            F.sum("valid").alias("valid_sum"),
        )
    )


@query("b12_column_order", v.on_events("SELECT category, station, ts, district_code, measurement, reading_id, district FROM readings_events"))
def column_order(spark: SparkSession, sf: str) -> DataFrame:
    original = (" category", "station ", "ts", "not there", "district_code", "measurement")
    return keep_column_order(v.readings_events(spark, sf), original)


@query(
    "b13_standardise",
    v.on_dirty(
        f"""SELECT coalesce(try_strptime("{TIME}", '%Y-%m-%d %H:%M:%S'), try_strptime("{TIME}", '%d-%m-%Y %H:%M')) AS "timestamp",
        trim("District") AS district, trim("Station") AS station, TRY_CAST("Latitude" AS DOUBLE) AS latitude,
        TRY_CAST("Longitude" AS DOUBLE) AS longitude, 'humid' AS source_dataset, 'humid.csv' AS source_file, "SlNo" FROM dirty"""
    ),
)
def standardise_rows(spark: SparkSession, sf: str) -> DataFrame:
    # Spark takes one spelling of a name; the raw columns that differ in case only are renamed first.
    raw = v.dirty(spark, sf)
    names = {"Station": "Station Name", "District": "District Name", "Latitude": "Latitude Deg", "Longitude": "Longitude Deg"}
    raw = raw.withColumnsRenamed(names).drop("District LGD Code")
    shared = ("timestamp", "district", "station", "latitude", "longitude", "source_dataset", "source_file", "SlNo")
    return standardise(raw, "humid", "humid.csv").select(*shared)


@query(
    "b14_calendar_date",
    v.on_dirty(
        f"""SELECT CAST(coalesce(try_strptime(trim("{TIME}"), '%Y-%m-%d %H:%M:%S'), try_strptime(trim("{TIME}"), '%m-%d-%Y %H:%M'),
          try_strptime(trim("{TIME}"), '%d-%m-%Y %H:%M')) AS DATE) AS day, count(*) AS n_rows FROM dirty GROUP BY 1"""
    ),
)
def calendar_date(spark: SparkSession, sf: str) -> DataFrame:
    return v.dirty(spark, sf).groupBy(to_day(col(TIME)).alias("day")).agg(F.count(F.lit(1)).alias("n_rows"))


@query(
    "b14b_unreadable_dates",
    v.on_dirty(
        f"""SELECT 'timestamp cannot be read' AS "rule", count(*) FILTER (WHERE "{TIME}" IS NULL OR "{TIME}" = 'not a time') AS n_rows FROM dirty
        UNION ALL SELECT 'district code is missing', count(*) FILTER (WHERE "District LGD Code" IS NULL) FROM dirty"""
    ),
)
def unreadable_dates(spark: SparkSession, sf: str) -> DataFrame:
    rows = v.dirty(spark, sf).withColumnRenamed("District LGD Code", "district_code")
    return reading_violations(rows.withColumnRenamed(TIME, "time_text"), "time_text")


_KEYS_SQL = """keys AS (SELECT CASE WHEN l_orderkey % 7 = 0 THEN 'X' || l_suppkey WHEN l_orderkey % 11 = 0 THEN NULL
  ELSE CAST(l_suppkey AS VARCHAR) END AS district_code,
  CASE WHEN l_orderkey % 13 = 0 THEN 'soon' WHEN l_orderkey % 3 = 0 THEN NULL ELSE strftime(l_shipdate, '%Y-%m-%d') END AS date FROM lineitem)"""


def _text_keys(spark: SparkSession, sf: str) -> DataFrame:
    k, s = F.col("l_orderkey"), F.col("l_suppkey").cast("string")
    return v.table(spark, sf, "lineitem").select(
        F.when(k % 7 == 0, F.concat(F.lit("X"), s)).when(k % 11 != 0, s).alias("district_code"),
        F.when(k % 13 == 0, "soon").when(k % 3 != 0, F.date_format("l_shipdate", "yyyy-MM-dd")).alias("date"),
    )


@query("b15_date_normalised", v.sql_with(_KEYS_SQL, """SELECT TRY_CAST(date AS DATE) AS date, count(*) AS n_rows FROM keys GROUP BY 1"""))
def date_normalised(spark: SparkSession, sf: str) -> DataFrame:
    return normalised_keys(_text_keys(spark, sf)).groupBy("date").agg(F.count(F.lit(1)).alias("n_rows"))


@query(
    "b16_key_guard",
    v.sql_with(
        _KEYS_SQL,
        """SELECT 'district code cannot be read' AS "rule", count(*) AS n_rows FROM keys WHERE district_code IS NOT NULL AND TRY_CAST(district_code AS BIGINT) IS NULL
        UNION ALL SELECT 'date cannot be read', count(*) FROM keys WHERE date IS NOT NULL AND TRY_CAST(date AS DATE) IS NULL
        UNION ALL SELECT 'district code is missing', count(*) FROM keys WHERE district_code IS NULL
        UNION ALL SELECT 'date is missing', count(*) FROM keys WHERE date IS NULL""",
    ),
)
def key_guard(spark: SparkSession, sf: str) -> DataFrame:
    return key_violations(_text_keys(spark, sf))


@query(
    "b17_master_columns",
    v.on_readings(f"""SELECT district_code, date, district, {sql_r6('measurement')} AS relative_humidity, station_count AS humidity_station_count
      FROM district_day WHERE category = 'humidity'"""),
)
def master_columns(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(one_category(v.daily(spark, sf), "humidity"))


@query("b18_valid_readings", v.on_events("SELECT * FROM readings_events WHERE measurement IS NOT NULL"))
def valid_reading_rows(spark: SparkSession, sf: str) -> DataFrame:
    return valid_readings(v.readings_events(spark, sf))


@query("b19_valid_targets", v.on_readings(f"SELECT district_code, date, {sql_r6('target')} AS target FROM targeted WHERE target IS NOT NULL"))
def valid_target_rows(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(valid_targets(v.targeted(spark, sf), "target").select("district_code", "date", "target"))


@query(
    "b20_features_and_target",
    v.on_readings(f"SELECT {sql_r6('air_temperature')} AS air_temperature, {sql_r6('rainfall_mm')} AS rainfall_mm, {sql_r6('target')} AS target FROM split"),
)
def feature_projection(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(features_and_target(v.split(spark, sf), ["air_temperature", "rainfall_mm"], "target"))


_PAYLOAD_SQL = """payload AS (
  SELECT l_orderkey AS k, CASE l_orderkey % 19 WHEN 0 THEN CAST('NaN' AS DOUBLE) WHEN 1 THEN NULL ELSE l_quantity END AS a,
    CASE l_partkey % 23 WHEN 0 THEN CAST('Infinity' AS DOUBLE) WHEN 1 THEN CAST('-Infinity' AS DOUBLE) ELSE l_tax END AS b FROM lineitem),
judged AS (SELECT *, (a IS NULL OR isnan(a) OR isinf(a)) AS bad_a, (b IS NULL OR isnan(b) OR isinf(b)) AS bad_b FROM payload)"""


def _payload(spark: SparkSession, sf: str) -> DataFrame:
    k, p = F.col("l_orderkey"), F.col("l_partkey")
    rows = v.table(spark, sf, "lineitem").select(
        k.alias("k"),
        F.when(k % 19 == 0, float("nan")).when(k % 19 != 1, F.col("l_quantity")).alias("a"),
        F.when(p % 23 == 0, float("inf")).when(p % 23 == 1, float("-inf")).otherwise(F.col("l_tax")).alias("b"),
    )
    check_payload_schema(rows, ["a", "b"], keep=["k"])
    return with_payload_error(rows, ["a", "b"])


@query("b21_payload_accepted", v.sql_with(_PAYLOAD_SQL, f"SELECT k, {sql_r6('a')} AS a, {sql_r6('b')} AS b FROM judged WHERE NOT bad_a AND NOT bad_b"))
def payload_accepted(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(accepted(_payload(spark, sf)))


@query(
    "b21b_payload_rejected",
    v.sql_with(
        _PAYLOAD_SQL,
        "SELECT k, CASE WHEN bad_a AND bad_b THEN 'a,b' WHEN bad_a THEN 'a' ELSE 'b' END AS error FROM judged WHERE bad_a OR bad_b",
    ),
)
def payload_rejected(spark: SparkSession, sf: str) -> DataFrame:
    return rejected(_payload(spark, sf)).select("k", "error")


@query("b22_clean", v.on_dirty("SELECT * FROM cleaned"))
def clean_rows(spark: SparkSession, sf: str) -> DataFrame:
    """All cleaning steps together, with the numeric columns found by vote."""
    return clean(v.dirty(spark, sf), "Humidity")


@query(
    "g01_union_by_name",
    v.on_events("""SELECT category, district_code, station, measurement, CAST(NULL AS VARCHAR) AS district FROM readings_events
      UNION ALL SELECT category, district_code, station, NULL, district FROM readings_events"""),
)
def union_by_name(spark: SparkSession, sf: str) -> DataFrame:
    rows = v.readings_events(spark, sf)
    first = rows.select("category", "district_code", "station", "measurement")
    second = rows.select("district", "station", "district_code", "category")
    return union_files([first, second])


@query("g03_distinct_rows", v.on_dirty("SELECT DISTINCT * FROM dirty"))
def distinct_rows(spark: SparkSession, sf: str) -> DataFrame:
    return drop_repeated_rows(v.dirty(spark, sf))


@query(
    "g03b_distinct_by_value",
    """SELECT CAST(l_suppkey AS DOUBLE) AS station, l_quantity AS quantity, CAST(l_shipdate AS TIMESTAMP) AS "time", l_returnflag AS note, count(*) AS copies
      FROM lineitem GROUP BY ALL""",
)
def distinct_values(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers in six spellings and dates in three formats; rows of equal values are one row."""
    kind, quantity = F.col("l_orderkey") % 6, F.col("l_quantity").cast("int").cast("string")
    texts = (quantity, F.concat(quantity, F.lit(".0")), F.concat(F.lit("+"), quantity, F.lit(".00")), F.concat(F.lit("00"), quantity), F.concat(quantity, F.lit(".")), F.concat(quantity, F.lit("e0")))
    number = F.element_at(F.array(*texts), (kind + 1).cast("int"))
    formats = ("yyyy-MM-dd HH:mm:ss", "dd/MM/yyyy", "d MMMM yyyy")
    moment = F.element_at(F.array(*[F.date_format("l_shipdate", f) for f in formats]), (F.col("l_orderkey") % 3 + 1).cast("int"))
    rows = v.table(spark, sf, "lineitem").select(F.col("l_suppkey").cast("string").alias("station"), number.alias("quantity"), moment.alias("time"), F.col("l_returnflag").alias("note"))
    found = distinct_by_value(rows)
    typed = convert_datetimes(convert_numerics(found, ["station", "quantity"]))
    return typed.select("station", "quantity", "time", "note", F.col(COPIES).alias("copies"))


def _drifting(spark: SparkSession, sf: str) -> DataFrame:
    """Cells of one file a year: from 1997 on, each year's file drifts from the first one's schema."""
    year, qty, tax = F.year("l_shipdate"), F.col("l_quantity").cast("bigint").cast("string"), F.col("l_tax").cast("string")
    flag, mode = F.col("l_returnflag"), F.col("l_linestatus")

    def cell(name: str, position: int, value: Column) -> Column:
        return F.struct(F.lit(name).alias("column"), F.lit(position).alias("position"), value.alias("value"))

    plain = F.array(cell("qty", 0, qty), cell("tax", 1, tax), cell("flag", 2, flag), cell("mode", 3, mode))
    cells = (
        F.when(year == 1997, F.array(cell("qty", 0, F.concat(qty, F.lit(".5"))), cell("tax", 1, tax), cell("flag", 2, flag), cell("mode", 3, mode)))
        .when(year == 1998, F.array(cell("qty", 0, qty), cell("flag", 1, flag), cell("mode", 2, mode), cell("extra", 3, mode)))
        .when(year == 1999, F.array(cell("qty", 0, qty), cell("tax", 1, tax), cell("flag", 2, qty), cell("mode", 3, mode)))
        .when(year == 2000, F.array(cell("mode", 0, mode), cell("qty", 1, qty), cell("tax", 2, tax), cell("flag", 3, flag)))
        .otherwise(plain)
    )
    rows = v.table(spark, sf, "lineitem").select(
        F.lit("line").alias("category"), year.cast("string").alias("dataset"), F.inline(cells)
    )
    return observed_schema(rows)


_DRIFT_SQL = """
src AS (SELECT CAST(year(l_shipdate) AS VARCHAR) AS dataset, year(l_shipdate) AS y, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS qty,
  CAST(l_tax AS VARCHAR) AS tax, l_returnflag AS flag, l_linestatus AS mode FROM lineitem),
cells AS (
  SELECT dataset, 'qty' AS "column", CASE y WHEN 2000 THEN 1 ELSE 0 END AS position, CASE y WHEN 1997 THEN qty || '.5' ELSE qty END AS value FROM src
  UNION ALL SELECT dataset, 'tax', CASE y WHEN 2000 THEN 2 ELSE 1 END, tax FROM src WHERE y <> 1998
  UNION ALL SELECT dataset, 'flag', CASE y WHEN 1998 THEN 1 WHEN 2000 THEN 3 ELSE 2 END, CASE y WHEN 1999 THEN qty ELSE flag END FROM src
  UNION ALL SELECT dataset, 'mode', CASE y WHEN 1998 THEN 2 WHEN 2000 THEN 0 ELSE 3 END, mode FROM src
  UNION ALL SELECT dataset, 'extra', 3, mode FROM src WHERE y = 1998),
types AS (
  SELECT dataset, "column", min(position) AS position, CASE WHEN count(*) FILTER (WHERE regexp_full_match(value, '[+-]?[0-9]+')) = count(*) THEN 'bigint'
    WHEN count(TRY_CAST(value AS DOUBLE)) = count(value) THEN 'double' ELSE 'string' END AS data_type FROM cells GROUP BY 1, 2),
baseline AS (SELECT "column", data_type AS base_type, position AS base_position FROM types WHERE dataset = (SELECT min(dataset) FROM types)),
both_ AS (SELECT d.dataset, b."column", b.base_type, b.base_position, t.data_type, t.position
  FROM (SELECT DISTINCT dataset FROM types) d JOIN baseline b ON TRUE LEFT JOIN types t ON t.dataset = d.dataset AND t."column" = b."column"
  UNION ALL SELECT dataset, "column", NULL, NULL, data_type, position FROM types WHERE "column" NOT IN (SELECT "column" FROM baseline)),
ranks AS (SELECT dataset, row_number() OVER (PARTITION BY dataset ORDER BY position) AS r, row_number() OVER (PARTITION BY dataset ORDER BY base_position) AS b
  FROM both_ WHERE position IS NOT NULL AND base_position IS NOT NULL),
issues AS (
  SELECT 'line' AS category, dataset, "column", 'missing column' AS issue, 'error' AS severity FROM both_ WHERE position IS NULL
  UNION ALL SELECT 'line', dataset, "column", 'unexpected column', 'error' FROM both_ WHERE base_position IS NULL
  UNION ALL SELECT 'line', dataset, "column", 'compatible numeric type', 'warning' FROM both_ WHERE base_type <> data_type AND base_type IN ('bigint', 'double') AND data_type IN ('bigint', 'double')
  UNION ALL SELECT 'line', dataset, "column", 'type mismatch', 'error' FROM both_ WHERE base_type <> data_type AND NOT (base_type IN ('bigint', 'double') AND data_type IN ('bigint', 'double'))
  UNION ALL SELECT DISTINCT 'line', dataset, NULL, 'column order', 'warning' FROM ranks WHERE r <> b),
status AS (
  SELECT 'line' AS category, d.dataset, count(*) FILTER (WHERE severity = 'error') AS n_errors, count(*) FILTER (WHERE severity = 'warning') AS n_warnings
  FROM (SELECT DISTINCT dataset FROM types) d LEFT JOIN issues i ON i.dataset = d.dataset GROUP BY d.dataset)
"""
_VERDICT = "CASE WHEN n_errors > 0 THEN 'FAIL' WHEN n_warnings > 0 THEN 'PASS WITH WARNINGS' ELSE 'PASS' END AS status"


@query("g04_schema_drift", v.sql_with(_DRIFT_SQL, "SELECT * FROM issues"))
def schema_drift(spark: SparkSession, sf: str) -> DataFrame:
    return schema_issues(_drifting(spark, sf))


@query("g04b_schema_status", v.sql_with(_DRIFT_SQL, f"SELECT *, {_VERDICT} FROM status"))
def schema_status(spark: SparkSession, sf: str) -> DataFrame:
    return drift_status(_drifting(spark, sf))


@query(
    "g04c_schema_overall",
    v.sql_with(
        _DRIFT_SQL,
        f"""SELECT *, {_VERDICT} FROM (SELECT count(*) AS n_datasets, CAST(sum(n_errors) AS BIGINT) AS n_errors,
          CAST(sum(n_warnings) AS BIGINT) AS n_warnings FROM status)""",
    ),
)
def schema_overall(spark: SparkSession, sf: str) -> DataFrame:
    return overall_status(drift_status(_drifting(spark, sf)))
