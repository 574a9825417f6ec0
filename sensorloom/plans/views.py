"""Telemetry-shaped views of the test tables, each as DataFrame code and as SQL.

Sums of the readings are exact in binary floating point (whole numbers, halves, quarters), so both
engines agree on them to the last bit, whatever the order of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.config import CATEGORIES, SENTINELS, TargetSpec
from sensorloom.operators.district_day import district_day
from sensorloom.operators.master import master_table
from sensorloom.operators.split import with_split
from sensorloom.operators.target import with_target
from sensorloom.sources.scratch import written

HUMIDITY_COLUMN = "Telemetry Hourly Relative Humidity (%)"
DIRTY_COLUMNS = (
    "SlNo",
    "Station",
    "Agency",
    "District LGD Code",
    "District",
    "Latitude",
    "Longitude",
    "Data Acquisition Time",
    "Subtributary",
    HUMIDITY_COLUMN,
)
DIRTY_NUMERIC = ("SlNo", "District LGD Code", "Latitude", "Longitude", "Subtributary", HUMIDITY_COLUMN)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --- Short series: events ---------------------------------------------------

EVENTS_VIEW = """
readings_events AS (
  SELECT event_id AS reading_id,
    CASE event_type WHEN 'view' THEN 'groundwater' WHEN 'click' THEN 'humidity'
      WHEN 'purchase' THEN 'rainfall' WHEN 'error' THEN 'river_level' ELSE 'temperature' END AS category,
    user_id % 33 AS district_code,
    CASE WHEN event_id % 19 = 0 THEN NULL
      WHEN event_id % 23 = 0 THEN 'DISTRICT ' || (user_id % 33)
      ELSE 'District ' || (user_id % 33) END AS district,
    user_id AS station, ts,
    CASE WHEN event_id % 17 = 0 THEN NULL ELSE value END AS measurement
  FROM events)
"""


def readings_events(spark: SparkSession, sf: str) -> DataFrame:
    kind, event, code = F.col("event_type"), F.col("event_id"), F.col("user_id") % 33
    return table(spark, sf, "events").select(
        event.alias("reading_id"),
        F.when(kind == "view", "groundwater")
        .when(kind == "click", "humidity")
        .when(kind == "purchase", "rainfall")
        .when(kind == "error", "river_level")
        .otherwise("temperature")
        .alias("category"),
        code.alias("district_code"),
        F.when(event % 19 == 0, F.lit(None))
        .when(event % 23 == 0, F.concat(F.lit("DISTRICT "), code.cast("string")))
        .otherwise(F.concat(F.lit("District "), code.cast("string")))
        .alias("district"),
        F.col("user_id").alias("station"),
        "ts",
        F.when(event % 17 != 0, F.col("value")).alias("measurement"),
    )


# --- Long series: line items by nation and day -----------------------------------

READINGS_VIEW = """
readings AS (
  SELECT
    CASE l_linenumber WHEN 1 THEN 'groundwater' WHEN 2 THEN 'humidity' WHEN 3 THEN 'rainfall'
      WHEN 4 THEN 'rainfall' WHEN 5 THEN 'river_level' ELSE 'temperature' END AS category,
    CAST(s_nationkey AS BIGINT) AS district_code, n_name AS district, l_suppkey AS station,
    l_shipdate AS ts,
    CASE WHEN l_orderkey % 17 = 0 THEN NULL ELSE
      CASE l_linenumber WHEN 1 THEN l_quantity WHEN 2 THEN round(l_discount * 100) * 8
        WHEN 3 THEN floor(round(l_quantity * l_discount * 100) / 64) / 4.0
        WHEN 4 THEN floor(round(l_quantity * l_discount * 100) / 64) / 4.0
        WHEN 5 THEN round(l_tax * 100) / 4.0
        ELSE floor(l_extendedprice / 1024.0) / 2.0 END END AS measurement
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
district_day AS (
  SELECT category, district_code, CAST(ts AS DATE) AS date, min(district) AS district,
    CASE WHEN category = 'rainfall' THEN sum(measurement) ELSE avg(measurement) END AS measurement,
    CAST(count(DISTINCT station) AS BIGINT) AS station_count
  FROM readings WHERE measurement IS NOT NULL
  GROUP BY category, district_code, CAST(ts AS DATE)),
master AS (
  SELECT district_code, min(district) AS district, date,
""" + ",\n".join(
    f"    max(measurement) FILTER (WHERE category = '{c.name}') AS {c.measure},"
    f" max(station_count) FILTER (WHERE category = '{c.name}') AS {c.count}"
    for c in CATEGORIES
) + """
  FROM district_day GROUP BY district_code, date),
targeted AS (
  SELECT *, lead(groundwater_level, 7) OVER (PARTITION BY district_code ORDER BY date) AS target
  FROM master),
target_days AS (
  SELECT date, row_number() OVER (ORDER BY date) AS i, count(*) OVER () AS n
  FROM (SELECT DISTINCT date FROM targeted WHERE target IS NOT NULL)),
cuts AS (
  SELECT max(n) AS n_dates,
    max(date) FILTER (WHERE i = greatest(1, least(CAST(floor(n * CAST(0.7 AS DOUBLE)) AS BIGINT), n - 2))) AS train_end,
    max(date) FILTER (WHERE i = greatest(greatest(1, least(CAST(floor(n * CAST(0.7 AS DOUBLE)) AS BIGINT), n - 2)) + 1,
      least(CAST(floor(n * CAST(0.85 AS DOUBLE)) AS BIGINT), n - 1))) AS validation_end
  FROM target_days),
split AS (
  SELECT t.*, CASE WHEN date <= (SELECT train_end FROM cuts) THEN 'train'
    WHEN date <= (SELECT validation_end FROM cuts) THEN 'validation' ELSE 'test' END AS split
  FROM targeted t WHERE target IS NOT NULL),
train AS (SELECT * FROM split WHERE split = 'train')
"""


def readings(spark: SparkSession, sf: str) -> DataFrame:
    line, supplier, nation = [table(spark, sf, t) for t in ("lineitem", "supplier", "nation")]
    n = F.col("l_linenumber")
    rain = F.floor(F.round(F.col("l_quantity") * F.col("l_discount") * 100) / 64) / 4.0
    value = (
        F.when(n == 1, F.col("l_quantity"))
        .when(n == 2, F.round(F.col("l_discount") * 100) * 8)
        .when(n.isin(3, 4), rain)
        .when(n == 5, F.round(F.col("l_tax") * 100) / 4.0)
        .otherwise(F.floor(F.col("l_extendedprice") / 1024.0) / 2.0)
    )
    category = (
        F.when(n == 1, "groundwater")
        .when(n == 2, "humidity")
        .when(n.isin(3, 4), "rainfall")
        .when(n == 5, "river_level")
        .otherwise("temperature")
    )
    # A side small enough to broadcast is found and broadcast at run time.
    return (
        line.join(supplier, line.l_suppkey == supplier.s_suppkey)
        .join(nation, supplier.s_nationkey == nation.n_nationkey)
        .select(
            category.alias("category"),
            F.col("s_nationkey").cast("bigint").alias("district_code"),
            F.col("n_name").alias("district"),
            F.col("l_suppkey").alias("station"),
            F.col("l_shipdate").alias("ts"),
            F.when(F.col("l_orderkey") % 17 != 0, value).alias("measurement"),
        )
    )


def daily(spark: SparkSession, sf: str) -> DataFrame:
    return district_day(readings(spark, sf))


def master(spark: SparkSession, sf: str) -> DataFrame:
    return master_table(daily(spark, sf))


def targeted(spark: SparkSession, sf: str) -> DataFrame:
    return with_target(master(spark, sf), TargetSpec())


def split(spark: SparkSession, sf: str) -> DataFrame:
    return with_split(written(targeted(spark, sf)))


# --- Raw text with every kind of dirt ------------------------------------------------

_SENTINEL_LIST = ", ".join(f"'{s}'" for s in SENTINELS)


def _sql_columns(template: str) -> str:
    return ",\n    ".join(template.format(c=f'"{c}"') + f' AS "{c}"' for c in DIRTY_COLUMNS)


DIRTY_VIEW = f"""
base AS (
  SELECT l_orderkey AS k,
    CAST(l_orderkey * 8 + l_linenumber AS VARCHAR) AS "SlNo",
    '  ST' || l_suppkey || ' ' AS "Station",
    CASE l_partkey % 13 WHEN 0 THEN 'NA' WHEN 1 THEN '--' WHEN 2 THEN '' WHEN 3 THEN ' null '
      ELSE 'AG' || (l_partkey % 5) END AS "Agency",
    CAST(438 + l_suppkey % 33 AS VARCHAR) AS "District LGD Code",
    ' District ' || (l_suppkey % 33) AS "District",
    CASE WHEN l_partkey % 29 = 0 THEN '95.5' WHEN l_partkey % 31 = 0 THEN 'abc'
      WHEN l_partkey % 37 = 0 THEN '' ELSE (20 + l_suppkey % 5) || '.' || (10 + l_suppkey % 80) END AS "Latitude",
    CASE WHEN l_partkey % 41 = 0 THEN '-181'
      ELSE (68 + l_suppkey % 6) || '.' || (10 + l_suppkey % 70) END AS "Longitude",
    CASE WHEN l_orderkey % 43 = 0 THEN 'not a time'
      WHEN l_orderkey % 5 = 0 THEN strftime(l_shipdate, '%d-%m-%Y %H:%M')
      ELSE strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') END AS "Data Acquisition Time",
    CASE WHEN l_partkey % 2 = 0 THEN '-' ELSE NULL END AS "Subtributary",
    CASE WHEN l_partkey % 19 = 0 THEN '-' WHEN l_partkey % 23 = 0 THEN 'NaN'
      ELSE (l_orderkey % 140 - 20) || '.' || (l_partkey % 10) END AS "{HUMIDITY_COLUMN}"
  FROM lineitem),
dirty AS (
  SELECT * EXCLUDE (k) FROM base
  UNION ALL SELECT * EXCLUDE (k) FROM base WHERE k % 10 = 0
  UNION ALL SELECT {", ".join("NULL" for _ in DIRTY_COLUMNS)} FROM base WHERE k % 50 = 0),
stripped AS (
  SELECT {_sql_columns("CASE WHEN trim({c}) IN (" + _SENTINEL_LIST + ", '') THEN NULL ELSE trim({c}) END")}
  FROM dirty),
folded AS (SELECT *, count(*) AS copies FROM stripped GROUP BY ALL),
filled AS (SELECT * FROM folded WHERE {" OR ".join(f'"{c}" IS NOT NULL' for c in DIRTY_COLUMNS)}),
typed AS (
  SELECT copies,
    {", ".join(
        f'''TRY_CAST("{c}" AS DOUBLE) AS "{c}"''' if c in DIRTY_NUMERIC
        else f'''coalesce(try_strptime("{c}", '%Y-%m-%d %H:%M:%S'), try_strptime("{c}", '%d-%m-%Y %H:%M')) AS "{c}"'''
        if c == "Data Acquisition Time" else f'"{c}"' for c in DIRTY_COLUMNS)}
  FROM filled),
located AS (
  SELECT * FROM typed WHERE "Latitude" BETWEEN -90 AND 90 AND "Longitude" BETWEEN -180 AND 180),
cleaned AS (
  SELECT * EXCLUDE (copies) REPLACE (CASE WHEN "{HUMIDITY_COLUMN}" BETWEEN 0 AND 100
    THEN "{HUMIDITY_COLUMN}" END AS "{HUMIDITY_COLUMN}") FROM located)
"""


def _digits(first: Column, second: Column) -> Column:
    return F.concat(first.cast("string"), F.lit("."), second.cast("string"))


def dirty(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as raw text: sentinels, blanks, padding, bad values, copies and empty rows."""
    order, part, supp = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey")
    text = {
        "SlNo": (order * 8 + F.col("l_linenumber")).cast("string"),
        "Station": F.concat(F.lit("  ST"), supp.cast("string"), F.lit(" ")),
        "Agency": F.when(part % 13 == 0, "NA")
        .when(part % 13 == 1, "--")
        .when(part % 13 == 2, "")
        .when(part % 13 == 3, " null ")
        .otherwise(F.concat(F.lit("AG"), (part % 5).cast("string"))),
        "District LGD Code": (supp % 33 + 438).cast("string"),
        "District": F.concat(F.lit(" District "), (supp % 33).cast("string")),
        "Latitude": F.when(part % 29 == 0, "95.5")
        .when(part % 31 == 0, "abc")
        .when(part % 37 == 0, "")
        .otherwise(_digits(supp % 5 + 20, supp % 80 + 10)),
        "Longitude": F.when(part % 41 == 0, "-181").otherwise(_digits(supp % 6 + 68, supp % 70 + 10)),
        "Data Acquisition Time": F.when(order % 43 == 0, "not a time")
        .when(order % 5 == 0, F.date_format("l_shipdate", "dd-MM-yyyy HH:mm"))
        .otherwise(F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss")),
        "Subtributary": F.when(part % 2 == 0, "-"),
        HUMIDITY_COLUMN: F.when(part % 19 == 0, "-")
        .when(part % 23 == 0, "NaN")
        .otherwise(_digits(order % 140 - 20, part % 10)),
    }
    kinds = (
        F.when(order % 50 == 0, F.array(F.lit("row"), F.lit("row"), F.lit("blank")))
        .when(order % 10 == 0, F.array(F.lit("row"), F.lit("row")))
        .otherwise(F.array(F.lit("row")))
    )
    rows = table(spark, sf, "lineitem").withColumn("kind", F.explode(kinds))
    return rows.select(*[F.when(F.col("kind") == "row", c).alias(n) for n, c in text.items()])


def sql_with(views: str, select: str) -> str:
    return f"WITH {views.strip()}\n{select.strip()}"


def on_readings(select: str) -> str:
    return sql_with(READINGS_VIEW, select)


def on_events(select: str) -> str:
    return sql_with(EVENTS_VIEW, select)


def on_dirty(select: str) -> str:
    return sql_with(DIRTY_VIEW, select)
