"""Queries of the outer joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.config import CATEGORIES, MASTER_COLUMNS
from sensorloom.operators.checks import duplicate_key_stats
from sensorloom.operators.district_day import district_day
from sensorloom.operators.master import (
    category_steps,
    join_categories,
    join_stored,
    master_table,
    match_counts,
    one_category,
    outer_join,
    store_by_key,
)
from sensorloom.operators.merge import merge_all, merge_pair
from sensorloom.plans import views as v
from sensorloom.plans.registry import query, rounded, sql_r6
from sensorloom.sources.scratch import written

MASTER_SQL = "SELECT " + ", ".join(
    f"{sql_r6(c)} AS {c}" if c in {x.measure for x in CATEGORIES} else c for c in MASTER_COLUMNS
) + " FROM master"


def _pair(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    daily = v.daily(spark, sf)
    return one_category(daily, "groundwater"), one_category(daily, "humidity")


@query(
    "c01_full_outer_join",
    v.on_readings(f"""SELECT coalesce(l.district_code, r.district_code) AS district_code, coalesce(l.date, r.date) AS date,
      coalesce(l.district, r.district) AS district, {sql_r6('l.measurement')} AS groundwater_level, l.station_count AS groundwater_station_count,
      {sql_r6('r.measurement')} AS relative_humidity, r.station_count AS humidity_station_count
      FROM (SELECT * FROM district_day WHERE category = 'groundwater') l
      FULL JOIN (SELECT * FROM district_day WHERE category = 'humidity') r ON l.district_code = r.district_code AND l.date = r.date"""),
)
def full_outer_join(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(outer_join(*_pair(spark, sf)))


@query("c02_master_by_joins", v.on_readings(MASTER_SQL))
def master_by_joins(spark: SparkSession, sf: str) -> DataFrame:
    # Five inputs read the aggregate, so it is written once.
    daily = written(v.daily(spark, sf))
    frames = {c.name: one_category(daily, c.name) for c in CATEGORIES}
    return rounded(join_categories(frames).select(*MASTER_COLUMNS))


@query("c02c_master_from_stored", v.on_readings(MASTER_SQL))
def master_from_stored(spark: SparkSession, sf: str) -> DataFrame:
    """The aggregate stored by its keys, and its categories joined where they lie."""
    return rounded(join_stored(store_by_key(v.daily(spark, sf))).select(*MASTER_COLUMNS))


@query("c02d_pivot_of_stored", v.on_readings(MASTER_SQL))
def pivot_of_stored(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(master_table(store_by_key(v.daily(spark, sf))))


@query("c02b_master_by_pivot", v.on_readings(MASTER_SQL))
def master_by_pivot(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(master_table(v.daily(spark, sf)))


_LABELS_SQL = """
labelled AS (SELECT category, district_code, CAST(ts AS DATE) AS date, arg_min(district, ts) FILTER (WHERE district IS NOT NULL) AS district
  FROM readings_events WHERE measurement IS NOT NULL GROUP BY 1, 2, 3)"""


@query(
    "c03_district_coalesce",
    v.sql_with(
        v.EVENTS_VIEW + "," + _LABELS_SQL,
        """SELECT coalesce(l.district_code, r.district_code) AS district_code, coalesce(l.date, r.date) AS date, coalesce(l.district, r.district) AS district
        FROM (SELECT * FROM labelled WHERE category = 'groundwater') l
        FULL JOIN (SELECT * FROM labelled WHERE category = 'humidity') r ON l.district_code = r.district_code AND l.date = r.date""",
    ),
)
def district_coalesce(spark: SparkSession, sf: str) -> DataFrame:

    daily = district_day(v.readings_events(spark, sf))
    joined = outer_join(one_category(daily, "groundwater"), one_category(daily, "humidity"))
    return joined.select("district_code", "date", "district")


@query(
    "c04_match_counts",
    v.on_readings("""SELECT count(l.c) AS rows_before_left, count(r.c) AS rows_before_right, count(*) AS rows_after,
      count(*) FILTER (WHERE l.c = 1 AND r.c = 1) AS matched_rows, count(*) FILTER (WHERE r.c IS NULL) AS left_only_rows,
      count(*) FILTER (WHERE l.c IS NULL) AS right_only_rows
      FROM (SELECT 1 AS c, district_code, date FROM district_day WHERE category = 'groundwater') l
      FULL JOIN (SELECT 1 AS c, district_code, date FROM district_day WHERE category = 'humidity') r ON l.district_code = r.district_code AND l.date = r.date"""),
)
def pair_match_counts(spark: SparkSession, sf: str) -> DataFrame:
    return match_counts(*_pair(spark, sf))


def _steps_sql() -> str:
    names = [c.name for c in CATEGORIES]
    parts = []
    for k in range(1, len(names)):
        before = ", ".join(f"'{n}'" for n in names[:k])
        parts.append(f"""SELECT {k} AS step, '{"+".join(names[:k])}' AS left_dataset, '{names[k]}' AS right_dataset,
          count(l.c) AS rows_before_left, count(r.c) AS rows_before_right, count(*) AS rows_after, count(*) FILTER (WHERE l.c = 1 AND r.c = 1) AS matched_rows,
          count(*) FILTER (WHERE r.c IS NULL) AS left_only_rows, count(*) FILTER (WHERE l.c IS NULL) AS right_only_rows
          FROM (SELECT DISTINCT 1 AS c, district_code, date FROM district_day WHERE category IN ({before})) l
          FULL JOIN (SELECT 1 AS c, district_code, date FROM district_day WHERE category = '{names[k]}') r ON l.district_code = r.district_code AND l.date = r.date""")
    return " UNION ALL ".join(parts)


@query("c04b_join_steps", v.on_readings(_steps_sql()))
def fold_steps(spark: SparkSession, sf: str) -> DataFrame:
    return category_steps(v.daily(spark, sf))


# Two standardised tables: readings of one kind by station and hour, and another kind without a
# station for some rows, so that NULL keys meet.
_STD_SQL = """
hourly AS (
  SELECT category, date_trunc('hour', ts) AS "timestamp", CASE WHEN station % 29 = 0 THEN NULL ELSE CAST(station AS VARCHAR) END AS station,
    min(district) AS district, min(reading_id) AS reading_id, sum(measurement) AS measurement FROM readings_events GROUP BY 1, 2, 3),
lhs AS (SELECT "timestamp", station, district, reading_id AS agency, reading_id AS left_id FROM hourly WHERE category = 'groundwater'),
rhs AS (SELECT "timestamp", station, district, reading_id AS agency, reading_id AS right_id FROM hourly WHERE category = 'humidity'),
many AS (SELECT date_trunc('hour', ts) AS "timestamp", CASE WHEN user_id % 29 = 0 THEN NULL ELSE CAST(user_id AS VARCHAR) END AS station,
  event_id AS agency, event_id AS left_id FROM events WHERE event_type <> 'click')
"""
_STD_VIEW = v.EVENTS_VIEW + "," + _STD_SQL
_ON = """l."timestamp" IS NOT DISTINCT FROM r."timestamp" AND l.station IS NOT DISTINCT FROM r.station"""


def _hourly(spark: SparkSession, sf: str, category: str, name: str) -> DataFrame:
    rows = v.readings_events(spark, sf).where(F.col("category") == category)
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("timestamp")
    station = F.when(F.col("station") % 29 != 0, F.col("station").cast("string")).alias("station")
    return rows.groupBy(hour, station).agg(
        F.min("district").alias("district"), F.min("reading_id").alias("agency"), F.min("reading_id").alias(name)
    )


def _many(spark: SparkSession, sf: str) -> DataFrame:
    return v.table(spark, sf, "events").where("event_type <> 'click'").select(
        F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("timestamp"),
        F.when(F.col("user_id") % 29 != 0, F.col("user_id").cast("string")).alias("station"),
        F.col("event_id").alias("agency"),
        F.col("event_id").alias("left_id"),
    )


@query(
    "c05_guarded_merge",
    v.sql_with(_STD_VIEW, f"""SELECT coalesce(l."timestamp", r."timestamp") AS "timestamp", coalesce(l.station, r.station) AS station,
      l.agency, l.left_id, r.district, r.agency AS agency__humidity, r.right_id FROM many l FULL JOIN rhs r ON {_ON}"""),
)
def guarded_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Keys repeat on the left side only; NULL stations match each other."""
    rows, _ = merge_pair(_many(spark, sf), _hourly(spark, sf, "humidity", "right_id"), "others", "humidity")
    return rows


@query(
    "c05b_guarded_merge_fan_out",
    v.sql_with(_STD_VIEW, f"""SELECT coalesce(l."timestamp", r."timestamp") AS "timestamp", coalesce(l.station, r.station) AS station,
      l.district, l.agency, l.right_id, r.agency AS agency__others, r.left_id FROM rhs l FULL JOIN many r ON {_ON}"""),
)
def guarded_merge_fan_out(spark: SparkSession, sf: str) -> DataFrame:
    rows, _ = merge_pair(_hourly(spark, sf, "humidity", "right_id"), _many(spark, sf), "humidity", "others")
    return rows


@query(
    "c06_duplicate_keys",
    v.on_events("""SELECT CAST(sum(n) AS BIGINT) AS n_rows, count(*) FILTER (WHERE n > 1) AS duplicate_key_groups, max(n) AS max_group_size,
      CAST(sum(n) FILTER (WHERE n > 1) AS BIGINT) AS duplicate_rows FROM (SELECT district, station, count(*) AS n FROM readings_events GROUP BY 1, 2)"""),
)
def duplicate_keys(spark: SparkSession, sf: str) -> DataFrame:
    return duplicate_key_stats(v.readings_events(spark, sf), ["district", "station"])


@query(
    "c07_suffix_and_coalesce",
    v.sql_with(_STD_VIEW, f"""SELECT coalesce(l."timestamp", r."timestamp") AS "timestamp", coalesce(l.station, r.station) AS station,
      coalesce(l.district, r.district) AS district, l.agency, l.left_id, r.agency AS agency__humidity, r.right_id FROM lhs l FULL JOIN rhs r ON {_ON}"""),
)
def suffix_and_coalesce(spark: SparkSession, sf: str) -> DataFrame:
    left, right = _hourly(spark, sf, "groundwater", "left_id"), _hourly(spark, sf, "humidity", "right_id")
    return merge_pair(left, right, "groundwater", "humidity")[0]


_NAMES = [c.name for c in CATEGORIES]


def _folded_sql(n: int) -> str:
    """The rows of the first n categories, joined one after another."""
    rows = f"""SELECT "timestamp", station, district, reading_id AS agency, reading_id AS id_{_NAMES[0]} FROM hourly WHERE category = '{_NAMES[0]}'"""
    more: list[str] = []
    for k, name in enumerate(_NAMES[1:n], 1):
        kept = "".join(f", l.{c}" for c in (f"id_{_NAMES[0]}", *more))
        rows = f"""SELECT coalesce(l."timestamp", r."timestamp") AS "timestamp", coalesce(l.station, r.station) AS station,
          coalesce(l.district, r.district) AS district, l.agency{kept}, r.reading_id AS agency__{name}, r.reading_id AS id_{name}
          FROM ({rows}) l FULL JOIN (SELECT * FROM hourly WHERE category = '{name}') r ON {_ON}"""
        more += [f"agency__{name}", f"id_{name}"]
    return rows


def _merge_steps_sql() -> str:
    steps, left = [], _NAMES[0]
    for k, name in enumerate(_NAMES[1:], 1):
        in_left = " OR ".join(f"id_{n} IS NOT NULL" for n in _NAMES[:k])
        steps.append(f"""SELECT '{left}' AS left_dataset, '{name}' AS right_dataset, 'timestamp_station' AS merge_strategy, '1:1' AS validate_mode,
          (SELECT count(*) FROM ({_folded_sql(k)})) AS left_rows_before, (SELECT count(*) FROM hourly WHERE category = '{name}') AS right_rows_before,
          count(*) AS rows_after, count(*) FILTER (WHERE ({in_left}) AND id_{name} IS NOT NULL) AS matched_rows,
          count(*) FILTER (WHERE id_{name} IS NULL) AS left_only_rows, count(*) FILTER (WHERE NOT ({in_left})) AS right_only_rows,
          0 AS left_duplicate_key_groups, 0 AS right_duplicate_key_groups FROM ({_folded_sql(k + 1)})""")
        left = f"({left}+{name})"
    return " UNION ALL ".join(steps)


@query("c08_merge_steps", v.sql_with(_STD_VIEW, _merge_steps_sql()))
def merge_steps(spark: SparkSession, sf: str) -> DataFrame:
    """The statistics of the joins of all five categories."""
    result = merge_all([_hourly(spark, sf, n, f"id_{n}") for n in _NAMES], _NAMES)
    rows = [{k: x for k, x in s.items() if k != "merge_keys"} for s in result.steps]
    return spark.createDataFrame(rows)


@query("c08c_merge_five", v.sql_with(_STD_VIEW, _folded_sql(len(_NAMES))))
def merge_five(spark: SparkSession, sf: str) -> DataFrame:
    """All rows and columns of the five categories after four guarded joins."""
    return merge_all([_hourly(spark, sf, n, f"id_{n}") for n in _NAMES], _NAMES).rows


@query(
    "c08b_merge_three",
    v.sql_with(_STD_VIEW, f"""
      SELECT count(*) AS n_rows, count(left_id) AS n_left, count(right_id) AS n_right, count(third_id) AS n_third FROM (
      SELECT m.*, t.reading_id AS third_id FROM (
        SELECT coalesce(l."timestamp", r."timestamp") AS "timestamp", coalesce(l.station, r.station) AS station, l.left_id, r.right_id
        FROM lhs l FULL JOIN rhs r ON {_ON}) m
      FULL JOIN (SELECT * FROM hourly WHERE category = 'rainfall') t
        ON m."timestamp" IS NOT DISTINCT FROM t."timestamp" AND m.station IS NOT DISTINCT FROM t.station)"""),
)
def merge_three(spark: SparkSession, sf: str) -> DataFrame:
    frames = [
        _hourly(spark, sf, "groundwater", "left_id"),
        _hourly(spark, sf, "humidity", "right_id"),
        _hourly(spark, sf, "rainfall", "third_id"),
    ]
    merged = merge_all(frames, ["groundwater", "humidity", "rainfall"]).rows
    return merged.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count("left_id").alias("n_left"),
        F.count("right_id").alias("n_right"),
        F.count("third_id").alias("n_third"),
    )
