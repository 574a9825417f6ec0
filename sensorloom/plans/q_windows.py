"""Queries of ordered windows, calendar functions, targets and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sensorloom.config import RollingSpec, SplitShares, TargetSpec, TrendSpec, default_features
from sensorloom.functions.calendar import (
    calendar_flags,
    calendar_parts,
    day_of_year_cycle,
    month_cycle,
    season_flags,
)
from sensorloom.functions.scalars import half_even, rain_temp_ratio
from sensorloom.functions.transforms import get_transform, register_transform
from sensorloom.operators.checks import key_sample
from sensorloom.operators.district_day import sorted_for_people
from sensorloom.operators.evaluate import champion, rank_candidates, regression_metrics
from sensorloom.operators.features import (
    build_features,
    calendar_features,
    change_features,
    derived_features,
    lag_features,
    rolling_features,
    spell_features,
)
from sensorloom.operators.series import Series
from sensorloom.operators.split import continuity, cut_dates
from sensorloom.operators.target import invert_target, with_target
from sensorloom.plans import views as v
from sensorloom.plans.registry import query, r6, rounded, sql_r6

KEYS = ("district_code", "date")
W = "(PARTITION BY district_code ORDER BY date)"


def _over(n: int) -> str:
    return f"(PARTITION BY district_code ORDER BY date ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"


SQL_STATS = {"mean": "avg", "median": "median", "std": "stddev_samp", "min": "min", "max": "max", "sum": "sum"}


def lag_sql(c: str, k: int) -> str:
    return f"{sql_r6(f'lag({c}, {k}) OVER {W}')} AS {c}_lag_{k}"


def rolling_sql(c: str, n: int, stat: str) -> str:
    return f"{sql_r6(f'{SQL_STATS[stat]}({c}) OVER {_over(n)}')} AS {c}_rolling_{n}d_{stat}"


def change_sql(c: str, k: int) -> list[str]:
    before = f"lag({c}, {k}) OVER {W}"
    return [
        f"{sql_r6(f'{c} - {before}')} AS {c}_change_{k}d",
        f"{sql_r6(f'({c} - {before}) / (abs({before}) + 1e-5)')} AS {c}_pct_change_{k}d",
    ]


CALENDAR_SQL = {
    "year": "CAST(year(date) AS INT)",
    "month": "CAST(month(date) AS INT)",
    "quarter": "CAST(quarter(date) AS INT)",
    "week": "CAST(weekofyear(date) AS INT)",
    "day": "CAST(day(date) AS INT)",
    "day_of_week": "CAST(isodow(date) - 1 AS INT)",
    "day_of_year": "CAST(dayofyear(date) AS INT)",
    "is_month_start": "CAST(day(date) = 1 AS INT)",
    "is_month_end": "CAST(date = last_day(date) AS INT)",
    "is_weekend": "CAST(isodow(date) >= 6 AS INT)",
    "month_sin": sql_r6("sin(2 * pi() * month(date) / 12)"),
    "month_cos": sql_r6("cos(2 * pi() * month(date) / 12)"),
    "day_of_year_sin": sql_r6("sin(2 * pi() * dayofyear(date) / dayofyear(make_date(year(date), 12, 31)))"),
    "day_of_year_cos": sql_r6("cos(2 * pi() * dayofyear(date) / dayofyear(make_date(year(date), 12, 31)))"),
    "is_monsoon": "CAST(month(date) IN (6, 7, 8, 9) AS INT)",
    "is_summer": "CAST(month(date) IN (3, 4, 5) AS INT)",
    "is_post_monsoon": "CAST(month(date) IN (10, 11) AS INT)",
    "is_winter": "CAST(month(date) IN (12, 1, 2) AS INT)",
}


def _calendar_sql(*names: str) -> str:
    return v.on_readings("SELECT district_code, date, " + ", ".join(f"{CALENDAR_SQL[n]} AS {n}" for n in names) + " FROM master")


def _calendar(spark: SparkSession, sf: str, columns: dict) -> DataFrame:
    return rounded(v.master(spark, sf).select(*KEYS, *[c.alias(n) for n, c in columns.items()]))


_CALENDAR_QUERIES = {
    "h01_calendar_parts": (calendar_parts, ("year", "month", "quarter", "week", "day", "day_of_week", "day_of_year")),
    "h02_calendar_flags": (calendar_flags, ("is_month_start", "is_month_end", "is_weekend")),
    "h03_month_cycle": (month_cycle, ("month_sin", "month_cos")),
    "h04_day_of_year_cycle": (day_of_year_cycle, ("day_of_year_sin", "day_of_year_cos")),
    "h05_season_flags": (season_flags, ("is_monsoon", "is_summer", "is_post_monsoon", "is_winter")),
}
for _key, (_make, _names) in _CALENDAR_QUERIES.items():
    query(_key, _calendar_sql(*_names))(lambda spark, sf, make=_make: _calendar(spark, sf, make(F.col("date"))))


@query(
    "h06_rain_temp_ratio",
    """SELECT l_quantity AS rain, round(l_tax * 100) - 1 AS temp, CASE WHEN round(l_tax * 100) <> 0 THEN round(l_quantity / round(l_tax * 100), 6) + 0.0
      WHEN l_quantity > 0 THEN CAST('Infinity' AS DOUBLE) END AS ratio, count(*) AS n_rows FROM lineitem GROUP BY 1, 2, 3""",
)
def ratio(spark: SparkSession, sf: str) -> DataFrame:
    """A tax of zero makes a temperature of -1 and so an infinite ratio."""
    rows = v.table(spark, sf, "lineitem").select(
        F.col("l_quantity").alias("rain"), (F.round(F.col("l_tax") * 100) - 1).alias("temp")
    )
    rows = rows.withColumn("ratio", rain_temp_ratio(F.col("rain"), F.col("temp")))
    return rounded(rows).groupBy("rain", "temp", "ratio").agg(F.count(F.lit(1)).alias("n_rows"))


@query(
    "h07_log1p_and_back",
    f"""SELECT l_quantity AS value, {sql_r6('ln(1 + l_quantity)')} AS forward, {sql_r6('exp(ln(1 + l_quantity)) - 1')} AS back, count(*) AS n_rows
      FROM lineitem GROUP BY l_quantity""",
)
def log1p_and_back(spark: SparkSession, sf: str) -> DataFrame:
    t = get_transform("log1p")
    rows = v.table(spark, sf, "lineitem").groupBy(F.col("l_quantity").alias("value")).agg(F.count(F.lit(1)).alias("n_rows"))
    forward = t.forward(F.col("value"))
    return rounded(rows.select("value", forward.alias("forward"), t.inverse(forward).alias("back"), "n_rows"))


@query("h08_text_functions", v.on_dirty("""SELECT lower(trim("District")) AS name, contains(lower(trim("District")), 'district 1') AS hit, count(*) AS n_rows FROM dirty GROUP BY 1, 2"""))
def text_functions(spark: SparkSession, sf: str) -> DataFrame:
    name = F.lower(F.btrim(F.col("District")))
    rows = v.dirty(spark, sf).select(name.alias("name"), name.contains("district 1").alias("hit"))
    return rows.groupBy("name", "hit").agg(F.count(F.lit(1)).alias("n_rows"))


@query("h09_half_even", "SELECT l_quantity / 8 AS value, round_even(l_quantity / 8, 2) AS rounded, count(*) AS n_rows FROM lineitem GROUP BY 1, 2")
def half_even_rounding(spark: SparkSession, sf: str) -> DataFrame:
    value = F.col("l_quantity") / 8
    rows = v.table(spark, sf, "lineitem").select(value.alias("value"), half_even(value, 2).alias("rounded"))
    return rows.groupBy("value", "rounded").agg(F.count(F.lit(1)).alias("n_rows"))


LAGS = {"groundwater_level": (30, 1, 7, 7), "rainfall_mm": (1, 7)}
_LAG_SQL = v.on_readings("SELECT district_code, date, " + ", ".join(lag_sql(c, k) for c, ks in LAGS.items() for k in sorted(set(ks))) + " FROM master")


def _new_columns(df: DataFrame, before: DataFrame) -> DataFrame:
    return rounded(df.select(*KEYS, *[c for c in df.columns if c not in before.columns]))


@query("e01_lag_features", _LAG_SQL)
def lags(spark: SparkSession, sf: str) -> DataFrame:
    base = v.master(spark, sf)
    return _new_columns(lag_features(base, LAGS), base)


@query("e01b_lag_features_in_segments", _LAG_SQL)
def lags_in_segments(spark: SparkSession, sf: str) -> DataFrame:
    """The same rows with every district cut into segments of 200 days."""
    base = v.master(spark, sf)
    return _new_columns(lag_features(base, LAGS, Series(segment_days=200)), base)


READING_LAGS_SQL = v.on_events(f"""SELECT reading_id, {sql_r6('lag(measurement, 1) OVER w')} AS measurement_lag_1,
  {sql_r6('lag(measurement, 24) OVER w')} AS measurement_lag_24 FROM readings_events WINDOW w AS (PARTITION BY category ORDER BY ts)""")


@query("e01c_lags_of_raw_readings", READING_LAGS_SQL)
def lags_of_raw_readings(spark: SparkSession, sf: str) -> DataFrame:
    """Five groups hold all readings; segments of two days spread each over many tasks."""
    series = Series(("category",), "ts", segment_days=2)
    rows = v.readings_events(spark, sf).select("reading_id", "category", "ts", "measurement")
    return rounded(lag_features(rows, {"measurement": (1, 24)}, series).drop("category", "ts", "measurement"))


def _rolling_query(key: str, stat: str, columns: dict[str, tuple[int, ...]]) -> None:
    sql = ", ".join(rolling_sql(c, n, stat) for c, ns in columns.items() for n in ns)

    @query(key, v.on_readings(f"SELECT district_code, date, {sql} FROM master"))
    def run(spark: SparkSession, sf: str) -> DataFrame:
        base = v.master(spark, sf)
        spec = {c: RollingSpec(ns, (stat,)) for c, ns in columns.items()}
        return _new_columns(rolling_features(base, spec), base)


_rolling_query("e02_rolling_mean", "mean", {"groundwater_level": (7, 30), "relative_humidity": (15,)})
_rolling_query("e03_rolling_median", "median", {"groundwater_level": (7,), "air_temperature": (15,)})
_rolling_query("e03b_rolling_median_long", "median", {"groundwater_level": (365,), "rainfall_mm": (1000,)})
_rolling_query("e04_rolling_std", "std", {"groundwater_level": (7, 30), "rainfall_mm": (30,)})
_rolling_query("e05_rolling_min", "min", {"air_temperature": (7, 30)})
_rolling_query("e05b_rolling_max", "max", {"rainfall_mm": (7, 30)})
_rolling_query("e06_rolling_sum", "sum", {"rainfall_mm": (7, 30)})

_ROLLING_SEGMENTS = {"groundwater_level": RollingSpec((7, 30), ("mean", "std")), "rainfall_mm": RollingSpec((7, 30), ("max", "sum"))}


@query(
    "e03c_rolling_median_long_in_segments",
    v.on_readings(f"SELECT district_code, date, {rolling_sql('air_temperature', 200, 'median')}, {rolling_sql('rainfall_mm', 150, 'median')} FROM master"),
)
def long_medians_in_segments(spark: SparkSession, sf: str) -> DataFrame:
    base = v.master(spark, sf)
    spec = {"air_temperature": RollingSpec((200,), ("median",)), "rainfall_mm": RollingSpec((150,), ("median",))}
    return _new_columns(rolling_features(base, spec, Series(segment_days=300)), base)


@query(
    "e06b_rolling_in_segments",
    v.on_readings("SELECT district_code, date, " + ", ".join(rolling_sql(c, n, s) for c, spec in _ROLLING_SEGMENTS.items() for n in spec.windows for s in spec.stats) + " FROM master"),
)
def rolling_in_segments(spark: SparkSession, sf: str) -> DataFrame:
    base = v.master(spark, sf)
    return _new_columns(rolling_features(base, _ROLLING_SEGMENTS, Series(segment_days=100)), base)


TRENDS = TrendSpec(columns=("groundwater_level", "air_temperature"))


@query("e07_differences", v.on_readings("SELECT district_code, date, " + ", ".join(change_sql(c, k)[0] for c in TRENDS.columns for k in (1, 7)) + " FROM master"))
def differences(spark: SparkSession, sf: str) -> DataFrame:
    base = v.master(spark, sf)
    out = _new_columns(change_features(base, TRENDS), base)
    return out.select(*[c for c in out.columns if "_pct_" not in c])


@query("e08_relative_changes", v.on_readings("SELECT district_code, date, " + ", ".join(change_sql(c, k)[1] for c in TRENDS.columns for k in (1, 7)) + " FROM master"))
def relative_changes(spark: SparkSession, sf: str) -> DataFrame:
    base = v.master(spark, sf)
    out = _new_columns(change_features(base, TRENDS), base)
    return out.select(*KEYS, *[c for c in out.columns if "_pct_" in c])


SPELLS_SQL = """
marked AS (SELECT *, row_number() OVER (PARTITION BY district_code ORDER BY date) AS pos,
  coalesce(rainfall_mm < 1.0, FALSE) AS dry, coalesce(rainfall_mm >= 1.0, FALSE) AS wet FROM master),
broken AS (SELECT *,
  coalesce(max(CASE WHEN NOT dry THEN pos END) OVER (PARTITION BY district_code ORDER BY date ROWS UNBOUNDED PRECEDING), 0) AS dry_break,
  coalesce(max(CASE WHEN NOT wet THEN pos END) OVER (PARTITION BY district_code ORDER BY date ROWS UNBOUNDED PRECEDING), 0) AS wet_break FROM marked),
spells AS (SELECT *, CAST(CASE WHEN dry THEN pos - dry_break ELSE 0 END AS INT) AS consecutive_dry_days,
  CAST(CASE WHEN wet THEN pos - wet_break ELSE 0 END AS INT) AS consecutive_wet_days FROM broken)
"""
# The plain form of a run: rows since the last break, found by islands instead of positions.
ISLANDS_SQL = v.sql_with(
    v.READINGS_VIEW + """, marked AS (SELECT district_code, date, coalesce(rainfall_mm < 1.0, FALSE) AS dry, coalesce(rainfall_mm >= 1.0, FALSE) AS wet FROM master),
    runs AS (SELECT *, sum(CAST(NOT dry AS INT)) OVER w AS dry_run, sum(CAST(NOT wet AS INT)) OVER w AS wet_run FROM marked
      WINDOW w AS (PARTITION BY district_code ORDER BY date ROWS UNBOUNDED PRECEDING))""",
    """SELECT district_code, date,
      CAST(sum(CAST(dry AS INT)) OVER (PARTITION BY district_code, dry_run ORDER BY date ROWS UNBOUNDED PRECEDING) AS INT) AS consecutive_dry_days,
      CAST(sum(CAST(wet AS INT)) OVER (PARTITION BY district_code, wet_run ORDER BY date ROWS UNBOUNDED PRECEDING) AS INT) AS consecutive_wet_days FROM runs""",
)


@query("e09_spells", ISLANDS_SQL)
def spells(spark: SparkSession, sf: str) -> DataFrame:
    base = v.master(spark, sf)
    return _new_columns(spell_features(base, TRENDS), base)


@query("e09b_spells_in_segments", ISLANDS_SQL)
def spells_in_segments(spark: SparkSession, sf: str) -> DataFrame:
    base = v.master(spark, sf)
    return _new_columns(spell_features(base, TRENDS, Series(segment_days=30)), base)


@query(
    "e10_rainfall_anomaly",
    v.on_readings(f"""SELECT district_code, date, {sql_r6(f'(rainfall_mm - avg(rainfall_mm) OVER {_over(30)}) / (stddev_samp(rainfall_mm) OVER {_over(30)} + 1e-5)')}
      AS rainfall_30d_anomaly FROM master"""),
)
def rainfall_anomaly(spark: SparkSession, sf: str) -> DataFrame:
    base = rolling_features(v.master(spark, sf), {"rainfall_mm": RollingSpec((30,), ("mean", "std"))})
    return rounded(derived_features(base, TRENDS).select(*KEYS, "rainfall_30d_anomaly"))


@query("e11_forecast_target", v.on_readings(f"SELECT district_code, date, {sql_r6('lead(ln(1 + rainfall_mm), 7) OVER ' + W)} AS target FROM master"))
def forecast_target(spark: SparkSession, sf: str) -> DataFrame:
    spec = TargetSpec(source="rainfall_mm", transform="log1p")
    return rounded(with_target(v.master(spark, sf), spec).select(*KEYS, "target"))


@query("e11b_forecast_target_in_segments", v.on_readings(f"SELECT district_code, date, {sql_r6('lead(rainfall_mm, 7) OVER ' + W)} AS target FROM master"))
def forecast_target_in_segments(spark: SparkSession, sf: str) -> DataFrame:
    spec = TargetSpec(source="rainfall_mm")
    return rounded(with_target(v.master(spark, sf), spec, segment_days=50).select(*KEYS, "target"))


@query(
    "e12_continuity",
    v.on_readings("""SELECT district_code, min(date) AS min_date, max(date) AS max_date, count(*) AS n_dates, max(gap) AS max_gap_days, coalesce(max(gap) > 30, FALSE) AS large_gap
      FROM (SELECT district_code, date, date - lag(date) OVER (PARTITION BY district_code ORDER BY date) AS gap FROM (SELECT DISTINCT district_code, date FROM master)) GROUP BY 1"""),
)
def temporal_continuity(spark: SparkSession, sf: str) -> DataFrame:
    return continuity(v.master(spark, sf))


@query("e13_chronological_split", v.on_readings(f"SELECT district_code, date, split, {sql_r6('target')} AS target FROM split"))
def chronological_split(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(v.split(spark, sf).select(*KEYS, "split", "target"))


@query("e13b_cut_dates", v.on_readings("SELECT * FROM cuts"))
def split_cut_dates(spark: SparkSession, sf: str) -> DataFrame:
    return cut_dates(v.targeted(spark, sf), SplitShares())


# Predictions by formula: each model is the target shifted by its own error.
PREDICTIONS_SQL = """
predictions AS (
  SELECT m.model, m.candidate, CAST(l_returnflag AS VARCHAR) AS part, l_quantity AS y,
    CASE m.candidate WHEN 0 THEN l_quantity + l_linenumber - 4 WHEN 1 THEN l_quantity + 2 * (l_linenumber % 2)
      WHEN 2 THEN l_quantity - 2 * (l_linenumber % 2) ELSE 25.0 END AS prediction
  FROM lineitem JOIN (VALUES ('drift', 0), ('high', 1), ('low', 2), ('constant', 3)) m(model, candidate) ON TRUE)
"""


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    y, n = F.col("l_quantity"), F.col("l_linenumber")
    forms = [("drift", y + n - 4), ("high", y + (n % 2) * 2), ("low", y - (n % 2) * 2), ("constant", F.lit(25.0))]
    models = [
        F.struct(F.lit(m).alias("model"), F.lit(i).alias("candidate"), p.cast("double").alias("prediction"))
        for i, (m, p) in enumerate(forms)
    ]
    return v.table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("part"), y.alias("y"), F.inline(F.array(*models)))


METRICS_SQL = PREDICTIONS_SQL + """,
sums AS (SELECT model, candidate, count(*) AS n_rows, sum((y - prediction) * (y - prediction)) AS sse, avg(abs(y - prediction)) AS mae,
  var_pop(y) AS variance, count(*) FILTER (WHERE isnan(prediction) OR prediction IS NULL) AS n_bad FROM predictions GROUP BY 1, 2),
metrics AS (SELECT model, candidate, n_rows, sqrt(sse / n_rows) AS rmse, mae, 1 - sse / (variance * n_rows) AS r2, n_bad FROM sums),
ranked AS (SELECT *, CAST(row_number() OVER (ORDER BY rmse, mae, r2 DESC, candidate) AS INT) AS rank,
  CAST(rank() OVER (ORDER BY rmse, mae, r2 DESC) AS INT) AS place FROM metrics)
"""
_METRIC_COLUMNS = f"model, candidate, n_rows, {sql_r6('rmse')} AS rmse, {sql_r6('mae')} AS mae, {sql_r6('r2')} AS r2, n_bad"


@query("e14_candidate_ranking", v.sql_with(METRICS_SQL, f"SELECT {_METRIC_COLUMNS}, rank FROM ranked"))
def candidate_ranking(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rank_candidates(regression_metrics(predictions(spark, sf), ("model", "candidate"))).drop("tied_with_champion"))


@query("e15_ties_with_champion", v.sql_with(METRICS_SQL, "SELECT model, rank, (place = 1 AND rank > 1) AS tied_with_champion FROM ranked"))
def ties(spark: SparkSession, sf: str) -> DataFrame:
    ranked = rank_candidates(regression_metrics(predictions(spark, sf), ("model", "candidate")))
    return ranked.select("model", "rank", "tied_with_champion")


@query("f03_champion", v.sql_with(METRICS_SQL, f"SELECT {_METRIC_COLUMNS}, rank FROM ranked WHERE rank = 1"))
def best_candidate(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(champion(regression_metrics(predictions(spark, sf), ("model", "candidate"))))


@query("f01_sorted_master", v.on_readings("SELECT district_code, date, station_count FROM (SELECT district_code, date, rainfall_station_count AS station_count FROM master) ORDER BY 1, 2"))
def sorted_master(spark: SparkSession, sf: str) -> DataFrame:
    rows = v.master(spark, sf).select(*KEYS, F.col("rainfall_station_count").alias("station_count"))
    return sorted_for_people(rows, *KEYS)


@query(
    "f02_offending_keys",
    v.on_events("""SELECT district_code, CAST(ts AS DATE) AS date, count(*) AS "count" FROM readings_events GROUP BY 1, 2 HAVING count(*) > 1 ORDER BY 1, 2 LIMIT 5"""),
)
def offending_keys(spark: SparkSession, sf: str) -> DataFrame:
    rows = v.readings_events(spark, sf).withColumn("date", F.to_date("ts"))
    return key_sample(rows, ["district_code", "date"])


def _feature_sql() -> str:
    spec = default_features()
    columns = [f"{CALENDAR_SQL[n]} AS {n}" for n in CALENDAR_SQL]
    columns += [lag_sql(c, k) for c, ks in spec.lags.items() for k in ks]
    columns += [rolling_sql(c, n, s) for c, r in spec.rolling.items() for n in r.windows for s in r.stats]
    columns += [x for c in spec.trends.columns for k in spec.trends.intervals for x in change_sql(c, k)]
    columns += [
        sql_r6("rainfall_mm / (air_temperature + 1.0)") + " AS rain_temp_ratio",
        "consecutive_dry_days",
        "consecutive_wet_days",
        sql_r6(f"(rainfall_mm - avg(rainfall_mm) OVER {_over(30)}) / (stddev_samp(rainfall_mm) OVER {_over(30)} + 1e-5)") + " AS rainfall_30d_anomaly",
    ]
    return v.sql_with(v.READINGS_VIEW + "," + SPELLS_SQL, "SELECT district_code, date, " + ", ".join(columns) + " FROM spells")


@query("e16_feature_table", _feature_sql())
def feature_table(spark: SparkSession, sf: str) -> DataFrame:
    base = v.master(spark, sf)
    return _new_columns(build_features(base, default_features()), base)


@query("e16b_feature_table_in_segments", _feature_sql())
def feature_table_in_segments(spark: SparkSession, sf: str) -> DataFrame:
    base = v.master(spark, sf)
    return _new_columns(build_features(base, default_features(), Series(segment_days=500)), base)


@query(
    "e00_flagship",
    v.on_readings(
        "SELECT district_code, district, date, "
        + ", ".join(f"{sql_r6(c)} AS {c}" for c in ("groundwater_level", "relative_humidity", "rainfall_mm", "river_level", "air_temperature"))
        + ", "
        + ", ".join(f"{CALENDAR_SQL[n]} AS {n}" for n in ("month", "day_of_week", "is_monsoon"))
        + f", {lag_sql('groundwater_level', 1)}, {lag_sql('groundwater_level', 7)}, {rolling_sql('rainfall_mm', 7, 'mean')}, {sql_r6('target')} AS target FROM targeted"
    ),
)
def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """For each district and day: five measures, their history, and the value seven rows ahead."""
    rows = v.master(spark, sf)
    rows = lag_features(rows, {"groundwater_level": (1, 7)})
    rows = rolling_features(rows, {"rainfall_mm": RollingSpec((7,))})
    rows = calendar_features(with_target(rows, TargetSpec()))
    return rounded(
        rows.select(
            "district_code", "district", "date", "groundwater_level", "relative_humidity", "rainfall_mm", "river_level",
            "air_temperature", "month", "day_of_week", "is_monsoon", "groundwater_level_lag_1", "groundwater_level_lag_7",
            "rainfall_mm_rolling_7d_mean", "target",
        )
    )


@query("i01_transform_registry", f"SELECT {sql_r6('l_extendedprice')} AS back, {sql_r6('sqrt(l_extendedprice)')} AS forward FROM lineitem")
def transform_registry(spark: SparkSession, sf: str) -> DataFrame:
    register_transform("square_root", F.sqrt, lambda c: c * c, rejects=lambda c: c < 0)
    forward = get_transform("square_root").forward(F.col("l_extendedprice"))
    return v.table(spark, sf, "lineitem").select(r6(invert_target(forward, "square_root")).alias("back"), r6(forward).alias("forward"))


@query(
    "i02_groupwise_transform",
    v.on_readings("""SELECT district_code, date, count(*) FILTER (WHERE groundwater_level IS NULL) OVER (PARTITION BY district_code, run) AS gap_rows
      FROM (SELECT *, count(groundwater_level) OVER (PARTITION BY district_code ORDER BY date ROWS UNBOUNDED PRECEDING) AS run FROM master)"""),
)
def groupwise_transform(spark: SparkSession, sf: str) -> DataFrame:
    """A value of the whole run a row belongs to, given back to each of its rows."""
    w = Series().window()
    run = F.count("groundwater_level").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = v.master(spark, sf).select(*KEYS, "groundwater_level", run.alias("run"))
    gap = F.count_if(F.col("groundwater_level").isNull()).over(Window.partitionBy("district_code", "run"))
    return rows.select(*KEYS, gap.alias("gap_rows"))
