"""Queries of the readers and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.config import (
    AGGREGATION_FILE_KEYWORDS,
    CLEANING_FILE_KEYWORDS,
    RAW_FILE_KEYWORDS,
    SENTINELS,
)
from sensorloom.functions.names import category_of
from sensorloom.operators.audit import audit_report
from sensorloom.operators.clean import clean
from sensorloom.operators.district_day import aggregation_report, with_file_category
from sensorloom.plans import views as v
from sensorloom.plans.registry import query, rounded, sql_r6
from sensorloom.sources.csv_records import read_records
from sensorloom.sources.files import (
    DIALECT,
    SplitBundle,
    csv_header,
    file_inventory,
    read_master,
    read_raw_csv,
    read_table,
    read_with_file_name,
)
from sensorloom.sources.fingerprint import table_fingerprint
from sensorloom.sources.scratch import scratch_folder
from sensorloom.sources.sinks import (
    write_cleaned_csv,
    write_report,
    write_splits,
    write_summary_csv,
    write_table,
)

VERBATIM = {"header": True, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}

FILE_NAMES_SQL = """
names AS (
  SELECT event_id, CASE event_type WHEN 'view' THEN CASE event_id % 2 WHEN 0 THEN 'GWL_tel_' ELSE 'groundwater_' END
    WHEN 'click' THEN 'Humid_tele_' WHEN 'purchase' THEN 'rainfall_tel_'
    WHEN 'error' THEN CASE event_id % 2 WHEN 0 THEN 'rwl_tel_' ELSE 'river_' END
    ELSE CASE event_id % 2 WHEN 0 THEN 'Temperature ' ELSE 'temp ' END END || user_id || '.csv' AS file_name
  FROM events)
"""


def _file_names(spark: SparkSession, sf: str) -> DataFrame:
    even, kind = F.col("event_id") % 2 == 0, F.col("event_type")
    stem = (
        F.when(kind == "view", F.when(even, "GWL_tel_").otherwise("groundwater_"))
        .when(kind == "click", "Humid_tele_")
        .when(kind == "purchase", "rainfall_tel_")
        .when(kind == "error", F.when(even, "rwl_tel_").otherwise("river_"))
        .otherwise(F.when(even, "Temperature ").otherwise("temp "))
    )
    return v.table(spark, sf, "events").select(
        "event_id", F.concat(stem, F.col("user_id").cast("string"), F.lit(".csv")).alias("file_name")
    )


@query(
    "a01_file_inventory",
    v.on_events("""SELECT DISTINCT 'category=' || category AS parent_folder, 'Unknown' AS category, '.csv' AS extension, 'RAW' AS status, TRUE AS has_bytes, TRUE AS path_ends_alike
      FROM readings_events"""),
)
def file_inventory_of_readings(spark: SparkSession, sf: str) -> DataFrame:
    folder = scratch_folder(spark)
    v.readings_events(spark, sf).write.partitionBy("category").csv(folder, header=True)
    # Spark names the files and picks their number, so the result keeps what does not depend on it.
    alike = F.expr("endswith(absolute_path, relative_path)")
    return (
        file_inventory(spark, folder)
        .select("parent_folder", "category", "extension", "status", (F.col("file_size") > 0).alias("has_bytes"), alike.alias("path_ends_alike"))
        .distinct()
    )


@query(
    "a02_category_from_file_name",
    v.sql_with(
        FILE_NAMES_SQL,
        """
SELECT raw, cleaning, aggregation, count(*) AS n_files FROM (
  SELECT CASE WHEN lower(file_name) LIKE '%gwl%' THEN 'Groundwater' WHEN lower(file_name) LIKE '%humid%' THEN 'Humidity'
      WHEN lower(file_name) LIKE '%rainfall%' THEN 'Rainfall' WHEN lower(file_name) LIKE '%rwl%' THEN 'River Level'
      WHEN lower(file_name) LIKE '%temperature%' THEN 'Temperature' ELSE 'Unknown' END AS raw,
    CASE WHEN regexp_matches(lower(file_name), 'gwl|groundwater') THEN 'Groundwater'
      WHEN lower(file_name) LIKE '%humid%' THEN 'Humidity' WHEN lower(file_name) LIKE '%rainfall%' THEN 'Rainfall'
      WHEN regexp_matches(lower(file_name), 'rwl|river') THEN 'River Level'
      WHEN lower(file_name) LIKE '%temp%' THEN 'Temperature' ELSE 'Unknown' END AS cleaning,
    CASE WHEN lower(file_name) LIKE '%gwl%' THEN 'groundwater' WHEN lower(file_name) LIKE '%humid%' THEN 'humidity'
      WHEN lower(file_name) LIKE '%rainfall%' THEN 'rainfall' WHEN lower(file_name) LIKE '%rwl%' THEN 'river_level'
      WHEN lower(file_name) LIKE '%temperature%' THEN 'temperature' END AS aggregation
  FROM names) GROUP BY raw, cleaning, aggregation""",
    ),
)
def category_from_file_name(spark: SparkSession, sf: str) -> DataFrame:
    name = F.col("file_name")
    return (
        _file_names(spark, sf)
        .select(
            category_of(name, RAW_FILE_KEYWORDS, "Unknown").alias("raw"),
            category_of(name, CLEANING_FILE_KEYWORDS, "Unknown").alias("cleaning"),
            category_of(name, AGGREGATION_FILE_KEYWORDS, None).alias("aggregation"),
        )
        .groupBy("raw", "cleaning", "aggregation")
        .agg(F.count(F.lit(1)).alias("n_files"))
    )


_MARKERS = ", ".join(f"'{s}'" for s in ("", *SENTINELS))


@query(
    "a03_csv_scan",
    v.on_dirty(
        "SELECT " + ", ".join(f'CASE WHEN "{c}" NOT IN ({_MARKERS}) THEN "{c}" END AS "{c}"' for c in v.DIRTY_COLUMNS)
        + " FROM dirty"
    ),
)
def csv_scan(spark: SparkSession, sf: str) -> DataFrame:
    folder = scratch_folder(spark)
    v.dirty(spark, sf).write.options(**VERBATIM).csv(folder)
    return read_raw_csv(spark, folder, columns=v.DIRTY_COLUMNS)


@query(
    "a04_csv_header_trim",
    v.on_readings("SELECT category, CAST(district_code AS VARCHAR) AS district_code, district, CAST(station AS VARCHAR) AS station FROM readings"),
)
def csv_header_trim(spark: SparkSession, sf: str) -> DataFrame:
    folder = scratch_folder(spark)
    rows = v.readings(spark, sf).select("category", "district_code", "district", "station")
    rows.toDF(*[f" {c}  " for c in rows.columns]).write.options(**VERBATIM).csv(folder)
    return read_raw_csv(spark, folder, columns=csv_header(spark, folder), blank_markers=False)


@query(
    "a03b_csv_line_ends_in_cells",
    v.on_events("""SELECT CAST(reading_id AS VARCHAR) AS reading_id, 'line ' || station || chr(10) || 'said "' || category || '"' || chr(10) || chr(10) AS note,
      CASE WHEN reading_id % 3 = 0 THEN NULL ELSE ',' || district END AS district FROM readings_events"""),
)
def csv_line_ends_in_cells(spark: SparkSession, sf: str) -> DataFrame:
    """All readings with a note of several lines, written and read by splits."""
    folder = scratch_folder(spark)
    line = F.concat(F.lit("line "), "station", F.lit('\nsaid "'), "category", F.lit('"\n\n'))
    district = F.when(F.col("reading_id") % 3 != 0, F.concat(F.lit(","), "district"))
    rows = v.readings_events(spark, sf).select("reading_id", line.alias("note"), district.alias("district"))
    rows.write.options(**VERBATIM, **DIALECT).csv(folder)
    return read_records(spark, [folder], ["reading_id", "note", "district"], DIALECT)


@query(
    "a04b_csv_headers_differ",
    v.on_readings("""SELECT category, CAST(district_code AS VARCHAR) AS district_code, CASE WHEN category <> 'rainfall' THEN district END AS district,
      CASE WHEN category = 'humidity' THEN CAST(station AS VARCHAR) END AS station FROM readings"""),
)
def csv_headers_differ(spark: SparkSession, sf: str) -> DataFrame:
    """Files of one scan with other columns in another order, joined by name."""
    folder = scratch_folder(spark)
    rows = v.readings(spark, sf).select("category", "district_code", "district", "station")
    kinds = {
        "category IN ('humidity')": ["station", "district", " category", "district_code "],
        "category = 'rainfall'": ["district_code", "category"],
        "category NOT IN ('humidity', 'rainfall')": ["category", "district", "district_code"],
    }
    for i, (kind, columns) in enumerate(kinds.items()):
        some = rows.where(kind).select(*[c.strip() for c in columns]).toDF(*columns)
        some.write.options(**VERBATIM).csv(f"{folder}/{i}")
    return read_raw_csv(spark, [f"{folder}/{i}" for i in range(len(kinds))], blank_markers=False)


SUMMARY_SQL = f"""SELECT category, count(*) AS n_rows, {sql_r6('min(measurement)')} AS low,
  {sql_r6('max(measurement)')} AS high FROM district_day GROUP BY category"""


def _summary(df: DataFrame) -> DataFrame:
    return rounded(
        df.groupBy("category").agg(
            F.count(F.lit(1)).alias("n_rows"), F.min("measurement").alias("low"), F.max("measurement").alias("high")
        )
    )


@query("a05_parquet_scan_guard", v.on_readings(SUMMARY_SQL))
def parquet_scan_guard(spark: SparkSession, sf: str) -> DataFrame:
    folder = scratch_folder(spark)
    write_table(v.daily(spark, sf), folder)
    return _summary(read_table(spark, folder))


@query(
    "a05b_master_csv_fallback",
    v.on_readings(f"""SELECT count(*) AS n_rows, min(date) AS first_date, max(date) AS last_date,
      {sql_r6('sum(rainfall_mm)')} AS rain FROM master"""),
)
def master_csv_fallback(spark: SparkSession, sf: str) -> DataFrame:
    folder = scratch_folder(spark)
    v.master(spark, sf).write.csv(folder, header=True)
    back = read_master(spark, f"{folder}-absent", folder)
    return rounded(
        back.agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.min("date").alias("first_date"),
            F.max("date").alias("last_date"),
            F.sum("rainfall_mm").alias("rain"),
        )
    )


SPLIT_SQL = f"""SELECT split, count(*) AS n_rows, min(date) AS first_date, max(date) AS last_date,
  {sql_r6('sum(target)')} AS target_sum FROM split GROUP BY split"""


def _split_summary(df: DataFrame, name: str) -> DataFrame:
    return rounded(
        df.agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.min("date").alias("first_date"),
            F.max("date").alias("last_date"),
            F.sum("target").alias("target_sum"),
        ).withColumn("split", F.lit(name))
    )


@query("a06_split_bundle", v.on_readings(SPLIT_SQL))
def split_bundle(spark: SparkSession, sf: str) -> DataFrame:
    folder = scratch_folder(spark)
    write_splits(v.split(spark, sf), folder)
    bundle = SplitBundle.load(spark, folder)
    first, *rest = [_split_summary(bundle[name], name) for name in bundle.NAMES]
    for part in rest:
        first = first.unionByName(part)
    return first


@query("a07_csv_sink_keeps_existing", v.on_readings("SELECT category, CAST(count(*) AS BIGINT) AS n_rows FROM district_day GROUP BY category"))
def csv_sink_keeps_existing(spark: SparkSession, sf: str) -> DataFrame:
    folder = scratch_folder(spark)
    daily = v.daily(spark, sf)
    write_cleaned_csv(daily, folder)
    # The second write finds the folder there and leaves it alone.
    write_cleaned_csv(v.readings(spark, sf), folder)
    back = read_raw_csv(spark, folder, columns=daily.columns)
    return back.groupBy("category").agg(F.count(F.lit(1)).alias("n_rows"))


@query("a08_table_sinks", v.on_readings(SUMMARY_SQL))
def table_sinks(spark: SparkSession, sf: str) -> DataFrame:
    parquet, text = scratch_folder(spark), scratch_folder(spark)
    write_table(v.daily(spark, sf), parquet, text)
    back = spark.read.schema(spark.read.parquet(parquet).schema).csv(text, header=True)
    return _summary(back)


@query(
    "a09_json_report",
    v.on_readings("""SELECT category, CAST(count(*) AS BIGINT) AS input_rows,
      CAST(count(*) FILTER (WHERE measurement IS NULL) AS BIGINT) AS missing_measurements FROM readings GROUP BY ROLLUP (category)"""),
)
def json_report(spark: SparkSession, sf: str) -> DataFrame:
    folder = scratch_folder(spark)
    write_report(aggregation_report(v.readings(spark, sf), v.daily(spark, sf)), folder)
    return spark.read.json(folder).select("category", "input_rows", "missing_measurements")


@query(
    "a10_audit_summary",
    v.on_dirty("""SELECT 'humid_dirty' AS dataset_name, CAST(count(*) AS BIGINT) AS n_rows,
      CAST(count(DISTINCT "Station") AS BIGINT) AS n_stations FROM cleaned"""),
)
def audit_summary(spark: SparkSession, sf: str) -> DataFrame:
    folder = scratch_folder(spark)
    cleaned = clean(v.dirty(spark, sf), "Humidity", v.DIRTY_NUMERIC)
    write_summary_csv(audit_report(cleaned, "humid_dirty", "ahmedabad"), folder)
    return spark.read.csv(folder, header=True, inferSchema=True).select(
        "dataset_name", F.col("n_rows").cast("bigint"), F.col("n_stations").cast("bigint")
    )


_LINE_TEXT = "concat(" + ", ".join(
    f"coalesce(concat(CAST(length(CAST({c} AS VARCHAR)) AS VARCHAR), ':', CAST({c} AS VARCHAR)), '-')"
    for c in (
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
        "l_discount", "l_tax", "l_linestatus", "l_shipdate",
    )
) + ")"
_LANES = ["digest_sum", "digest_sum_2", "digest_sum_3", "digest_sum_4"]


@query(
    "a11_table_fingerprint",
    "SELECT l_returnflag, count(*) AS n_rows, "
    + ", ".join(
        f"CAST(sum(CAST(CAST(('0x' || substr(digest, {1 + 16 * i}, 16)) AS UBIGINT) AS HUGEINT)) AS VARCHAR) AS {name}"
        for i, name in enumerate(_LANES)
    )
    + f" FROM (SELECT l_returnflag, sha256({_LINE_TEXT}) AS digest FROM lineitem) GROUP BY l_returnflag",
)
def fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    found = table_fingerprint(v.table(spark, sf, "lineitem"), "l_returnflag").drop("columns")
    return found.withColumns({name: F.col(name).cast("string") for name in _LANES})


@query(
    "g02_files_by_category",
    v.on_readings("""SELECT category, count(*) AS n_rows FROM readings GROUP BY category"""),
)
def files_by_category(spark: SparkSession, sf: str) -> DataFrame:
    """Readings written as files named after their category, read back, and grouped by file name."""
    stems = {"groundwater": "gwl", "humidity": "humid", "rainfall": "rainfall", "river_level": "rwl", "temperature": "temperature"}
    rows = v.readings(spark, sf)
    folder = scratch_folder(spark)
    stem = F.create_map(*[F.lit(x) for pair in stems.items() for x in pair])[F.col("category")]
    rows.withColumn("stem", stem).drop("category").write.partitionBy("stem").csv(folder, header=True)
    columns = [c for c in rows.columns if c != "category"]
    paths = [f"{folder}/stem={s}" for s in stems.values()]
    # Spark names the files itself, so the folder stands in for the file's name.
    back = read_with_file_name(spark, paths, columns).withColumn(
        "source_file", F.regexp_extract(F.input_file_name(), r"stem=([^/]+)/", 1)
    )
    return with_file_category(back).groupBy("category").agg(F.count(F.lit(1)).alias("n_rows"))
