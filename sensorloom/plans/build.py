"""The whole job: raw files to a scored model, each stage a table the next one reads.

Every stage reads what the one before it wrote, so a lost executor costs one stage's tasks and no
stage runs an earlier one again.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.config import (
    CATEGORY,
    CATEGORY_BY_NAME,
    DISTRICT,
    DISTRICT_CODE,
    MASTER_KEYS,
    MEASUREMENT,
    STATION,
    TARGET,
    TIMESTAMP,
    FeatureSpec,
    PrepSpec,
    SplitShares,
    TargetSpec,
    default_features,
)
from sensorloom.operators.audit import audit_report, district_list
from sensorloom.operators.checks import require, require_unique
from sensorloom.operators.clean import clean_folded, cleaning_report, col, column_votes, distinct_by_value
from sensorloom.operators.district_day import (
    aggregate_violations,
    aggregation_report,
    district_day,
    reading_violations,
    require_categories,
    union_files,
)
from sensorloom.operators.drift import drift_status, schema_relation
from sensorloom.operators.feature_checks import feature_table_report, require_valid_features
from sensorloom.operators.features import build_features
from sensorloom.operators.master import category_steps, master_report, master_table
from sensorloom.operators.models import evaluate_all, load_champion, save_champion, train_all
from sensorloom.operators.prep import fit_transform, load_prep, prep_report, save_prep, transform
from sensorloom.operators.profile import column_profile
from sensorloom.operators.scoring import accepted, with_payload_error
from sensorloom.operators.split import check_continuity, check_cuts, continuity, cut_dates, split_report, with_split
from sensorloom.operators.split_checks import check_same_schema, check_split_schema
from sensorloom.operators.target import check_leakage, check_target, check_target_input, leakage_audit, with_target
from sensorloom.session import tune
from sensorloom.sources.files import SplitBundle, read_raw_csv, read_table
from sensorloom.sources.fingerprint import table_fingerprint
from sensorloom.sources.scratch import written
from sensorloom.sources.sinks import write_report, write_splits, write_table


@dataclass(frozen=True)
class JobSpec:
    features: FeatureSpec = field(default_factory=default_features)
    target: TargetSpec = TargetSpec()
    shares: SplitShares = SplitShares()
    prep: PrepSpec = PrepSpec()
    models: Mapping[str, Mapping | None] = field(
        default_factory=lambda: {"RandomForestRegressor": None, "GBTRegressor": None}
    )


def typed_readings(cleaned: DataFrame, category: str) -> DataFrame:
    """The six columns the aggregate needs, out of one cleaned category."""
    return cleaned.select(
        F.lit(category).alias(CATEGORY),
        col("District LGD Code").try_cast("bigint").alias(DISTRICT_CODE),
        col("District").alias(DISTRICT),
        col("Station").alias(STATION),
        col("Data Acquisition Time").alias(TIMESTAMP),
        col(CATEGORY_BY_NAME[category].raw_column).cast("double").alias(MEASUREMENT),
    )


def dataset_name(path: str) -> str:
    return path.rstrip("/").rsplit("/", 1)[-1].removesuffix(".csv")


def clean_file(spark: SparkSession, path: str, category: str, out: str, name_to_find: str | None = None) -> DataFrame:
    """Clean one raw file, write the result with its reports, and return it.

    The distinct rows are written once; the vote, the casts and the report all read them.
    """
    name = dataset_name(path)
    folded = distinct_by_value(read_raw_csv(spark, path))
    numeric, day_first = column_votes(folded)
    write_report(cleaning_report(folded, name, category, numeric, day_first), f"{out}/reports/cleaning/{name}")
    write_table(clean_folded(folded, category, numeric, day_first), f"{out}/cleaned/{name}")
    cleaned = read_table(spark, f"{out}/cleaned/{name}")
    write_report(audit_report(cleaned, name, name_to_find), f"{out}/reports/audit/{name}")
    district_list(cleaned).write.mode("overwrite").json(f"{out}/reports/districts/{name}")
    write_report(column_profile(cleaned), f"{out}/reports/profile/{name}")
    return cleaned


def clean_readings(
    spark: SparkSession, paths: Mapping[str, str | Sequence[str]], out: str, name_to_find: str | None = None
) -> DataFrame:
    """Clean the raw files of every category and write them as one table of readings.

    Each file (or folder of files with one header) is read by its own header and cleaned by itself;
    afterwards the schemas of each category's files are compared.
    """
    cleaned = {
        (category, dataset_name(path)): clean_file(spark, path, category, out, name_to_find)
        for category, files in paths.items()
        for path in ([files] if isinstance(files, str) else files)
    }
    write_report(drift_status(schema_relation(spark, cleaned)), f"{out}/reports/schemas")
    readings = union_files([typed_readings(df, category) for (category, _), df in cleaned.items()])
    readings.write.mode("overwrite").partitionBy(CATEGORY).parquet(f"{out}/readings")
    return read_table(spark, f"{out}/readings")


def aggregate_readings(readings: DataFrame, out: str) -> DataFrame:
    """District-day table of all categories, checked and reported."""
    spark = readings.sparkSession
    require_categories(readings)
    require(reading_violations(readings), "readings")
    write_table(district_day(readings), f"{out}/district_day")
    daily = read_table(spark, f"{out}/district_day")
    require(aggregate_violations(daily), "district-day table")
    write_report(aggregation_report(readings, daily), f"{out}/reports/aggregation")
    return daily


def build_master(daily: DataFrame, out: str) -> DataFrame:
    spark = daily.sparkSession
    write_table(master_table(daily), f"{out}/master", f"{out}/master_csv")
    master = read_table(spark, f"{out}/master")
    require_unique(master, MASTER_KEYS, "master table")
    write_report(category_steps(daily), f"{out}/reports/merge_steps")
    write_report(master_report(master), f"{out}/reports/master")
    return master


def build_feature_table(master: DataFrame, spec: FeatureSpec, out: str) -> DataFrame:
    spark = master.sparkSession
    write_table(build_features(master, spec), f"{out}/features")
    features = read_table(spark, f"{out}/features")
    write_report(feature_table_report(features, MASTER_KEYS), f"{out}/reports/features")
    require_valid_features(features, MASTER_KEYS)
    return features


def build_splits(features: DataFrame, spec: JobSpec, out: str) -> SplitBundle:
    """Target, its audits, and the three splits."""
    spark = features.sparkSession
    check_target_input(features, spec.target)
    write_table(with_target(features, spec.target), f"{out}/targeted")
    targeted = read_table(spark, f"{out}/targeted")
    name, group, date = spec.target.name, spec.target.group, spec.target.date
    check_target(targeted, name)
    audit = leakage_audit(targeted, name, [group, date])
    write_report(audit, f"{out}/reports/leakage")
    check_leakage(audit)
    gaps = continuity(targeted, group, date)
    write_report(gaps, f"{out}/reports/continuity")
    check_continuity(gaps, group)
    check_cuts(cut_dates(targeted, spec.shares, date, name))
    write_splits(with_split(targeted, spec.shares, date, name), f"{out}/splits")
    bundle = SplitBundle.load(spark, f"{out}/splits")
    write_report(split_report(bundle.table, date), f"{out}/reports/splits")
    write_report(table_fingerprint(features), f"{out}/reports/fingerprint")
    return bundle


def prepare_splits(bundle: SplitBundle, spec: PrepSpec, out: str) -> SplitBundle:
    spark = bundle.table.sparkSession
    prepared, fitted = fit_transform(bundle.table, spec)
    save_prep(spark, fitted, f"{out}/preparation")
    write_splits(prepared, f"{out}/prepared")
    write_report(prep_report(bundle.table, fitted), f"{out}/reports/preparation")
    ready = SplitBundle.load(spark, f"{out}/prepared")
    for name in SplitBundle.NAMES:
        check_split_schema(ready[name], name, spec.target, fitted.feature_names)
    check_same_schema(ready.train, ready.validation)
    return ready


def train_champion(
    ready: SplitBundle, models: Mapping[str, Mapping | None], out: str, target: TargetSpec = TargetSpec()
) -> str:
    candidates = train_all(models, ready.train, [], target.name)
    metrics = evaluate_all(candidates, ready.validation)
    return save_champion(candidates, metrics, f"{out}/champion", target=target)


def score(spark: SparkSession, rows: DataFrame, champion_path: str, keep: Sequence[str] = ()) -> DataFrame:
    """Predictions for the rows whose features are all there and finite."""
    best = load_champion(spark, champion_path)
    checked = with_payload_error(rows.select(*[col(c) for c in [*keep, *best.features]]), best.features)
    return best.score(accepted(checked), keep)


def score_raw(spark: SparkSession, rows: DataFrame, out: str, keep: Sequence[str] = ()) -> DataFrame:
    """Predictions for rows of the feature table, prepared as the train rows of the job in `out` were.

    Missing features are imputed; columns to keep keep their names and values.
    """
    prepared = transform(rows, load_prep(spark, f"{out}/preparation"), keep)
    return score(spark, prepared, f"{out}/champion", keep)


def run_job(spark: SparkSession, paths: Mapping[str, str | Sequence[str]], out: str, spec: JobSpec = JobSpec()) -> str:
    """All stages; returns the champion's name. Everything it writes lies below `out`."""
    tune(spark)
    readings = clean_readings(spark, paths, out)
    master = build_master(aggregate_readings(readings, out), out)
    bundle = build_splits(build_feature_table(master, spec.features, out), spec, out)
    return train_champion(prepare_splits(bundle, spec.prep, out), spec.models, out, spec.target)


