"""Queries of feature preparation and models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sensorloom.config import COUNTS, MEASURES, PrepSpec, TargetSpec
from sensorloom.operators.evaluate import champion, rank_candidates
from sensorloom.operators.models import DEFAULTS, Champion, evaluate_all, load_champion, n_trees, predict, save_champion, train_all
from sensorloom.operators.prep import (
    category_counts,
    feature_types,
    fit,
    fit_numeric,
    fit_transform,
    most_frequent,
    number,
    prep_report,
    save_prep,
    transform,
)
from sensorloom.operators.scoring import accepted, with_payload_error
from sensorloom.plans import views as v
from sensorloom.plans.build import score_raw
from sensorloom.plans.registry import query, rounded, sql_r6
from sensorloom.sources.scratch import scratch_folder, written

TRAIN = "split = 'train'"


@query(
    "k01_feature_types",
    v.on_readings("""SELECT unnest(['numeric', 'categorical', 'dropped', 'excluded']) AS kind, unnest([10, 1, 0, 4]) AS n_columns,
      (SELECT count(*) FROM split) AS n_rows"""),
)
def typed_columns(spark: SparkSession, sf: str) -> DataFrame:
    split = v.split(spark, sf)
    kinds = feature_types(split)
    rows = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(len(c)).alias("n_columns")) for k, c in kinds.items()])
    return split.agg(F.count(F.lit(1)).alias("n_rows")).select(F.inline(rows), "n_rows")


NUMBERS = (*MEASURES, *COUNTS)
_IMPUTED = ", ".join(f"{sql_r6(f'coalesce({c}, (SELECT median({c}) FROM train))')} AS {c}" for c in NUMBERS)


@query("k02_median_imputation", v.on_readings(f"SELECT district_code, date, {_IMPUTED} FROM split"))
def median_imputation(spark: SparkSession, sf: str) -> DataFrame:
    # Fitting reads the rows several times, so they are written once.
    split = written(v.split(spark, sf).select("district_code", "date", *NUMBERS, "split"))
    filled = [F.coalesce(number(f.column), F.lit(f.median)).alias(f.column) for f in fit_numeric(split.where(TRAIN), NUMBERS)]
    return rounded(split.select("district_code", "date", *filled))


_SEGMENT_SQL = """
segments AS (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 101 = 1 THEN 'RARE ' || (c_custkey % 3) ELSE c_mktsegment END AS segment FROM customer),
mode_ AS (SELECT segment AS mode FROM segments WHERE segment IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
seen AS (SELECT c_custkey, coalesce(segment, mode) AS segment FROM segments, mode_),
counts AS (SELECT segment, count(*) AS n FROM seen GROUP BY 1)
"""


def _segments(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    segment = F.when(k % 7 == 0, F.lit(None)).when(k % 101 == 1, F.concat(F.lit("RARE "), (k % 3).cast("string"))).otherwise(F.col("c_mktsegment"))
    return v.table(spark, sf, "customer").select("c_custkey", segment.alias("segment"))


@query("k03_mode_imputation", v.sql_with(_SEGMENT_SQL, "SELECT segment, count(*) AS n FROM segments WHERE segment IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1"))
def mode_imputation(spark: SparkSession, sf: str) -> DataFrame:
    return most_frequent(category_counts(_segments(spark, sf), "segment")).withColumnRenamed("value", "segment")


def _scaled_sql(c: str) -> str:
    filled = f"coalesce({c}, (SELECT median({c}) FROM train))"
    over_train = f"FROM (SELECT {filled} AS x FROM train)"
    return f"{sql_r6(f'({filled} - (SELECT avg(x) {over_train})) / (SELECT coalesce(nullif(stddev_pop(x), 0), 1) {over_train})')} AS numeric__{c}"


@query("k04_standard_scaling", v.on_readings("SELECT district_code, date, " + ", ".join(_scaled_sql(c) for c in NUMBERS) + " FROM split"))
def standard_scaling(spark: SparkSession, sf: str) -> DataFrame:
    columns = ("district_code", "date", "split", "target", *NUMBERS)
    split = written(v.split(spark, sf).select(*columns))
    fitted = fit(split.where(TRAIN), PrepSpec())
    return rounded(transform(split, fitted, keep=["district_code", "date"]).drop("split", "target"))


@query(
    "k05_one_hot",
    v.sql_with(
        _SEGMENT_SQL,
        """SELECT c_custkey, """
        + ", ".join(f"""CASE WHEN s.segment = '{x}' THEN 1.0 ELSE 0.0 END AS "categorical__segment_{x}" """ for x in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"))
        + """, CASE WHEN n < 0.01 * (SELECT count(*) FROM seen) THEN 1.0 ELSE 0.0 END AS categorical__segment_infrequent_sklearn FROM seen s JOIN counts USING (segment)""",
    ),
)
def one_hot(spark: SparkSession, sf: str) -> DataFrame:
    rows = _segments(spark, sf)
    fitted = fit(rows, PrepSpec(drop=("c_custkey",)))
    return transform(rows, fitted, keep=["c_custkey"])


def _prepared_sql() -> str:
    return v.on_readings(
        "SELECT split, district_code, date, " + sql_r6("target") + " AS target, " + ", ".join(_scaled_sql(c) for c in NUMBERS)
        + """, 'categorical__district_' || CASE WHEN n >= 0.01 * (SELECT count(*) FROM train) THEN district WHEN n > 0 THEN 'infrequent_sklearn' END AS marked,
        CAST(CASE WHEN n > 0 THEN 1 ELSE 0 END AS DOUBLE) AS n_marked
        FROM (SELECT split.* EXCLUDE (district), coalesce(district, mode) AS district FROM split, (SELECT district AS mode FROM train WHERE district IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) s
        LEFT JOIN (SELECT coalesce(district, (SELECT district FROM train WHERE district IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS district, count(*) AS n FROM train GROUP BY 1) c USING (district)"""
    )


@query("k06_fit_and_transform", _prepared_sql())
def fitted_and_transformed(spark: SparkSession, sf: str) -> DataFrame:
    """All prepared columns; of the one-hot ones, the name of the one that is set and the sum of all."""
    split = written(v.split(spark, sf).select("district_code", "date", "district", *NUMBERS, "split", "target"))
    fitted = fit(split.where(TRAIN))
    prepared = transform(split, fitted, keep=["district_code", "date"])
    hot = [c for c in fitted.feature_names if c.startswith("categorical__")]
    marked = F.concat_ws(",", *[F.when(F.col(f"`{c}`") == 1, F.lit(c)) for c in hot])
    total = sum((F.col(f"`{c}`") for c in hot), F.lit(0.0))
    numbers = [F.col(c) for c in prepared.columns if c not in hot]
    return rounded(prepared.select(*numbers, F.nullif(marked, F.lit("")).alias("marked"), total.alias("n_marked")))


@query(
    "k07_prep_report",
    v.on_readings("""SELECT count(*) FILTER (WHERE split = 'train') AS train_rows, count(*) FILTER (WHERE split = 'validation') AS validation_rows,
      count(*) FILTER (WHERE split = 'test') AS test_rows, 10 AS numeric_feature_count, 1 AS categorical_feature_count,
      (SELECT CAST(10 + count(*) FILTER (WHERE n >= 0.01 * total) + CASE WHEN bool_or(n < 0.01 * total) THEN 1 ELSE 0 END AS INT)
        FROM (SELECT district, count(*) AS n, sum(count(*)) OVER () AS total FROM train GROUP BY district)) AS output_feature_count,
      'median' AS numeric_impute_strategy, 'most_frequent' AS categorical_impute_strategy, TRUE AS scale_numeric, 42 AS random_state FROM split"""),
)
def report_of_prep(spark: SparkSession, sf: str) -> DataFrame:
    split = written(v.split(spark, sf))
    return prep_report(split, fit(split.where(TRAIN)))


# Settings under which SQL can state a model: one tree over the month gives the mean of each month, a
# tree without a split the mean of all rows. The defaults of the library are the full ensembles.
MONTHS = {"RandomForestRegressor": {"numTrees": 1, "bootstrap": False, "maxDepth": 12}}
BOOSTED_MONTHS = {"GBTRegressor": {"maxIter": 3, "maxDepth": 12}}
TOTAL = {"GBTRegressor": {"maxIter": 1, "maxDepth": 0}}

_SCORED_SQL = """
(SELECT s.*, m.month_mean, t.total_mean FROM split s
  JOIN (SELECT month(date) AS month, avg(target) AS month_mean FROM train GROUP BY 1) m ON month(s.date) = m.month
  CROSS JOIN (SELECT avg(target) AS total_mean FROM train) t WHERE s.split = '{part}') scored
"""


def _metrics_sql(model: str, candidate: int, p: str) -> str:
    return f"""SELECT '{model}' AS model, {candidate} AS candidate, count(*) AS n_rows, sqrt(avg((target - {p}) ** 2)) AS rmse,
      avg(abs(target - {p})) AS mae, 1 - avg((target - {p}) ** 2) / var_pop(target) AS r2, 0 AS n_bad FROM {_SCORED_SQL.format(part="validation")}"""


_ROUNDED = f"model, candidate, n_rows, {sql_r6('rmse')} AS rmse, {sql_r6('mae')} AS mae, {sql_r6('r2')} AS r2, n_bad"
_BOTH = f"({_metrics_sql('RandomForestRegressor', 0, 'month_mean')} UNION ALL {_metrics_sql('GBTRegressor', 1, 'total_mean')})"
_RANK = "CAST(row_number() OVER (ORDER BY rmse, mae, r2 DESC, candidate) AS INT)"
METRICS = ("model", "candidate", "n_rows", "rmse", "mae", "r2", "n_bad")


def _by_month(spark: SparkSession, sf: str) -> DataFrame:
    month = F.month("date").cast("double").alias("month")
    return written(v.split(spark, sf).select("district_code", "date", month, "target", "split"), "split")


def _part(table: DataFrame, name: str) -> DataFrame:
    return table.where(F.col("split") == name).drop("split")


def _trained(table: DataFrame, registry: dict) -> list:
    return train_all(registry, _part(table, "train"), ["month"], "target")


def _scores(spark: SparkSession, sf: str, registry: dict) -> DataFrame:
    table = _by_month(spark, sf)
    return evaluate_all(_trained(table, registry), _part(table, "validation"))


@query("k08m_random_forest_by_month", v.on_readings(f"SELECT {_ROUNDED} FROM ({_metrics_sql('RandomForestRegressor', 0, 'month_mean')})"))
def random_forest_by_month(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_scores(spark, sf, MONTHS).select(*METRICS))


@query("k09m_gradient_boosting_by_month", v.on_readings(f"SELECT {_ROUNDED} FROM ({_metrics_sql('GBTRegressor', 0, 'month_mean')})"))
def gradient_boosting_by_month(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_scores(spark, sf, BOOSTED_MONTHS).select(*METRICS))


@query("k11m_evaluate_all_by_month", v.on_readings(f"SELECT {_ROUNDED}, {_RANK} AS rank, FALSE AS tied_with_champion FROM {_BOTH}"))
def evaluate_candidates_by_month(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rank_candidates(_scores(spark, sf, MONTHS | TOTAL)).select(*METRICS, "rank", "tied_with_champion"))


def _saved(spark: SparkSession, sf: str) -> tuple[str, DataFrame]:
    table = _by_month(spark, sf)
    candidates = _trained(table, MONTHS | TOTAL)
    folder = scratch_folder(spark)
    save_champion(candidates, evaluate_all(candidates, _part(table, "validation")), folder)
    return folder, table


@query("k12m_saved_champion_by_month", v.on_readings(f"SELECT {_ROUNDED}, rank FROM (SELECT *, {_RANK} AS rank FROM {_BOTH}) WHERE rank = 1"))
def saved_champion_by_month(spark: SparkSession, sf: str) -> DataFrame:
    folder, _ = _saved(spark, sf)
    return rounded(champion(spark.read.json(f"{folder}/evaluation_report")).select(*METRICS, "rank"))


@query(
    "k13m_batch_scoring_by_month",
    v.on_readings(
        f"""SELECT district_code, date, {sql_r6("target")} AS target, {sql_r6("CASE WHEN best = 0 THEN month_mean ELSE total_mean END")} AS prediction
        FROM {_SCORED_SQL.format(part="test")}, (SELECT candidate AS best FROM {_BOTH} ORDER BY rmse, mae, r2 DESC, candidate LIMIT 1)"""
    ),
)
def batch_scoring_by_month(spark: SparkSession, sf: str) -> DataFrame:
    """The saved champion read back, and every acceptable test row scored by it."""
    folder, table = _saved(spark, sf)
    best = load_champion(spark, folder)
    rows = with_payload_error(_part(table, "test"), best.features)
    return rounded(best.score(accepted(rows), keep=["district_code", "date", best.target]))


@query(
    "k13b_raw_scoring",
    v.on_readings(f"""SELECT district_code, date, {sql_r6("exp(month_log) - 1")} AS prediction FROM split s
      JOIN (SELECT month(date) AS month, avg(ln(1 + abs(target))) AS month_log FROM train GROUP BY 1) m ON month(s.date) = m.month WHERE s.split = 'test'"""),
)
def raw_scoring(spark: SparkSession, sf: str) -> DataFrame:
    """Preparation and model of a log1p target saved, read back and applied to raw rows, in source units."""
    table = _by_month(spark, sf).withColumn("target", F.log1p(F.abs("target")))
    folder = scratch_folder(spark)
    prepared, fitted = fit_transform(table.select("date", "month", "target", "split", F.lit("all").alias("kind")))
    save_prep(spark, fitted, f"{folder}/preparation")
    ready = written(prepared, "split")
    candidates = train_all(MONTHS, _part(ready, "train"), [], "target")
    metrics = evaluate_all(candidates, _part(ready, "validation"))
    save_champion(candidates, metrics, f"{folder}/champion", target=TargetSpec(transform="log1p"))
    rows = _part(table, "test").select("district_code", "date", "month", F.lit("all").alias("kind"))
    return rounded(score_raw(spark, rows, folder, keep=["district_code", "date"]))


_FITTED: dict[tuple, object] = {}


def _once(spark: SparkSession, sf: str, what: str, make):
    """The value of make(), computed once in an application; the queries below share fits that take a minute."""
    key = (spark.sparkContext.applicationId, sf, what)
    if key not in _FITTED:
        _FITTED[key] = make()
    return _FITTED[key]


def _ready(spark: SparkSession, sf: str) -> DataFrame:
    """All prepared features of the three splits, with the keys of their rows."""

    def make() -> DataFrame:
        split = written(v.split(spark, sf))
        fitted = fit(split.where(TRAIN))
        return written(transform(split, fitted, keep=["district_code", "date"]), "split")

    return _once(spark, sf, "prepared", make)


def _features(ready: DataFrame) -> list[str]:
    return [c for c in ready.columns if c.startswith(("numeric__", "categorical__"))]


def _defaults(spark: SparkSession, sf: str, *names: str) -> list:
    """The library's default ensembles (all, or those named), fitted side by side on all prepared features."""
    names = names or tuple(DEFAULTS)
    ready, key = _ready(spark, sf), (spark.sparkContext.applicationId, sf)
    absent = [n for n in names if (*key, n) not in _FITTED]
    if absent:
        for c in train_all(dict.fromkeys(absent), _part(ready, "train"), _features(ready), "target"):
            _FITTED[*key, c.name] = c
    return [_FITTED[*key, n] for n in names]


def _default_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return _once(spark, sf, "metrics", lambda: evaluate_all(_defaults(spark, sf), _part(_ready(spark, sf), "validation")))


def _default_saved(spark: SparkSession, sf: str) -> str:
    def make() -> str:
        folder = scratch_folder(spark)
        save_champion(_defaults(spark, sf), _default_metrics(spark, sf), folder)
        return folder

    return _once(spark, sf, "saved", make)


_N_FEATURES = """(SELECT CAST(10 + count(*) FILTER (WHERE n >= 0.01 * total) + CASE WHEN bool_or(n < 0.01 * total) THEN 1 ELSE 0 END AS INT)
  FROM (SELECT district, count(*) AS n, sum(count(*)) OVER () AS total FROM train GROUP BY district))"""
_N_VALIDATION = "(SELECT count(*) FROM split WHERE split = 'validation')"


def _fit_sql(model: str) -> str:
    return f"""SELECT '{model}' AS model, CAST(300 AS INT) AS n_trees, {_N_FEATURES} AS n_features, (SELECT count(*) FROM train) AS train_rows,
      {_N_VALIDATION} AS validation_rows, CAST(0 AS BIGINT) AS n_bad, TRUE AS fits_train, TRUE AS near_targets"""


def _fit_row(spark: SparkSession, sf: str, model: str) -> DataFrame:
    """What holds for a fit on any rows: better than the mean on its train rows, finite, near the targets."""
    ready = _ready(spark, sf)
    (trained,) = _defaults(spark, sf, model)
    train = _part(ready, "train")
    spread, low, high = train.agg(F.stddev_pop("target"), F.min("target"), F.max("target")).first()
    # Both splits are scored at once: sending a deep forest to the tasks takes longer than to score some rows.
    rows = ready.where(F.col("split").isin("train", "validation"))
    scores = written(Champion(model, trained.model, trained.features, "target").score(rows, keep=["target", "split"]))
    own = scores.where(TRAIN).agg(F.sqrt(F.avg(F.pow(F.col("target") - F.col("prediction"), 2)))).first()[0]
    # The mean of train targets lies among them; a sum of corrections may pass them a little.
    slack = 1e-6 if model == "RandomForestRegressor" else spread
    seen = scores.where("split = 'validation'").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.isnan("prediction") | (F.abs("prediction") == float("inf")) | F.col("prediction").isNull()).alias("bad"),
        F.count_if(~F.col("prediction").between(low - slack, high + slack)).alias("outside"),
    ).first()
    row = (model, n_trees(trained.model), len(trained.features), trained.train_rows, seen["n"], seen["bad"], own < spread, seen["outside"] == 0)
    kinds = "model string, n_trees int, n_features int, train_rows bigint, validation_rows bigint, n_bad bigint, fits_train boolean, near_targets boolean"
    return spark.createDataFrame([row], kinds)


@query("k08_random_forest", v.on_readings(_fit_sql("RandomForestRegressor")))
def random_forest(spark: SparkSession, sf: str) -> DataFrame:
    """300 trees of depth 30 on all prepared features."""
    return _fit_row(spark, sf, "RandomForestRegressor")


@query("k09_gradient_boosting", v.on_readings(_fit_sql("GBTRegressor")))
def gradient_boosting(spark: SparkSession, sf: str) -> DataFrame:
    """300 rounds of depth 6 on all prepared features."""
    return _fit_row(spark, sf, "GBTRegressor")


@query(
    "k10_train_all",
    v.on_readings(f"""SELECT model, CAST(300 AS INT) AS n_trees, {_N_FEATURES} AS n_features, (SELECT count(*) FROM train) AS train_rows, TRUE AS default_settings
      FROM (SELECT unnest(['RandomForestRegressor', 'GBTRegressor']) AS model)"""),
)
def train_candidates(spark: SparkSession, sf: str) -> DataFrame:
    rows = [(c.name, n_trees(c.model), len(c.features), c.train_rows, c.settings == DEFAULTS[c.name]) for c in _defaults(spark, sf)]
    return spark.createDataFrame(rows, "model string, n_trees int, n_features int, train_rows bigint, default_settings boolean")


@query(
    "k11_evaluate_all",
    v.on_readings(f"""SELECT CAST(rank AS INT) AS rank, {_N_VALIDATION} AS n_rows, CAST(0 AS BIGINT) AS n_bad, TRUE AS is_a_candidate, TRUE AS metrics_agree, TRUE AS in_order
      FROM (SELECT unnest([1, 2]) AS rank)"""),
)
def evaluate_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Metrics of both candidates on all validation rows: R2 and RMSE tell the same error, ranks follow it."""
    spread = _part(_ready(spark, sf), "validation").agg(F.var_pop("target")).first()[0]
    ranked = rank_candidates(_default_metrics(spark, sf))
    agree = F.abs(1 - F.pow("rmse", F.lit(2)) / spread - F.col("r2")) < 1e-6
    best = F.min("rmse").over(Window.partitionBy())  # two rows
    ordered = F.when(F.col("rank") == 1, F.col("rmse") == best).otherwise(F.col("rmse") >= best)
    return ranked.select("rank", "n_rows", "n_bad", F.col("model").isin(*DEFAULTS).alias("is_a_candidate"), agree.alias("metrics_agree"), ordered.alias("in_order"))


@query(
    "k12_saved_champion",
    v.on_readings(f"SELECT CAST(1 AS INT) AS rank, {_N_VALIDATION} AS n_rows, TRUE AS has_least_rmse, {_N_FEATURES} AS n_features, CAST(300 AS INT) AS n_trees, TRUE AS names_agree"),
)
def saved_champion(spark: SparkSession, sf: str) -> DataFrame:
    """What the saved reports and the saved model say of the champion."""
    folder = _default_saved(spark, sf)
    report, loaded = spark.read.json(f"{folder}/evaluation_report"), load_champion(spark, folder)
    best, least = champion(report).first(), report.agg(F.min("rmse")).first()[0]
    row = (best["rank"], best["n_rows"], best["rmse"] == least, len(loaded.features), n_trees(loaded.model), loaded.name == best["model"])
    return spark.createDataFrame([row], "rank int, n_rows bigint, has_least_rmse boolean, n_features int, n_trees int, names_agree boolean")


@query(
    "k13_batch_scoring",
    v.on_readings(f"SELECT district_code, date, {sql_r6('target')} AS target, TRUE AS scored, TRUE AS as_trained FROM split WHERE split = 'test'"),
)
def batch_scoring(spark: SparkSession, sf: str) -> DataFrame:
    """The saved champion read back; every acceptable test row gets what the fitted one gives it."""
    folder = _default_saved(spark, sf)
    best = load_champion(spark, folder)
    fitted = next(c for c in _defaults(spark, sf) if c.name == best.name)
    rows = accepted(with_payload_error(_part(_ready(spark, sf), "test"), best.features))
    keys = ["district_code", "date", best.target]
    scored = best.score(rows, keep=keys)
    again = Champion(best.name, fitted.model, best.features, best.target).score(rows, keep=keys[:2]).withColumnRenamed("prediction", "again")
    both = scored.join(again, keys[:2])
    return rounded(both.select(*keys, F.col("prediction").isNotNull().alias("scored"), (F.abs(F.col("prediction") - F.col("again")) < 1e-9).alias("as_trained")))


_FULL_SQL = """SELECT CAST(2 AS BIGINT) AS n_candidates, CAST(2 AS BIGINT) AS n_full, (SELECT count(*) FROM train) AS train_rows,
  (SELECT count(*) FROM split WHERE split = 'validation') AS validation_rows, TRUE AS ranked_by_rmse,
  (SELECT count(*) FROM split WHERE split = 'test') AS scored_rows, TRUE AS forest_within_targets, TRUE AS champion_is_best"""


@query("k14_default_models", v.on_readings(_FULL_SQL))
def default_models(spark: SparkSession, sf: str) -> DataFrame:
    """The library's default ensembles on all prepared features: evaluated, ranked, saved, read back and applied to the test rows."""
    ready = _ready(spark, sf)
    return _invariants(spark, ready, _defaults(spark, sf))


def invariants(spark: SparkSession, split: DataFrame, registry: dict) -> DataFrame:
    """One row of what holds for any fitted models: counts, rank order, the champion's error, the range of a forest."""
    prepared, _ = fit_transform(written(split))
    ready = written(prepared, "split")
    return _invariants(spark, ready, train_all(registry, _part(ready, "train"), [], "target"))


def _invariants(spark: SparkSession, ready: DataFrame, candidates: list) -> DataFrame:
    train, validation, test = (_part(ready, p) for p in ("train", "validation", "test"))
    metrics = evaluate_all(candidates, validation)
    folder = scratch_folder(spark)
    save_champion(candidates, metrics, folder)
    ranked = rank_candidates(metrics).orderBy("rank").collect()
    best = load_champion(spark, folder)
    scored = best.score(accepted(with_payload_error(test, best.features)), keep=[best.target])
    forest = next(c for c in candidates if c.name == "RandomForestRegressor")
    low, high = train.agg(F.min("target"), F.max("target")).first()
    outside = predict(forest, test).where(~F.col("prediction").between(low - 1e-6, high + 1e-6)).count()
    row = (
        len(ranked),
        sum(c.settings == DEFAULTS[c.name] for c in candidates),
        candidates[0].train_rows,
        ranked[0]["n_rows"],
        [r["rmse"] for r in ranked] == sorted(r["rmse"] for r in ranked),
        scored.where("prediction is not null").count(),
        outside == 0,
        champion(spark.read.json(f"{folder}/evaluation_report")).first()["rmse"] == min(r["rmse"] for r in ranked),
    )
    kinds = "n_candidates bigint, n_full bigint, train_rows bigint, validation_rows bigint, ranked_by_rmse boolean, scored_rows bigint, forest_within_targets boolean, champion_is_best boolean"
    return spark.createDataFrame([row], kinds)
