"""Five district-day tables to one master table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorloom.config import (
    CATEGORIES,
    CATEGORY,
    CATEGORY_BY_NAME,
    COUNTS,
    DATE,
    DISTRICT,
    DISTRICT_CODE,
    MASTER_COLUMNS,
    MASTER_KEYS,
    MEASUREMENT,
    MEASURES,
    STATION_COUNT,
)
from sensorloom.errors import DataCheckError
from sensorloom.functions.casts import to_day
from sensorloom.operators.checks import require_columns, require_numeric
from sensorloom.sources.scratch import scratch_folder

LEFT_MARK, RIGHT_MARK = "_in_left", "_in_right"


def normalised_keys(df: DataFrame) -> DataFrame:
    """District code as long and date as date; what cannot be read becomes NULL."""
    types = dict(df.dtypes)
    date = to_day(F.col(DATE)) if types[DATE] == "string" else F.to_date(DATE)
    return df.withColumns({DISTRICT_CODE: F.col(DISTRICT_CODE).try_cast("bigint"), DATE: date})


def key_violations(df: DataFrame) -> DataFrame:
    """NULLs the normalisation would add, and key parts that are missing already."""
    after = normalised_keys(df.withColumns({"_code": F.col(DISTRICT_CODE), "_date": F.col(DATE)}))
    counts = after.agg(
        F.count_if(F.col(DISTRICT_CODE).isNull() & F.col("_code").isNotNull()).alias("code_new"),
        F.count_if(F.col(DATE).isNull() & F.col("_date").isNotNull()).alias("date_new"),
        F.count_if(F.col("_code").isNull()).alias("code_null"),
        F.count_if(F.col("_date").isNull()).alias("date_null"),
    )
    return counts.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(rule).alias("rule"), F.col(n).alias("n_rows"))
                    for rule, n in (
                        ("district code cannot be read", "code_new"),
                        ("date cannot be read", "date_new"),
                        ("district code is missing", "code_null"),
                        ("date is missing", "date_null"),
                    )
                ]
            )
        )
    )


def for_master(df: DataFrame, category: str) -> DataFrame:
    """The five columns of one category under their master names."""
    names = CATEGORY_BY_NAME[category]
    return df.select(
        DISTRICT_CODE,
        DATE,
        DISTRICT,
        F.col(MEASUREMENT).alias(names.measure),
        F.col(STATION_COUNT).alias(names.count),
    )


def one_category(aggregated: DataFrame, category: str) -> DataFrame:
    return for_master(aggregated.where(F.col(CATEGORY) == category), category)


def store_by_key(aggregated: DataFrame, buckets: int | None = None) -> DataFrame:
    """The district-day table stored by category, bucketed and sorted by the master keys.

    Joins of categories and the pivot to the master table read it without an exchange of a stored
    side, however often they run. The files lie in the folder that spark.checkpoint.dir names.
    """
    spark = aggregated.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder = scratch_folder(spark)
    name = "daily_" + folder.rsplit("/", 1)[-1]
    # Rows of a bucket meet first, so that each bucket of a category is one file.
    rows = aggregated.repartition(n, *MASTER_KEYS)
    rows.write.partitionBy(CATEGORY).bucketBy(n, *MASTER_KEYS).sortBy(*MASTER_KEYS).option("path", folder).saveAsTable(name)
    return spark.table(name)


def outer_join(left: DataFrame, right: DataFrame, marks: bool = False) -> DataFrame:
    """Full outer join on the master keys; the label is the left one, else the right one.

    Keys are unique on both sides (checked upstream), so no key is hot and no row multiplies.
    """
    lhs, rhs = left, right.withColumnRenamed(DISTRICT, "_right_district")
    if marks:
        lhs, rhs = lhs.withColumn(LEFT_MARK, F.lit(1)), rhs.withColumn(RIGHT_MARK, F.lit(1))
    joined = lhs.join(rhs, list(MASTER_KEYS), "full_outer")
    rest = [c for c in joined.columns if c not in (*MASTER_KEYS, DISTRICT, "_right_district")]
    return joined.select(
        *MASTER_KEYS, F.coalesce(DISTRICT, "_right_district").alias(DISTRICT), *rest
    )


def match_counts(left: DataFrame, right: DataFrame) -> DataFrame:
    """Matched, left-only and right-only rows of the join. Only the keys are read and shuffled."""
    keys = [*MASTER_KEYS]
    joined = outer_join(left.select(*keys, DISTRICT), right.select(*keys, DISTRICT), marks=True)
    in_left, in_right = F.col(LEFT_MARK).isNotNull(), F.col(RIGHT_MARK).isNotNull()
    return joined.agg(
        F.count_if(in_left).alias("rows_before_left"),
        F.count_if(in_right).alias("rows_before_right"),
        F.count(F.lit(1)).alias("rows_after"),
        F.count_if(in_left & in_right).alias("matched_rows"),
        F.count_if(in_left & ~in_right).alias("left_only_rows"),
        F.count_if(~in_left & in_right).alias("right_only_rows"),
    )


def _in_order(frames: Mapping[str, DataFrame], order: Sequence[str] | None) -> list[str]:
    names = list(order or [c.name for c in CATEGORIES if c.name in frames])
    absent = [n for n in names if n not in frames]
    if absent:
        raise DataCheckError(f"merge order names categories that were not given: {absent}")
    if len(names) < 2:
        raise DataCheckError(f"at least two categories are needed, got {names}")
    return names


def join_categories(
    frames: Mapping[str, DataFrame], order: Sequence[str] | None = None
) -> DataFrame:
    """Fold of outer joins, for inputs that come as separate tables.

    All joins share their keys, so each input is shuffled once and the result of one join
    is already partitioned for the next.
    """
    return reduce(outer_join, [frames[n] for n in _in_order(frames, order)])


def join_stored(stored: DataFrame, order: Sequence[str] | None = None) -> DataFrame:
    """The rows of join_categories from a table of store_by_key, without any exchange.

    The result of a full outer join has no partitioning that Spark knows, so each further join would
    shuffle it again. Here all distinct keys, which the buckets hold together, are the left side of one
    left join for each category; those keep the partitioning of the buckets.
    """
    names = list(order or [c.name for c in CATEGORIES])
    out = stored.where(F.col(CATEGORY).isin(*names)).select(*MASTER_KEYS).distinct()
    labels = []
    for i, name in enumerate(names):
        out = out.join(one_category(stored, name).withColumnRenamed(DISTRICT, f"_label_{i}"), list(MASTER_KEYS), "left")
        labels.append(f"_label_{i}")
    rest = [c for c in out.columns if c not in (*MASTER_KEYS, *labels)]
    return out.select(*MASTER_KEYS, F.coalesce(*labels).alias(DISTRICT), *rest)


def join_steps(frames: Mapping[str, DataFrame], order: Sequence[str] | None = None) -> DataFrame:
    """Match statistics of every step of the fold, without running the fold."""
    names = _in_order(frames, order)
    tagged = [frames[n].select(*MASTER_KEYS, F.lit(n).alias(CATEGORY)) for n in names]
    return category_steps(reduce(DataFrame.unionByName, tagged), names)


def category_steps(aggregated: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """The same statistics from one long table.

    One grouped pass notes which categories hold a key; step k matches the keys of categories
    1 to k-1 with those of category k.
    """
    names = list(names or [c.name for c in CATEGORIES])
    present = aggregated.groupBy(*MASTER_KEYS).agg(
        *[F.max((F.col(CATEGORY) == n).cast("int")).alias(f"in_{j}") for j, n in enumerate(names)]
    )
    sums = []
    for k in range(1, len(names)):
        before = F.greatest(*[F.col(f"in_{j}") for j in range(k)], F.lit(0)) == 1
        here = F.col(f"in_{k}") == 1
        sums += [
            F.count_if(before).alias(f"left_{k}"),
            F.count_if(here).alias(f"right_{k}"),
            F.count_if(before & here).alias(f"both_{k}"),
        ]
    steps = [
        F.struct(
            F.lit(k).alias("step"),
            F.lit("+".join(names[:k])).alias("left_dataset"),
            F.lit(names[k]).alias("right_dataset"),
            F.col(f"left_{k}").alias("rows_before_left"),
            F.col(f"right_{k}").alias("rows_before_right"),
            (F.col(f"left_{k}") + F.col(f"right_{k}") - F.col(f"both_{k}")).alias("rows_after"),
            F.col(f"both_{k}").alias("matched_rows"),
            (F.col(f"left_{k}") - F.col(f"both_{k}")).alias("left_only_rows"),
            (F.col(f"right_{k}") - F.col(f"both_{k}")).alias("right_only_rows"),
        )
        for k in range(1, len(names))
    ]
    return present.agg(*sums).select(F.inline(F.array(*steps)))


def master_table(aggregated: DataFrame) -> DataFrame:
    """The same rows as the fold from one long table: one aggregate, no join."""
    category = F.col(CATEGORY)

    def pick(value: str, name: str):
        return F.max(F.when(category == name, F.col(value)))

    return (
        aggregated.groupBy(*MASTER_KEYS)
        .agg(
            F.coalesce(*[pick(DISTRICT, c.name) for c in CATEGORIES]).alias(DISTRICT),
            *[pick(MEASUREMENT, c.name).alias(c.measure) for c in CATEGORIES],
            *[pick(STATION_COUNT, c.name).alias(c.count) for c in CATEGORIES],
        )
        .select(*MASTER_COLUMNS)
    )


def master_report(df: DataFrame) -> DataFrame:
    """Rows, repeated keys and NULLs of each column, in long form; schema errors raise."""
    require_columns(df, MASTER_COLUMNS, "master table")
    if not isinstance(df.schema[DISTRICT_CODE].dataType, T.LongType):
        raise DataCheckError(f"{DISTRICT_CODE} must be a long, not {df.schema[DISTRICT_CODE].dataType}")
    require_numeric(df, [*MEASURES, *COUNTS], "master table")
    nulls = df.groupBy(*MASTER_KEYS).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in df.columns],
    )
    totals = nulls.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_rows"),
        F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("duplicate_keys"),
        *[F.coalesce(F.sum(f"null_{c}"), F.lit(0)).alias(f"null_{c}") for c in df.columns],
    )
    entries = [
        F.struct(F.lit(k).alias("metric"), F.col(v).alias("value"))
        for k, v in [
            ("total_rows", "total_rows"),
            ("duplicate_keys", "duplicate_keys"),
            *[(f"missing {c}", f"null_{c}") for c in df.columns],
        ]
    ]
    return totals.select(F.inline(F.array(*entries)))
