"""Content fingerprints that do not depend on row order or on partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A SHA-256 has 64 hex digits: four lanes of 16. The sum of 10^18 numbers of a lane fits a decimal(38, 0).
LANES, LANE_DIGITS = 4, 16


def row_text(df: DataFrame) -> Column:
    """One text for each row, different for different rows: each cell comes after its length, a missing one as -."""
    cells = []
    for name in df.columns:
        text = F.col(f"`{name}`").cast("string")
        cells.append(F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.concat(*cells) if cells else F.lit("")


def row_digest(df: DataFrame, secure: bool = True) -> list[Column]:
    """Numbers for each row: its SHA-256 in four lanes, or the faster xxHash64."""
    if not secure:
        return [F.xxhash64(*df.columns).cast("decimal(38,0)")]
    digest = F.sha2(row_text(df), 256)
    return [
        F.conv(F.substring(digest, 1 + LANE_DIGITS * i, LANE_DIGITS), 16, 10).cast("decimal(38,0)") for i in range(LANES)
    ]


def table_fingerprint(df: DataFrame, *by: str, secure: bool = True) -> DataFrame:
    """Rows, columns with types, and digest sums, for the table or for each value of the given columns.

    The sums are combined on the map side, so a few numbers leave each task. digest_sum is the first
    lane, the others are digest_sum_2 and so on.
    """
    body = df.drop(*by)
    lanes = row_digest(body, secure)
    names = ["digest_sum", *[f"digest_sum_{i + 1}" for i in range(1, len(lanes))]]
    tagged = df.select(*by, *[lane.alias(name) for lane, name in zip(lanes, names)])
    schema = ",".join(f"{f.name} {f.dataType.simpleString()}" for f in body.schema.fields)
    return tagged.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"), *[F.sum(name).alias(name) for name in names]
    ).withColumn("columns", F.lit(schema))
