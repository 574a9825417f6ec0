"""CSV records whose quoted cells hold line ends, read by many tasks.

A file is read as lines, split as any text. A line end belongs to a cell if the file holds an odd number
of quotes before it; a doubled quote counts twice and changes nothing. So each split counts its quotes and
its record starts for both cases, open or closed at its first line; one prefix over the counts of the
splits tells which case holds, and to which record the lines before a split's first start belong. Only
records of several lines are grouped; a record of one line is never moved again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorloom.errors import DataCheckError

QUOTE = '"'


def _lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Lines with their file, split and quotes (odd or not), numbered in the order of the split."""
    lines = spark.read.option("lineSep", "\n").text(list(paths))
    return lines.select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split"),
        (F.length(F.regexp_replace("value", f"[^{QUOTE}]+", "")) % 2).alias("odd"),
        # Rows of a split follow each other in one task.
        F.monotonically_increasing_id().alias("line"),
    )


def _with_starts(lines: DataFrame) -> DataFrame:
    """For each line, the record starts of its split so far, if the split begins closed and if open."""
    so_far = Window.partitionBy("file", "split").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    before = F.sum("odd").over(so_far) - F.col("odd")
    lines = lines.withColumn("open", before % 2)
    return lines.withColumns(
        {
            "starts_closed": F.sum(1 - F.col("open")).over(so_far),
            "starts_open": F.sum("open").over(so_far),
        }
    )


def split_states(lines: DataFrame) -> DataFrame:
    """For each file and split: whether it begins inside a cell, and the last record start before it.

    The rows are as many as there are splits. A file that ends inside a cell is no CSV and raises.
    """
    counts = _with_starts(lines.drop("value")).groupBy("file", "split").agg(
        (F.sum("odd") % 2).alias("odd"), F.max("starts_closed").alias("closed"), F.max("starts_open").alias("opened")
    )
    order = Window.partitionBy("file").orderBy("split")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    states = counts.withColumn("inside", F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2)
    starts = F.when(F.col("inside") == 1, F.col("opened")).otherwise(F.col("closed"))
    states = states.withColumn("starts", starts)
    some = F.when(F.col("starts") > 0, F.struct("split", "starts"))
    states = states.withColumn("before", F.last(some, ignorenulls=True).over(before))
    ends_open = (F.sum("odd").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) % 2) == 1
    message = F.concat(F.lit("a quoted cell is not closed in "), F.col("file"))
    return states.select("file", "split", F.when(ends_open, F.raise_error(message)).otherwise(F.col("inside")).alias("inside"), "before")


def csv_records(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """record, file and is_header (the first record of its file) of CSV files; blank lines are left out."""
    lines = _lines(spark, paths)
    states = split_states(lines)
    there = states.select(F.col("file").alias("_file"), F.col("split").alias("_split"), "inside", "before")
    rows = _with_starts(lines).join(there, (F.col("file") == F.col("_file")) & (F.col("split") == F.col("_split")))
    inside = F.col("inside") == 1
    starts = F.when(inside, F.col("starts_open")).otherwise(F.col("starts_closed"))
    is_start = (F.col("open") + F.col("inside")) % 2 == 0
    own = F.struct("split", starts.cast("long").alias("starts"))
    rows = rows.select(
        "file",
        "split",
        "line",
        "value",
        F.when(starts > 0, own).otherwise(F.col("before")).alias("record"),
        (is_start & (F.col("odd") == 0)).alias("whole"),
    )
    first = (F.col("record.split") == 0) & (F.col("record.starts") == 1)
    single = rows.where("whole").select(F.col("value").alias("text"), "file", first.alias("is_header"))
    parts = rows.where(~F.col("whole")).groupBy("file", "record").agg(F.sort_array(F.collect_list(F.struct("split", "line", "value"))).alias("parts"))
    joined = parts.select(F.concat_ws("\n", F.transform("parts", lambda p: p["value"])).alias("text"), "file", first.alias("is_header"))
    # The end of a record may be a carriage return and a line feed.
    text = F.regexp_replace("text", "\r$", "")
    found = single.unionByName(joined).select(text.alias("record"), "file", "is_header")
    return found.where(F.trim("record") != "")


def read_records(spark: SparkSession, paths: Sequence[str], names: Sequence[str], dialect: dict[str, str]) -> DataFrame:
    """The columns of the records behind the headers, all as text, named as given."""
    if len(set(names)) != len(names):
        raise DataCheckError(f"columns {sorted(c for c in set(names) if list(names).count(c) > 1)} are named twice")
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
    records = csv_records(spark, paths).where(~F.col("is_header"))
    cells = F.from_csv("record", schema.simpleString()[7:-1].replace(":", " "), {**dialect, "multiLine": "true"})
    return records.select(cells.alias("_cells")).select(*[F.col(f"_cells.c{i}").alias(c) for i, c in enumerate(names)])
