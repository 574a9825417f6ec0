"""Scans of raw files and of tables written by earlier steps."""

from __future__ import annotations

import csv
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorloom.config import RAW_FILE_KEYWORDS, SPLIT
from sensorloom.errors import DataCheckError
from sensorloom.functions.casts import null_markers
from sensorloom.functions.names import category_of, trimmed_names
from sensorloom.sources.csv_records import read_records


def file_inventory(spark: SparkSession, folder: str, glob: str = "*.csv") -> DataFrame:
    """One row for each raw file below the folder. File contents are pruned, so none is read."""
    listed = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob)
        .load(folder)
        .select("path", "length", "modificationTime")
    )
    # The scheme is dropped, and the blanks that a URI encodes are restored.
    path = F.url_decode(F.regexp_replace("path", r"^[a-z0-9]+:/*(?=/)", ""))
    root = folder.rstrip("/")
    parent = root.rsplit("/", 1)[0]
    file_name = F.element_at(F.split(path, "/"), -1)
    return listed.select(
        F.regexp_replace(file_name, r"\.[^.]*$", "").alias("dataset_name"),
        category_of(file_name, RAW_FILE_KEYWORDS, "Unknown").alias("category"),
        F.substring(path, F.lit(len(parent) + 2), F.length(path)).alias("relative_path"),
        path.alias("absolute_path"),
        F.col("length").alias("file_size"),
        F.regexp_extract(file_name, r"(\.[^.]*)$", 1).alias("extension"),
        F.col("modificationTime").alias("last_modified"),
        F.element_at(F.split(path, "/"), -2).alias("parent_folder"),
        F.lit("RAW").alias("status"),
    )


#: A quote inside a quoted cell is doubled, as in the raw files; a backslash is an ordinary character.
DIALECT = {"quote": '"', "escape": '"'}


def csv_header(spark: SparkSession, paths: str | Sequence[str]) -> list[str]:
    """Column names as the file spells them."""
    return spark.read.csv(paths, header=True, inferSchema=False, **DIALECT).columns


def _first_record(spark: SparkSession, path: str) -> list[str]:
    """The cells of a file's first record; nothing behind it is read."""
    hadoop = spark._jvm.org.apache.hadoop
    conf, at = spark._jsparkSession.sessionState().newHadoopConf(), hadoop.fs.Path(path)
    stream = at.getFileSystem(conf).open(at)
    try:
        codec = hadoop.io.compress.CompressionCodecFactory(conf).getCodec(at)
        java = spark._jvm.java.io
        reader = java.BufferedReader(java.InputStreamReader(codec.createInputStream(stream) if codec else stream, "UTF-8"))
        text = reader.readLine()
        while text is not None and not text.strip():
            text = reader.readLine()
        while text is not None and text.count(DIALECT["quote"]) % 2:
            more = reader.readLine()
            if more is None:
                raise DataCheckError(f"the header of {path} is not closed")
            text += "\n" + more
    finally:
        stream.close()
    return [] if text is None else next(csv.reader([text], strict=True))


def _listed(spark: SparkSession, paths: str | Sequence[str]) -> list[str]:
    return sorted(unquote(f) for f in spark.read.text(paths).inputFiles())


def _in_several_splits(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    size = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getFileStatus(at).getLen()
    return size > spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()


def files_by_header(spark: SparkSession, paths: str | Sequence[str]) -> dict[tuple[str, ...], list[str]]:
    """Files below the paths by their header, as each file spells it; files without one are left out."""
    files = _listed(spark, paths)
    with ThreadPoolExecutor(16) as pool:
        headers = list(pool.map(lambda f: tuple(_first_record(spark, f)), files))
    found: dict[tuple[str, ...], list[str]] = {}
    for header, file in zip(headers, files):
        if header:
            found.setdefault(header, []).append(file)
    if not found:
        raise DataCheckError(f"no file of {paths} has a header")
    return found


def _scan(
    spark: SparkSession, paths: str | Sequence[str], names: Sequence[str], multi_line: bool = False
) -> DataFrame:
    """Text columns with trimmed names from files that all have this header; another one raises."""
    trimmed = trimmed_names(names)
    twice = sorted({c for c in trimmed if trimmed.count(c) > 1})
    if twice:
        raise DataCheckError(f"columns {twice} occur twice in the header {list(names)}")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in names])
    options = dict(header=True, schema=schema, enforceSchema=False, **DIALECT)
    if not multi_line:
        return spark.read.csv(paths, **options).toDF(*trimmed)
    # A file of one split is one task's work anyway, and needs no shuffle.
    large, small = [], []
    for file in _listed(spark, paths):
        (large if _in_several_splits(spark, file) else small).append(file)
    frames = [spark.read.csv(small, multiLine=True, **options).toDF(*trimmed)] if small else []
    frames += [read_records(spark, large, trimmed, DIALECT)] if large else []
    return reduce(DataFrame.unionByName, frames)


def read_raw_csv(
    spark: SparkSession,
    paths: str | Sequence[str],
    columns: Sequence[str] | None = None,
    blank_markers: bool = True,
    multi_line: bool = False,
) -> DataFrame:
    """Every column as text with its name trimmed; Spark's input splits replace chunked reading.

    Files are read by their own headers, one scan for all that share one, and joined by name; a column
    that a file lacks is NULL there. With the columns given, all files must have that very header, and
    none is looked at first. Cells that hold line ends need multi_line, which takes one shuffle
    of the files that have more than one split.
    """
    if columns:
        raw = _scan(spark, paths, columns, multi_line)
    else:
        frames = [_scan(spark, files, header, multi_line) for header, files in files_by_header(spark, paths).items()]
        raw = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    if not blank_markers:
        return raw
    return raw.select(*[null_markers(F.col(f"`{c}`")).alias(c) for c in raw.columns])


def read_with_file_name(
    spark: SparkSession, paths: str | Sequence[str], columns: Sequence[str]
) -> DataFrame:
    """Raw text rows with the file each came from; all files must have the columns as their header."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    raw = spark.read.csv(paths, header=True, schema=schema, enforceSchema=False, **DIALECT)
    names = trimmed_names(columns)
    return raw.select(
        *[F.col(f"`{c}`").alias(n) for c, n in zip(columns, names)],
        F.col("_metadata.file_name").alias("source_file"),
    )


def read_table(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A Parquet table that must hold rows; the test stops at the first row found."""
    df = spark.read.format(fmt).load(path)
    if df.isEmpty():
        raise DataCheckError(f"{path} holds no rows")
    return df


def read_master(spark: SparkSession, parquet: str, csv_path: str | None = None) -> DataFrame:
    """The Parquet copy if there is one, else the CSV copy with its date column typed."""
    try:
        return read_table(spark, parquet)
    except Exception as err:
        if csv_path is None or "PATH_NOT_FOUND" not in str(err):
            raise
    df = spark.read.csv(csv_path, header=True, inferSchema=True, **DIALECT)
    return df.withColumn("date", F.to_date("date"))


class SplitBundle:
    """Three read-only views of one table partitioned by split; each reads its own folder only."""

    NAMES = ("train", "validation", "test")

    def __init__(self, table: DataFrame) -> None:
        self.table = table

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> SplitBundle:
        bundle = cls(spark.read.parquet(path))
        for name in cls.NAMES:
            if bundle[name].isEmpty():
                raise DataCheckError(f"split '{name}' of {path} holds no rows")
        return bundle

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.NAMES:
            raise KeyError(name)
        return self.table.where(F.col(SPLIT) == name).drop(SPLIT)

    @property
    def train(self) -> DataFrame:
        return self["train"]

    @property
    def validation(self) -> DataFrame:
        return self["validation"]

    @property
    def test(self) -> DataFrame:
        return self["test"]
