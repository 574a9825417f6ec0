"""The corpus pipeline: language ID, near copies, decontamination, mixing, token output."""

from pyspark.sql import DataFrame, SparkSession

from sensorloom.llm.pipeline import STAGES, run_pipeline

__all__ = ["ORACLE_SQL", "STAGES", "run"]

#: The language model, the alignment and the tokenizer can't be stated in SQL; the tests compare the
#: stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_pipeline(spark, sf_dir)
