"""Session settings that suit these jobs."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    # The JVM compiles no method above 8,000 bytes of bytecode. Spark's own limit is far higher, so
    # a stage with many text expressions would run in the interpreter; below it Spark splits them.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Window frames cost far more time than bytes: small partitions are kept apart, so that a few
    # districts do not end up in one task. Large shuffles are not affected.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "256KB",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the settings to the session, except those its owner chose."""
    chosen = spark.sparkContext.getConf()
    for key, value in SETTINGS.items():
        if not chosen.contains(key):
            spark.conf.set(key, value)
    return spark
