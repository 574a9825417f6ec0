import subprocess
import sys
import textwrap
from pathlib import Path

from sensorloom.sources.scratch import scratch_folder, written


def test_the_session_names_the_folder(spark):
    base = spark.conf.get("spark.checkpoint.dir")
    assert scratch_folder(spark).startswith(base + "/")
    df = written(spark.range(10).selectExpr("id", "id % 2 AS part"), "part")
    assert df.columns == ["id", "part"] and df.count() == 10


def test_an_unset_folder_is_made_in_a_local_session():
    code = """
        import sys; sys.path.insert(0, sys.argv[1])
        from pyspark.sql import SparkSession
        from sensorloom.sources.scratch import scratch_folder
        spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
        a, b = scratch_folder(spark), scratch_folder(spark)
        assert a != b and a.rsplit("/", 1)[0] == b.rsplit("/", 1)[0] == spark.conf.get("spark.checkpoint.dir")
    """
    root = str(Path(__file__).resolve().parents[1])
    subprocess.run([sys.executable, "-c", textwrap.dedent(code), root], check=True, timeout=120)
