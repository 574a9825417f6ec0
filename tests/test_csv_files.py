"""CSV files with other headers, and cells with line ends that lie over the borders of splits."""

import csv
import random

import pytest

from sensorloom.errors import DataCheckError
from sensorloom.sources.csv_records import csv_records
from sensorloom.sources.files import DIALECT, files_by_header, read_raw_csv, read_with_file_name

CELLS = ["a", "", 'x "q" y', "two\nlines", "comma, here", "\n", '"', '""', 'ends"', 'l1\n\nl3\n"q"\n', " pad ", "é\nü", None, "w" * 700 + "\n" * 900]


@pytest.fixture
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "400", "spark.sql.files.openCostInBytes": "0"}
    old = {k: spark.conf.get(k) for k in keys}
    for k, x in keys.items():
        spark.conf.set(k, x)
    yield
    for k, x in old.items():
        spark.conf.set(k, x)


def test_cells_over_splits_equal_the_reader_of_whole_files(spark, tmp_path, small_splits):
    rng = random.Random(3)
    files = []
    for f in range(3):
        files.append(str(tmp_path / f"file {f}.csv"))
        with open(files[-1], "w", newline="") as out:
            w = csv.writer(out, lineterminator="\r\n" if f == 2 else "\n")
            w.writerow(["A", "B", " C "])
            w.writerows([f"{f}-{i}", rng.choice(CELLS), rng.choice(CELLS)] for i in range(150))
    found = read_raw_csv(spark, files, blank_markers=False, multi_line=True)
    want = spark.read.csv(files, header=True, multiLine=True, schema="A string, B string, C string", **DIALECT)
    order = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    assert order(found) == order(want) and found.count() == 450
    assert spark.read.text(files).rdd.getNumPartitions() > 40  # each split is one task
    assert "whole" not in found.columns and found.columns == ["A", "B", "C"]


def test_lines_of_one_record_only_are_grouped(spark, tmp_path, small_splits):
    (tmp_path / "a.csv").write_text('A,B\n1,2\n\n  \n3,"4\n5"\n6,7')
    records = [(r["record"], r["is_header"]) for r in csv_records(spark, [str(tmp_path / "a.csv")]).collect()]
    assert sorted(records) == [("1,2", False), ('3,"4\n5"', False), ("6,7", False), ("A,B", True)]
    (tmp_path / "b.csv").write_text('A,B\n1,"x\n2,y\n')
    with pytest.raises(Exception, match="not closed"):
        csv_records(spark, [str(tmp_path / "b.csv")]).collect()


def test_each_file_is_read_by_its_header(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a b%.csv").write_text("x,y\n1,2\n")
    (folder / "c.csv").write_text("y, x ,z\n4,3,5\n")
    (folder / "d.csv").write_text("x,y\n6,7\n")
    (folder / "e.csv").write_text("")
    rows = read_raw_csv(spark, str(folder))
    assert sorted(rows.columns) == ["x", "y", "z"]
    assert sorted((r["x"], r["y"], r["z"]) for r in rows.collect()) == [("1", "2", None), ("3", "4", "5"), ("6", "7", None)]
    assert [len(f) for f in files_by_header(spark, str(folder)).values()] == [2, 1]


def test_clashes_and_wrong_headers_raise(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x, x\n1,2\n")
    with pytest.raises(DataCheckError, match="twice"):
        read_raw_csv(spark, str(tmp_path / "a.csv"))
    (tmp_path / "b.csv").write_text("y,x\n1,2\n")
    for read in (read_raw_csv, read_with_file_name):
        with pytest.raises(Exception, match="(?i)header"):
            read(spark, str(tmp_path / "b.csv"), ["x", "y"]).collect()
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "c.csv").write_text("")
    with pytest.raises(DataCheckError, match="header"):
        read_raw_csv(spark, str(tmp_path / "none"))
