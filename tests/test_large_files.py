"""Files read by several tasks, in order, with their headers compared."""

import csv
import random

import pytest
from pyspark.sql import functions as F

from tablewash.operators.table import RID
from tablewash.sources.delimited import read_delimited


@pytest.fixture
def small_blocks(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "10")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def _rows(pick, n):
    cells = ["plain", "with, comma", 'say "yes"', "two\nlines", '"\n"\n"', "", "é ü", "x" * 700, "line\n" * 60, "  padded "]
    return [(str(i), pick.choice(cells), pick.choice(cells)) for i in range(n)]


def _write(path, rows, header=("id", "a", "b"), end="\n"):
    with open(path, "w", newline="", encoding="utf-8") as file:
        out = csv.writer(file, lineterminator=end)
        out.writerow(header)
        out.writerows(rows)


def _read(df):
    assert df.columns[0] == RID
    rows = df.orderBy(RID).collect()
    assert len({r[RID] for r in rows}) == len(rows)
    return [tuple(r)[1:] for r in rows]


def _wanted(rows):
    return [tuple(c or None for c in r) for r in rows]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("files", [1, 5])
def test_quoted_line_breaks_across_blocks(spark, tmp_path, small_blocks, files, end):
    pick = random.Random(files)
    folder, wanted = tmp_path / "in", []
    folder.mkdir()
    for f in range(files):
        rows = _rows(pick, pick.randint(1, 120))
        _write(folder / f"part{f}.csv", rows, end=end)
        wanted += _wanted(rows)
    path = str(folder / "part0.csv") if files == 1 else str(folder)
    split = read_delimited(spark, path, ",", parallel=True)
    assert split.rdd.getNumPartitions() > files or files > 1
    assert _read(split) == wanted
    assert _read(read_delimited(spark, path, ",")) == wanted


def test_one_line_records_keep_their_order(spark, tmp_path, small_blocks):
    folder, wanted = tmp_path / "in", []
    folder.mkdir()
    for f in range(4):
        rows = [(f"{f}-{i}", "y" * ((i * 7) % 30), "z") for i in range(40 + 170 * (f == 2))]
        _write(folder / f"part{f}.csv", rows)
        wanted += _wanted(rows)
    assert _read(read_delimited(spark, str(folder), ",", multi_line=False)) == wanted
    plan = read_delimited(spark, str(folder / "part2.csv"), ",", multi_line=False)
    assert "Join" not in plan._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("how", [{}, {"multi_line": False}, {"parallel": True}])
def test_other_headers_fail(spark, tmp_path, how):
    folder = tmp_path / "in"
    folder.mkdir()
    _write(folder / "a.csv", [("1", "2", "3")])
    _write(folder / "b.csv", [("4", "5", "6")], header=("id", "b", "a"))
    with pytest.raises(Exception, match="(?i)header"):
        read_delimited(spark, str(folder), ",", **how).select(F.count("*")).collect()
        read_delimited(spark, str(folder), ",", **how).collect()


def test_whole_file_in_one_record(spark, tmp_path, small_blocks):
    path = tmp_path / "one.csv"
    _write(path, [("1", "line\n" * 2000, "end"), ("2", "x", "y")])
    assert _read(read_delimited(spark, str(path), ",", parallel=True)) == [("1", "line\n" * 2000, "end"), ("2", "x", "y")]
