import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tablewash.operators.table import RID  # noqa: E402

TESTDATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "6g")
        # Generated code that does not compile fails the test.
        .config("spark.sql.codegen.fallback", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


SHOP = [
    ("A1", "2026-01-05", "Lyon", "$1,200", "yes"),
    ("A2", "05/02/2026", "lyon ", "(300)", "no"),
    ("A3", "7 Mar 2026", "LYON", "N/A", "yes"),
    ("A1", "2026-01-05", "Lyon", "$1,200", "yes"),
    ("A4", "2026-04-09", "Nice", "45%", "no"),
    ("A5", "someday", None, " 80 ", "no"),
    ("A6", "2026-05-11", "nice", None, "yes"),
    ("A7", "12.06.2026", "Nice", "99", "yes"),
]


@pytest.fixture(scope="session")
def shop(spark):
    rows = [(i, *r) for i, r in enumerate(SHOP)]
    schema = f"{RID} bigint, id string, day string, city string, amount string, flag string"
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def cells(spark):
    """Apply a cell function to a list of texts."""

    def run(function, values):
        df = spark.createDataFrame(list(enumerate(values)), "i int, v string").repartition(4)
        from pyspark.sql import functions as F

        return [r[0] for r in df.select(function(F.col("v")).alias("r"), "i").orderBy("i").select("r").collect()]

    return run


def values(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]
