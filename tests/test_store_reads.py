"""Detection over a summary store reads it once, and shuffles what may be a finding, not the table."""

import re

import pytest
from pyspark.sql import functions as F

from tablewash.operators import issues as iss
from tablewash.operators.frequency import Frequencies, value_facts
from tablewash.operators.table import RID
from tablewash.plans.dataset import Dataset


def _rows(frame):
    return sorted(map(str, frame.collect()))


def test_spellings_are_looked_for_once(spark):
    rows = [(i, f"id {i}", ["Lyon", "lyon", "Nice"][i % 3]) for i in range(60)]
    df = spark.createDataFrame(rows, f"{RID} bigint, id string, city string")
    data = Dataset.load(df)
    kept = data.frequencies()
    found = iss.inconsistent_categories(kept)
    (folder,) = data.summary.folders()
    assert not any(folder.split("/")[-1] in f for f in found.inputFiles())
    (issue,) = found.collect()
    assert (issue["column"], issue["count"]) == ("city", 2) and '"city"' in issue["params"] and '"lyon":"Lyon"' in issue["params"]
    assert kept.kinds == {"id": "string", "city": "string"}
    data.close()


@pytest.mark.parametrize("twins", [0, 3])
def test_copies_are_looked_for_where_one_column_repeats(spark, twins):
    rows = [(f"k{i}", i % 4, None if i % 2 else "") for i in range(40)]
    rows += [(f"k{i}", i % 4, "" if i % 2 else None) for i in range(twins)]  # null equals ''
    rows += [("k9", 7, "other"), ("", 1, ""), (None, 1, None)]  # one pair more
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"{RID} bigint, id string, n int, _shared string")
    data = Dataset.load(df)
    some = iss.maybe_copied(data.frequencies())
    assert some.count() == 2 * twins + 2 + 2
    assert _rows(iss.duplicate_rows(some)) == _rows(iss.duplicate_rows(df))
    assert iss.duplicate_rows(some).first()["count"] == twins + 1
    data.close()


def test_tables_without_a_telling_column_or_rows(spark):
    pairs = spark.createDataFrame([(i, "a", i % 2 + 0.5) for i in range(8)], f"{RID} bigint, x string, y double")
    for df, copies in ((pairs, [6]), (pairs.limit(0), [])):
        data = Dataset.load(df)
        assert [r["count"] for r in data.issues().where("kind = 'duplicate_rows'").collect()] == copies
        assert _rows(data.issues()) == _rows(iss.detect_issues(Frequencies(df)))
        data.close()


def test_facts_stay_within_what_the_jvm_compiles(spark):
    vf = spark.range(10).select(F.lit("x").alias("column"), F.col("id").cast("string").alias("value"), F.col("id").alias("cnt"), F.col("id").alias("first_rid"))
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen")
    shown = value_facts(vf)._jdf.queryExecution().explainString(mode)
    assert all(int(n) < 8000 for n in re.findall(r"maxMethodCodeSize:(\d+)", shown))
