"""Stored summaries and radix selection."""

import math
import os
import random
import struct

import pytest
from pyspark.sql import functions as F

from tablewash.operators import issues as iss
from tablewash.operators import profile as prof
from tablewash.operators.frequency import Frequencies
from tablewash.operators.quantile import coarse_histogram, exact_quantiles, with_order_bits
from tablewash.operators.table import RID, with_order
from tablewash.operators.transforms import apply_op
from tablewash.plans.dataset import Dataset

SCHEMA = "column string, num double, cnt bigint"


def _bits(x):
    (n,) = struct.unpack("<q", struct.pack("<d", abs(x)))
    return -n if x < 0 else n


def test_bits_are_those_of_the_double(spark):
    pick = random.Random(1)
    values = [0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308, -1.0, 0.1]
    values += [s * math.ldexp(m, e) for e in range(-1073, 1024, 3) for m in (0.5, 1 - 2**-53, pick.uniform(0.5, 1)) for s in (1, -1)]
    df = spark.createDataFrame([("x", v, 1) for v in values], SCHEMA)
    for r in with_order_bits(df).collect():
        assert r["bits"] == _bits(r["num"]), r["num"]


@pytest.mark.parametrize("probs", [[0.0, 0.25, 0.5, 1.0]])
def test_ranks_by_hand(spark, probs):
    pick = random.Random(2)
    columns = {
        "rates": [pick.uniform(1e-12, 1e-3) for _ in range(4000)],
        "spread": [pick.choice([-1, 1]) * 10.0 ** pick.uniform(-300, 300) for _ in range(900)],
        "equal": [7.25] * 50,
        "near": [1.0 + i * 2.0**-52 for i in range(300)],
        "signs": [-3.0, -0.0, 0.0, 5e-324, -5e-324, 2.0],
        "one": [4.0],
    }
    rows = [(c, v, n) for c, own in columns.items() for v, n in zip(own, [pick.randint(1, 3) for _ in own], strict=True)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    found = {(r["column"], r["p"]): (r["value"], r["n"]) for r in exact_quantiles(df, probs).collect()}
    for c in columns:
        every = sorted(v for name, v, n in rows if name == c for _ in range(n))
        for p in probs:
            assert found[c, p] == (every[math.floor(p * (len(every) - 1))], len(every))


def test_crowded_numbers_leave_one_value_in_the_last_bucket(spark):
    df = spark.range(200_000).select(
        F.lit("rates").alias("column"), (F.pow(F.lit(10.0), F.col("id") / 200_000 * 9 - 12)).alias("num"), F.lit(1).cast("bigint").alias("cnt")
    )
    placed, hist = coarse_histogram(df)
    assert hist.count() > 5000  # the first share alone spreads them
    assert placed.groupBy("bits").agg(F.count_distinct("num").alias("d")).agg(F.max("d")).first()[0] == 1
    (row,) = exact_quantiles(df, [0.5]).collect()
    every = sorted(10.0 ** (i / 200_000 * 9 - 12) for i in range(200_000))
    assert math.isclose(row["value"], every[(200_000 - 1) // 2], rel_tol=1e-12) and row["n"] == 200_000


def _rows(frame):
    return sorted(map(str, frame.collect()))


def test_store_tells_what_the_table_tells(spark, shop):
    data, plain = Dataset.load(shop), Frequencies(shop)
    kept = data.frequencies()
    for f in (prof.infer_types, prof.common_profile, prof.sample_values, prof.top_values, prof.number_profile, prof.date_formats, iss.outliers):
        assert _rows(f(kept)) == _rows(f(plain)), f
    assert _rows(prof.profile_columns(kept)) == _rows(prof.profile_columns(plain))
    assert _rows(data.issues()) == _rows(iss.detect_issues(plain))
    data.close()


def test_only_what_a_step_changed_is_scanned_again(spark, shop):
    data = Dataset.load(shop)
    assert data.summary.build() == ["id", "day", "city", "amount", "flag"]
    assert data.summary.build() == []
    first = data.summary.folders()
    data.approve(data.propose("trim_whitespace", {"column": "city"}).id)
    assert data.summary.build() == ["city"]
    data.approve(data.propose("rename_column", {"column": "flag", "to": "ok"}).id)
    assert data.summary.build() == []
    assert {r["column"] for r in data.frequencies(["ok"]).stats.collect()} == {"ok"}
    data.approve(data.propose("derive_column", {"name": "both", "from": ["id", "city"], "operation": "concat"}).id)
    assert data.summary.build() == ["both"]
    assert _rows(prof.common_profile(data.frequencies())) == _rows(prof.common_profile(Frequencies(data.table)))
    data.approve(data.propose("drop_column", {"column": "both"}).id)
    assert data.summary.build() == []
    data.approve(data.propose("deduplicate", {}).id)
    assert data.summary.build() == ["id", "day", "city", "amount", "ok"]
    made = set().union(*(s.folders() for s in data._stores))
    data.undo()
    assert data.summary.build() == []
    data.reset()
    assert data.summary.build() == [] and data.summary.folders() == first
    assert all(os.path.exists(p.removeprefix("file:")) == (p in first) for p in made)
    data.close()
    assert not any(os.path.exists(p.removeprefix("file:")) for p in made)


def test_plans_over_the_store_do_not_read_the_table(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.createDataFrame([(i, str(i % 5), "x" * (i % 3)) for i in range(50)], "i int, a string, b string").write.parquet(path)
    data = Dataset.load(spark.read.parquet(path), order_by="i")
    for frame in (data.overview(), data.profile(), prof.number_profile(data.frequencies())):
        assert path not in frame._jdf.queryExecution().optimizedPlan().toString() + str(frame.inputFiles())
    data.close()


def test_large_mapping_is_read_from_the_store(spark, monkeypatch):
    monkeypatch.setattr(iss, "INLINE_MAPPING", 3)
    rows = [(0, "Lyon"), (1, "lyon"), (2, "LYON"), (3, "lYon"), (4, "Nice"), (5, "nice")]
    data = Dataset.load(with_order(spark.createDataFrame(rows, "i bigint, x string"), "i"))
    (issue,) = [r for r in data.issues(column="x").collect() if r["kind"] == "inconsistent_categories"]
    later = data.table.where(f"{RID} <> 0")
    fixed = apply_op(later, "map_values", __import__("json").loads(issue["suggested_fix"]["params"]))
    assert sorted(tuple(r) for r in fixed.select(RID, "x").collect())[:3] == [(1, "Lyon"), (2, "Lyon"), (3, "Lyon")]
    data.close()
