"""Sums that are exact for every double."""

import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tablewash.operators.aggregate import aggregate_groups
from tablewash.operators.sums import exact_totals
from tablewash.operators.table import RID


def _near(got, exact):
    """Within one unit in the last place of the true sum."""
    if exact == 0:
        return got == 0
    return abs(Fraction(got) - exact) <= Fraction(2) ** -52 * abs(exact)


def _groups():
    pick = random.Random(7)
    groups = {
        "wide": [1e300, 1.0, -1e300, 1e-300],
        "tiny": [5e-324, 5e-324, 2.2e-308, -5e-324],
        "cancel": [1e16, 1.0, -1e16, 1e-20],
        "negative": [-1e300, -1e-5, -7.0, 3.5],
        "powers": [2.0**e for e in range(-1074, 1020, 7)],
        "below powers": [2.0**e * (1 - 2**-53) for e in range(-1000, 1023, 13)],
        "zeros": [0.0, -0.0],
        "money": [0.1] * 10 + [19.99] * 7,
    }
    for i in range(12):
        groups[f"r{i}"] = [pick.choice([-1, 1]) * pick.random() * 10.0 ** pick.randint(-40 * (i % 4), 40 * (i % 3) + 1) for _ in range(60)]
    return groups


def test_totals_are_exact_in_any_order(spark):
    groups = _groups()
    rows = [(k, v) for k, own in groups.items() for v in own]
    found = []
    for seed in (1, 2):
        random.Random(seed).shuffle(rows)
        df = spark.createDataFrame([*rows, ("none", None)], "k string, num double").repartition(3)
        found.append({r["k"]: (r["n"], r["total"]) for r in exact_totals(df, ["k"], F.col("num")).collect()})
    assert found[0] == found[1] and set(found[0]) == set(groups)
    for k, own in groups.items():
        n, total = found[0][k]
        assert n == len(own) and _near(total, sum(map(Fraction, own))), k


def test_counts_of_a_trillion(spark):
    rows = [("a", 1e300, 10**12), ("a", 1.0, 10**11), ("b", 0.5, 10**12), ("b", -0.5, 10**12), ("b", 3e-300, 10**6), ("c", -123.25, 10**11)]
    df = spark.createDataFrame(rows, "k string, num double, cnt bigint")
    found = {r["k"]: (r["n"], r["total"]) for r in exact_totals(df, ["k"], F.col("num"), F.col("cnt")).collect()}
    assert found == {"a": (11 * 10**11, 1e312), "b": (2 * 10**12 + 10**6, 3e-294), "c": (10**11, -123.25e11)} or _near(
        found["b"][1], Fraction(3e-300) * 10**6
    )
    assert found["c"][1] == -123.25e11 and found["a"][1] == float("inf")


METRICS = [
    {"fn": "sum", "column": "x"}, {"fn": "avg", "column": "x"}, {"fn": "count"}, {"fn": "min", "column": "x"},
    {"fn": "max", "column": "y"}, {"fn": "sum", "column": "y"},
]


@pytest.mark.parametrize("distinct", [False, True])
@pytest.mark.parametrize("keys", [[], ["k"], ["k", "a.b"]])
def test_groups_with_all_metrics(spark, keys, distinct):
    rows = [("p", "u", "$1.10", 1e300), ("p", "u", "2.20", -1e300), ("p", "v", "x", 1.0), (None, "v", "(3)", None), ("q", "v", None, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"{RID} bigint, k string, `a.b` string, x string, y double")
    metrics = METRICS + ([{"fn": "distinct", "column": "x"}] if distinct else [])
    found = aggregate_groups(df, keys, metrics)
    names = ["sum_x", "avg_x", "count_rows", "min_x", "max_y", "sum_y"] + (["distinct_x"] if distinct else [])
    assert found.columns == [*keys, *names, "_first"]
    got = {tuple(r[: len(keys)]): tuple(r[len(keys) :]) for r in found.collect()}
    if not keys:
        assert got[()] == (0.3, 0.1, 5, -3.0, 1e300, 1.0, *([4] if distinct else []), 0)
    elif len(keys) == 1:
        assert got[("p",)] == (3.3, 1.65, 3, 1.1, 1e300, 1.0, *([3] if distinct else []), 0)
        assert got[("(blank)",)] == (-3.0, -3.0, 1, -3.0, None, None, *([1] if distinct else []), 3)
        assert got[("q",)] == (None, None, 1, None, None, None, *([0] if distinct else []), 4)
    else:
        assert len(got) == 4 and got[("p", "v")][:3] == (None, None, 1)
    assert aggregate_groups(df.limit(0), keys, metrics).collect() == []
