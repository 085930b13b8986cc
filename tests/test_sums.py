"""Sums that one decimal cannot hold."""

from pyspark.sql import functions as F

from tablewash.functions.numbers import exact_mean, exact_sum, joined, weighted_sums


def test_counts_and_numbers_beyond_one_decimal(spark):
    cases = {
        "often": [(0.0, 10**11), (0.1, 3 * 10**11), (-2.5, 10)],
        "large": [(1e15, 1), (0.25, 1), (-1e15, 1), (3e20, 2), (-3e20, 2)],
        "both": [(1e15, 10**11), (0.5, 10**11)],
        "plain": [(123456789.1, 3), (-0.3, 1)],
        "far": [(9e25, 9 * 10**18), (-9e25, 9 * 10**18), (7.5, 2)],
    }
    rows = [(k, v, n) for k, own in cases.items() for v, n in own]
    df = spark.createDataFrame(rows, "k string, num double, cnt bigint")
    parts, whole, _ = weighted_sums(F.col("num"), F.col("cnt"))
    found = df.groupBy("k").agg(joined(*parts).alias("total"), whole.alias("whole"))
    wanted = {"often": 3e10 - 25, "large": 0.25, "both": 1e26 + 5e10, "plain": 370370367.0, "far": 15.0}
    assert {r["k"]: (r["total"], r["whole"]) for r in found.collect()} == {k: (v, True) for k, v in wanted.items()}


def test_totals_beyond_one_decimal_do_not_depend_on_row_order(spark):
    values = [9e25, 9e25, 0.5, -9e25, -9e25, 0.25]
    for own in (values, values[::-1]):
        df = spark.createDataFrame([(v,) for v in own], "num double").coalesce(1)
        assert tuple(df.agg(exact_sum(F.col("num")), exact_mean(F.col("num"))).first()) == (0.75, 0.125)
    huge = spark.createDataFrame([(9e25,), (2e25,), (0.5,)], "num double").coalesce(1)
    assert huge.agg(exact_sum(F.col("num"))).first()[0] == 1.1e26
