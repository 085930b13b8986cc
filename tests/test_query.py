"""Predicates, sort, paging and aggregates."""

import pytest
from conftest import TESTDATA, values

from tablewash.functions.compare import OPERATORS
from tablewash.operators import aggregate as agg
from tablewash.operators.query import filter_rows, query_rows
from tablewash.operators.table import RID, with_order


def ids(df):
    return sorted(r[0] for r in df.select(RID).collect())


@pytest.mark.parametrize(
    ("operator", "column", "value", "expected"),
    [
        ("eq", "amount", 1200, [0, 3]),
        ("eq", "city", "nice", [6]),
        ("eq", "city", "", [5]),
        ("neq", "city", "Lyon", [1, 2, 4, 5, 6, 7]),
        ("gt", "amount", 90, [0, 3, 7]),
        ("gte", "amount", "80", [0, 3, 5, 7]),
        ("lt", "amount", 1, [1, 4]),
        ("lte", "day", "2026-05-02", [0, 1, 2, 3, 4]),
        ("contains", "city", "LY", [0, 1, 2, 3]),
        ("starts_with", "day", "2026-0", [0, 3, 4, 6]),
        ("in", "amount", ["99", -300, "N/A"], [1, 2, 7]),
        ("is_blank", "amount", None, [2, 6]),
        ("not_blank", "city", None, [0, 1, 2, 3, 4, 6, 7]),
    ],
)
def test_operators(shop, operator, column, value, expected):
    assert ids(filter_rows(shop, [{"column": column, "operator": operator, "value": value}])) == expected


def test_operators_on_typed_columns(spark):
    df = spark.createDataFrame([(0, 5.0), (1, float("nan")), (2, None), (3, 7.5)], f"{RID} bigint, x double")
    assert ids(filter_rows(df, [{"column": "x", "operator": "gt", "value": 6}])) == [3]
    assert ids(filter_rows(df, [{"column": "x", "value": "5.00"}])) == [0]
    assert ids(filter_rows(df, [{"column": "x", "operator": "neq", "value": 5}])) == [1, 2, 3]


def test_filters_reach_the_scan(spark):
    items = with_order(spark.read.parquet(f"{TESTDATA}/lineitem.parquet"))
    filters = [
        {"column": "l_quantity", "operator": "gt", "value": 40},
        {"column": "l_returnflag", "operator": "eq", "value": "R"},
    ]
    page = query_rows(items.drop(RID).withColumnRenamed("l_orderkey", RID), filters, columns=["l_tax"])
    plan = page.rows._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_quantity,40.0)" in plan and "EqualTo(l_returnfl" in plan
    assert "TakeOrderedAndProject" in plan and "l_comment" not in plan and "l_shipdate" not in plan


def test_errors_name_the_columns(shop):
    for call in (
        lambda: filter_rows(shop, [{"column": "town"}]),
        lambda: query_rows(shop, columns=["town"]),
        lambda: query_rows(shop, sort={"column": "town"}),
        lambda: agg.aggregate(shop, ["town"]),
        lambda: agg.aggregate(shop, ["city"], [{"fn": "sum", "column": "town"}]),
    ):
        with pytest.raises(ValueError, match='"town" does not exist. Available columns: id, day, city'):
            call()
    with pytest.raises(ValueError, match="Unknown operator"):
        filter_rows(shop, [{"column": "city", "operator": "like"}])
    with pytest.raises(ValueError, match="is no metric"):
        agg.aggregate(shop, ["city"], [{"fn": "median", "column": "amount"}])
    assert len(OPERATORS) == 11


def test_sort_and_page(shop):
    def amounts(direction, **more):
        sort = {"column": "amount", "direction": direction}
        return [r[0] for r in query_rows(shop, sort=sort, columns=["amount"], **more).rows.collect()]

    up = [None, "(300)", "45%", " 80 ", "99", "$1,200", "$1,200", "N/A"]
    assert amounts("asc") == up
    assert amounts("desc") == up[::-1]
    assert amounts("asc", offset=2, limit=3) == up[2:5]
    cities = query_rows(shop, sort={"column": "city"}, columns=["city"]).rows
    assert [r[0] for r in cities.collect()] == [None, "Lyon", "Lyon", "LYON", "lyon ", "nice", "Nice", "Nice"]
    page = query_rows(shop, [{"column": "flag", "value": "yes"}], limit=2)
    assert page.rows.count() == 2 and page.matched.first()[0] == 5


def test_pages_are_capped(spark):
    df = with_order(spark.range(500).withColumnRenamed("id", "n"), "n").selectExpr(RID, f"{RID} as x")
    assert query_rows(df, limit=1000).rows.count() == 500


def test_aggregate(shop):
    metrics = [
        {"fn": "count", "as": "n"},
        {"fn": "sum", "column": "amount"},
        {"fn": "avg", "column": "amount"},
        {"fn": "min", "column": "day"},
        {"fn": "max", "column": "amount"},
        {"fn": "distinct", "column": "id"},
    ]
    out = agg.aggregate(shop, ["city"], metrics)
    assert out.columns == ["city", "n", "sum_amount", "avg_amount", "min_day", "max_amount", "distinct_id"]
    assert values(out, *out.columns) == [
        ("Lyon", 2, 2400.0, 1200.0, None, 1200.0, 1),
        ("lyon ", 1, -300.0, -300.0, None, -300.0, 1),
        ("LYON", 1, None, None, None, None, 1),
        ("Nice", 2, 99.45, 49.725, None, 99.0, 2),
        ("(blank)", 1, 80.0, 80.0, None, 80.0, 1),
        ("nice", 1, None, None, None, None, 1),
    ]
    top = agg.aggregate(shop, ["city"], metrics, {"column": "sum_amount", "direction": "desc"}, limit=2)
    assert [r[0] for r in top.collect()] == ["Lyon", "Nice"]
    assert agg.group_total(shop, ["city", "flag"]).first()[0] == 7
    assert values(agg.aggregate(shop), "count") == [(8,)]
    assert agg.aggregate(shop.limit(0)).count() == 0


def test_sums_beyond_decimals(spark):
    df = spark.createDataFrame([(0, "1e30"), (1, "2e30"), (2, "0.1")], f"{RID} bigint, x string")
    assert agg.aggregate(df, [], [{"fn": "sum", "column": "x"}]).first()[0] == pytest.approx(3e30)


def test_chart(shop):
    series = agg.chart_series(shop, "city", {"fn": "sum", "column": "amount"})
    assert values(series, "city") == [("Lyon",), ("Nice",), ("(blank)",), ("lyon ",)]
    by_name = agg.chart_series(shop, "city", {"fn": "count"}, "category_asc", 3)
    assert values(by_name, "city") == [("(blank)",), ("Lyon",), ("LYON",)]
    assert agg.chart_title("city", {"fn": "sum", "column": "amount"}) == "sum of amount by city"
