"""Pages by cursor and conditions against long lists, compared with offsets and literals."""

import pytest
from conftest import TESTDATA

from tablewash.operators import membership
from tablewash.operators.keyed_pages import page_after
from tablewash.operators.membership import rows_in
from tablewash.operators.query import filter_rows, query_rows
from tablewash.operators.table import RID, with_order
from tablewash.operators.transforms import plan_step
from tablewash.plans.recipe import replay


def walk(df, limit, **how):
    found, cursor = [], None
    while True:
        page = page_after(df, cursor, limit=limit, **how)
        found += [tuple(r) for r in page.rows.collect()]
        cursor = page.cursor()
        if cursor is None:
            return found


@pytest.fixture(scope="module")
def mixed(spark):
    texts = ["10", " 9", "$9", "b", "B", "á", "a", "", None, "n/a", "-3", "z", "Z", "9.0", None, "a"]
    rows = [(i * 7 % 32, t, None if i % 5 == 4 else float(i // 2 % 3)) for i, t in enumerate(texts * 2)]
    rows[3] = (rows[3][0], rows[3][1], float("nan"))
    return spark.createDataFrame(rows, f"{RID} bigint, `t.x` string, n double").repartition(3)


@pytest.mark.parametrize("sort", [None, *[{"column": c, "direction": d} for c in ("t.x", "n") for d in ("asc", "desc")]])
def test_pages_join_up_to_the_whole_order(mixed, sort):
    wanted = [tuple(r) for r in query_rows(mixed, sort=sort, limit=100).rows.collect()]
    for limit in (11, 32):
        assert repr(walk(mixed, limit, sort=sort)) == repr(wanted)


def test_pages_with_filters_and_projection(mixed):
    how = {"filters": [{"column": "n", "operator": "gte", "value": 1}], "sort": {"column": "t.x"}, "columns": ["n"]}
    assert walk(mixed, 3, **how) == [tuple(r) for r in query_rows(mixed, **how).rows.collect()]


def test_a_late_page_is_a_small_top_k_over_a_bounded_scan(spark):
    items = spark.read.parquet(f"{TESTDATA}/orders.parquet").select("o_orderkey", "o_totalprice")
    df = with_order(items, "o_orderkey")
    sort = {"column": "o_totalprice", "direction": "asc"}
    first = page_after(df, sort=sort, limit=20)
    plan = page_after(df, first.cursor(), sort=sort, limit=20).rows._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject(limit=20" in plan and "GreaterThanOrEqual(o_totalprice" in plan
    by_row = page_after(df, page_after(df, limit=20).cursor(), limit=20).rows._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(o_orderkey" in by_row


def test_a_cursor_of_another_order_raises(mixed):
    cursor = page_after(mixed, sort={"column": "n"}, limit=2).cursor()
    with pytest.raises(ValueError, match="another order"):
        page_after(mixed, cursor, sort={"column": "n", "direction": "desc"})
    assert page_after(mixed.limit(0), limit=2).cursor() is None


LISTS = [["10", 9, "a", "n/a"], ["", "b", "$9", 1.0], [2, 0.0], []]


@pytest.mark.parametrize("column", ["t.x", "n"])
@pytest.mark.parametrize("wanted", LISTS)
def test_long_lists_agree_with_literals(spark, mixed, monkeypatch, column, wanted):
    condition = {"column": column, "operator": "in", "value": wanted}
    literal = sorted(r[RID] for r in filter_rows(mixed, [condition]).collect())
    dropped = sorted(r[RID] for r in plan_step(mixed, "drop_rows_where", condition).result.collect())
    monkeypatch.setattr(membership, "LITERALS", -1)
    joined = filter_rows(mixed, [condition])
    assert joined.columns == mixed.columns
    assert sorted(r[RID] for r in joined.collect()) == literal
    step = plan_step(mixed, "drop_rows_where", condition)
    assert sorted(r[RID] for r in step.result.collect()) == dropped
    assert step.result.columns == mixed.columns
    # As a frame: every value by its text.
    texts = spark.createDataFrame([(None if v is None else str(v).lower() if v is True else str(v),) for v in wanted], "_wanted string")
    assert sorted(r[RID] for r in rows_in(mixed, column, texts).collect()) == literal


def test_a_hundred_thousand_values_reach_the_scan_as_a_range(spark):
    df = with_order(spark.read.parquet(f"{TESTDATA}/orders.parquet"), "o_orderkey")
    wanted = list(range(40, 100_040))
    found = filter_rows(df, [{"column": "o_custkey", "operator": "in", "value": wanted}])
    assert found.count() == df.where("o_custkey >= 40").count()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_custkey,40)" in plan and "LeftSemi" in plan


def test_a_recipe_keeps_long_lists(mixed):
    wanted = [str(i) for i in range(2000)]
    specs = [{"op": "keep_rows_where", "params": {"column": "t.x", "operator": "in", "value": wanted}}]
    # 10, " 9", $9 and 9.0, each twice.
    assert replay(mixed, specs).count() == 8


def test_long_lists_of_huge_numbers(spark, monkeypatch):
    df = spark.createDataFrame([(i, 2**53 + i) for i in range(4)], f"{RID} bigint, n bigint")
    condition = {"column": "n", "operator": "in", "value": [2**53, 10**30]}
    literal = sorted(r[RID] for r in filter_rows(df, [condition]).collect())
    monkeypatch.setattr(membership, "LITERALS", -1)
    assert sorted(r[RID] for r in filter_rows(df, [condition]).collect()) == literal == [0, 1]
