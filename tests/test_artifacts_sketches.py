"""Stored tables of recipes, and sketches per part with their stated errors."""

import json

import pytest
from conftest import TESTDATA
from pyspark.sql import functions as F

from tablewash.operators import aggregate as agg
from tablewash.operators import sketches as sk
from tablewash.operators.table import RID, with_order
from tablewash.plans.artifacts import ArtifactStore, is_reference
from tablewash.plans.recipe import Recipe, replay


def city(df):
    return [r["city"] for r in df.orderBy(RID).collect()]


def test_a_recipe_with_frames_replays_from_json(spark, shop, tmp_path):
    mapping = spark.createDataFrame([("lyon ", "Lyon"), ("LYON", "Lyon"), ("nice", None)], "variant string, canonical string")
    kept = spark.createDataFrame([("Lyon",), (None,)], "c string")
    recipe = Recipe(shop, str(tmp_path / "own"))
    recipe.apply("map_values", {"column": "city", "mapping": mapping})
    recipe.apply("keep_rows_where", {"column": "city", "operator": "in", "value": kept})
    text = recipe.to_json()
    assert all(is_reference(s["params"].get("mapping") or s["params"].get("value")) for s in json.loads(text))
    assert city(recipe.current) == ["Lyon", "Lyon", "Lyon", "Lyon", None, None]
    assert city(replay(shop, text)) == city(recipe.current)
    assert city(replay(shop, recipe.specs())) == city(recipe.current)
    # The new session knows nothing but the text.
    other = spark.newSession()
    assert city(replay(other.createDataFrame(shop.collect(), shop.schema), text)) == city(recipe.current)
    assert recipe.change_log().count() == 2 and recipe.list_proposals().count() == 2
    # The table's rows are not shuffled: the lookup is known to be small.
    first = replay(shop, json.loads(text)[:1])
    assert "BroadcastHashJoin" in first._jdf.queryExecution().executedPlan().toString()


def test_proposing_stores_nothing_and_the_collector_keeps_what_is_named(spark, shop, tmp_path):
    folder = tmp_path / "own"
    recipe = Recipe(shop, str(folder))
    one = spark.createDataFrame([("nice", "Nice")], "variant string, canonical string")
    p = recipe.propose("map_values", {"column": "city", "mapping": one})
    assert not folder.exists()
    recipe.approve(p.id)
    first = recipe.to_json()
    recipe.apply("map_values", {"column": "city", "mapping": one.union(one.limit(0)).repartition(3)})
    assert len(list(folder.iterdir())) == 1
    recipe.apply("map_values", {"column": "city", "mapping": spark.createDataFrame([("a", "b")], one.schema)})
    assert len(list(folder.iterdir())) == 2
    assert len(recipe.artifacts.collect([first])) == 1
    assert city(replay(shop, first))[6] == "Nice"
    assert recipe.artifacts.collect([]) and not list(folder.iterdir())


def test_half_written_tables_are_written_again(spark, tmp_path):
    store = ArtifactStore(spark, str(tmp_path))
    df = spark.range(10).select("id", F.when(F.col("id") > 4, "x").alias("a.b"))
    found = store.put(df)["$artifact"]
    assert found["rows"] == 10
    folder = tmp_path / found["digest"]
    for i, part in enumerate(sorted(folder.glob("*.parquet"))):
        if i:
            part.rename(tmp_path.parent / f"{tmp_path.name}-{part.name}")
    assert spark.read.parquet(str(folder)).count() < 10
    assert store.put(df.repartition(2))["$artifact"] == found
    assert spark.read.parquet(str(folder)).count() == 10
    assert store.put(df.limit(0))["$artifact"]["rows"] == 0
    assert store.put(df.union(df))["$artifact"]["digest"] != found["digest"]


@pytest.fixture(scope="module")
def orders(spark):
    return with_order(spark.read.parquet(f"{TESTDATA}/orders.parquet"), "o_orderkey")


def test_merged_sketches_equal_those_of_the_whole(spark, orders, tmp_path):
    columns, year = ["o_custkey", "o_orderpriority", "o_orderstatus"], F.year("o_orderdate")
    store = sk.SketchStore(spark, str(tmp_path / "s"))
    assert store.sketches() is None
    store.add(orders.where(year < 1995), year, columns)
    early = store.sketches().select("part").distinct().count()
    store.add(orders, year, columns)
    stored = store.sketches()
    # No part was sketched twice, and the early ones were not read again.
    assert stored.groupBy("part", "column").count().where("count > 1").count() == 0
    assert stored.select("part").distinct().count() == orders.select(year).distinct().count() > early
    exact = orders.agg(*[F.count_distinct(c).alias(c) for c in columns]).first()
    for r in sk.distinct_counts(stored).collect():
        assert r["rows"] == orders.count() and abs(r["distinct"] - exact[r["column"]]) <= 0.05 * exact[r["column"]]
    frequent = {(r["column"], r["value"]): r["count"] for r in sk.frequent_values(stored, 0.1).collect()}
    for c in columns[1:]:
        counts = orders.groupBy(c).count().where(F.col("count") >= 0.1 * orders.count()).collect()
        assert {k: v for k, v in frequent.items() if k[0] == c} == {(c, r[c]): r["count"] for r in counts}
    with pytest.raises(ValueError, match="share"):
        sk.frequent_values(stored, 0.0001)
    store.remove()
    assert store.sketches() is None


def test_blank_columns_and_empty_tables_have_empty_sketches(spark):
    df = spark.createDataFrame([(0, None), (1, "N/A")], f"{RID} bigint, `a.b` string")
    rows = sk.column_sketches(df, F.lit(None).cast("string"))
    assert [tuple(r) for r in sk.distinct_counts(rows).collect()] == [("a.b", 2, 0, 0)]
    assert sk.frequent_values(rows, 0.5).count() == 0
    assert sk.distinct_counts(sk.column_sketches(df.limit(0), F.lit("x"))).count() == 0


def test_approximate_distinct_as_a_metric(orders):
    near = {"fn": "distinct", "column": "o_custkey", "approximate": True, "as": "near"}
    exact = {"fn": "distinct", "column": "o_custkey", "as": "exact"}
    for extra in ([], [{"fn": "sum", "column": "o_totalprice"}]):
        for r in agg.aggregate(orders, ["o_orderpriority"], [near, exact, *extra]).collect():
            assert abs(r["near"] - r["exact"]) <= 0.05 * r["exact"]
