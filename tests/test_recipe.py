"""Transforms, diffs, recipes, files and streams."""

import json
import os

import pytest
from conftest import SHOP, values
from pyspark.sql import functions as F

from tablewash.operators.diff import diff_examples, diff_frames, diff_summary
from tablewash.operators.fill import with_value_above
from tablewash.operators.query import query_rows
from tablewash.operators.table import RID, data_columns
from tablewash.operators.transforms import OPS, apply_op, plan_step
from tablewash.plans.dataset import Dataset
from tablewash.plans.recipe import Recipe, replay
from tablewash.sources.delimited import (
    export_summary,
    header_names,
    read_delimited,
    sniff_delimiter,
    write_delimited,
)
from tablewash.streaming.rowwise import apply_rowwise


def column(df, name):
    return [r[0] for r in df.orderBy(RID).select(name).collect()]


CASES = [
    ("trim_whitespace", {"column": "city"}, "city", ["Lyon", "lyon", "LYON", "Lyon", "Nice", None, "nice", "Nice"]),
    ("normalize_case", {"column": "city", "mode": "title"}, "city",
     ["Lyon", "Lyon ", "Lyon", "Lyon", "Nice", None, "Nice", "Nice"]),
    ("parse_numbers", {"column": "amount"}, "amount", [1200.0, -300.0, None, 1200.0, 0.45, 80.0, None, 99.0]),
    ("parse_dates", {"column": "day", "day_first": True}, "day",
     ["2026-01-05", "2026-02-05", "2026-03-07", "2026-01-05", "2026-04-09", None, "2026-05-11", "2026-06-12"]),
    ("parse_dates", {"column": "day", "on_unparseable": "keep"}, "day",
     ["2026-01-05", "2026-05-02", "2026-03-07", "2026-01-05", "2026-04-09", "someday", "2026-05-11", "2026-12-06"]),
    ("fill_missing", {"column": "amount", "strategy": "constant", "value": 0}, "amount",
     ["$1,200", "(300)", "0", "$1,200", "45%", " 80 ", "0", "99"]),
    ("fill_missing", {"column": "amount", "strategy": "median"}, "amount",
     ["$1,200", "(300)", "80", "$1,200", "45%", " 80 ", "80", "99"]),
    ("fill_missing", {"column": "amount", "strategy": "mean"}, "amount",
     ["$1,200", "(300)", "379.9083", "$1,200", "45%", " 80 ", "379.9083", "99"]),
    ("fill_missing", {"column": "city", "strategy": "mode"}, "city",
     ["Lyon", "lyon ", "LYON", "Lyon", "Nice", "Lyon", "nice", "Nice"]),
    ("fill_missing", {"column": "amount", "strategy": "forward"}, "amount",
     ["$1,200", "(300)", "(300)", "$1,200", "45%", " 80 ", " 80 ", "99"]),
    ("map_values", {"column": "city", "mapping": {"lyon ": "Lyon", "nice": None}}, "city",
     ["Lyon", "Lyon", "LYON", "Lyon", "Nice", None, None, "Nice"]),
    ("split_column", {"column": "day", "delimiter": "-", "into": ["y", "rest"]}, "rest",
     ["01-05", None, None, "01-05", "04-09", None, "05-11", None]),
    ("derive_column", {"name": "d", "from": ["amount", "amount"], "operation": "divide"}, "d",
     [1.0, 1.0, None, 1.0, 1.0, 1.0, None, 1.0]),
    ("derive_column", {"name": "d", "from": ["id", "city"], "operation": "concat"}, "d",
     ["A1 Lyon", "A2 lyon ", "A3 LYON", "A1 Lyon", "A4 Nice", "A5", "A6 nice", "A7 Nice"]),
    ("coerce_type", {"column": "flag", "type": "boolean"}, "flag", [True, False, True, True, False, False, True, True]),
    ("drop_rows_where", {"column": "amount", "operator": "gt", "value": 90}, "id", ["A2", "A3", "A4", "A5", "A6"]),
    ("keep_rows_where", {"column": "amount", "operator": "gt", "value": 90}, "id", ["A1", "A1", "A7"]),
    ("deduplicate", {}, "id", ["A1", "A2", "A3", "A4", "A5", "A6", "A7"]),
    ("deduplicate", {"columns": ["flag"]}, "id", ["A1", "A2"]),
    ("sort_rows", {"column": "amount", "direction": "desc"}, "id", ["A3", "A1", "A1", "A7", "A5", "A4", "A2", "A6"]),
]


@pytest.mark.parametrize(("op", "params", "name", "expected"), CASES)
def test_transforms(shop, op, params, name, expected):
    assert column(apply_op(shop, op, params), name) == expected


@pytest.mark.parametrize(("op", "params"), [c[:2] for c in CASES if c[0] != "sort_rows"])
def test_diff_agrees_with_join(shop, op, params):
    """The one-scan summary equals comparing both versions by row id."""
    step = plan_step(shop, op, params)
    fast, slow = diff_summary(step).first().asDict(), diff_frames(shop, step.result).first().asDict()
    assert {k: fast[k] for k in slow} == slow


def test_columns_move_as_told(shop):
    assert data_columns(apply_op(shop, "rename_column", {"column": "city", "to": "town"}))[2] == "town"
    assert data_columns(apply_op(shop, "drop_column", {"columns": ["id", "flag"]})) == ["day", "city", "amount"]
    assert data_columns(apply_op(shop, "drop_column", {"column": "id"}))[0] == "day"
    assert len(OPS) == 15


def test_bad_input(shop):
    with pytest.raises(ValueError, match='"town" does not exist. Available columns: id'):
        plan_step(shop, "trim_whitespace", {"column": "town"})
    with pytest.raises(ValueError, match="Unknown operation"):
        plan_step(shop, "explode", {})
    with pytest.raises(ValueError, match="already exists"):
        plan_step(shop, "rename_column", {"column": "city", "to": "day"})
    with pytest.raises(ValueError, match='"mode" is required'):
        plan_step(shop, "normalize_case", {"column": "city"})
    with pytest.raises(ValueError, match="Unknown strategy"):
        plan_step(shop, "fill_missing", {"column": "city", "strategy": "guess"})


def test_dedup_tells_null_from_empty_in_the_result(spark):
    rows = [(0, "a", None), (1, "a", ""), (2, "b", ""), (3, "b", None), (4, None, None)]
    df = spark.createDataFrame(rows, f"{RID} bigint, x string, y string").repartition(3)
    assert sorted(apply_op(df, "deduplicate").collect()) == sorted([(0, "a", None), (2, "b", ""), (4, None, None)], key=str)


def test_maps_of_any_size_agree(shop):
    mapping = {"lyon ": "Lyon", "nice": None, "Lyon": True, "LYON": 5.0, "Nice": 7}
    expected = ["true", "Lyon", "5", "true", "7", None, None, "7"]
    for more in (0, 72, 1500):
        larger = {**mapping, **{f"k{i}": i for i in range(more)}}
        assert column(apply_op(shop, "map_values", {"column": "city", "mapping": larger}), "city") == expected


def test_a_mapping_table_may_repeat_itself(spark, shop):
    table = spark.createDataFrame([("nice", "N"), ("nice", "N"), ("nice", "Z")], "variant string, canonical string")
    out = apply_op(shop, "map_values", {"column": "city", "mapping": table})
    assert column(out, "city") == ["Lyon", "lyon ", "LYON", "Lyon", "Nice", None, "N", "Nice"]


def test_helper_names_leave_the_users_alone(spark):
    df = spark.createDataFrame([(0, "1", "a", "b"), (1, None, "c", "d")], f"{RID} bigint, _parsed string, _v string, _B string")
    assert column(apply_op(df, "parse_numbers", {"column": "_parsed"}), "_parsed") == [1.0, None]
    assert column(apply_op(df, "fill_missing", {"column": "_parsed", "strategy": "forward"}), "_parsed") == ["1", "1"]
    assert column(apply_op(df, "map_values", {"column": "_v", "mapping": {"a": "x"}}), "_v") == ["x", "c"]


def test_forward_fill_across_buckets(spark):
    """Sparse ids over many buckets and groups, against one plain pass."""
    ids = sorted({(i * i * 7919) % (1 << 44) for i in range(3000)})
    data = [(i, str(i) if n % 37 == 5 or n % 911 == 0 else None) for n, i in enumerate(ids[1:])]
    df = spark.createDataFrame(data, f"{RID} bigint, x string").repartition(6)
    expected, last = [], None
    for _, x in data:
        last = x or last
        expected.append(last)
    assert column(with_value_above(df, F.col("x"), "y"), "y") == expected


def test_examples(shop):
    rows = values(diff_examples(plan_step(shop, "trim_whitespace")), "row", "column", "before", "after")
    assert rows == [(1, "city", "lyon ", "lyon"), (5, "amount", " 80 ", "80")]
    lost = diff_summary(plan_step(shop, "parse_dates", {"column": "day"})).first()
    assert (lost["unparseable"], lost["rows_changed"]) == (1, 4)


def test_review_cycle(shop):
    recipe = Recipe(shop)
    staged = recipe.propose("deduplicate", {}, "copies count double")
    assert recipe.current is shop and staged.status == "pending"
    assert staged.diff().first()["rows_removed"] == 1
    assert recipe.approve(staged.id).status == "approved" and recipe.current.count() == 7
    with pytest.raises(ValueError, match="already approved"):
        recipe.reject(staged.id)
    with pytest.raises(ValueError, match="No proposal"):
        recipe.approve("prop_999")

    stale = recipe.propose("trim_whitespace", {"column": "flag"})
    recipe.apply("drop_column", {"column": "flag"})
    assert recipe.approve(stale.id).status == "failed" and "does not exist" in stale.error
    refused = recipe.propose("drop_column", {"column": "city"})
    recipe.reject(refused.id, "needed")
    assert "city" in recipe.current.columns

    listed = {r["id"]: r["status"] for r in recipe.list_proposals().collect()}
    assert list(listed.values()) == ["approved", "failed", "approved", "rejected"]
    assert [r["op"] for r in recipe.change_log().orderBy("position").collect()] == ["deduplicate", "drop_column"]
    assert [s["op"] for s in json.loads(recipe.to_json())] == ["deduplicate", "drop_column"]
    assert replay(shop, recipe.to_json()).columns == recipe.current.columns

    assert recipe.undo().op == "drop_column" and "flag" in recipe.current.columns
    recipe.reset()
    assert recipe.current is shop
    with pytest.raises(ValueError, match="No applied step"):
        recipe.undo()


def test_sorting_then_filling_uses_the_new_order(shop):
    recipe = Recipe(shop)
    recipe.apply("sort_rows", {"column": "id", "direction": "desc"})
    recipe.apply("fill_missing", {"column": "amount", "strategy": "forward"})
    assert column(recipe.current, "amount")[:2] == ["99", "99"]


def test_headers():
    assert header_names(["﻿id", " name ", "", "name", None, "name"]) == [
        "id", "name", "column_3", "name_2", "column_5", "name_3",
    ]


def test_files(spark, tmp_path):
    text = '﻿id;"na;me"; id ;\r\n1;"a ""b""";x;;extra\r\n;;;\r\n2;"two\r\nlines"\r\n3; pad ;;z\r\n'
    path = str(tmp_path / "in.csv")
    with open(path, "w", newline="", encoding="utf-8") as f:
        f.write(text)
    assert sniff_delimiter(spark, path) == ";"
    df = read_delimited(spark, path)
    assert data_columns(df) == ["id", "na;me", "id_2", "column_4"]
    assert values(df.orderBy(RID), *[f"`{c}`" for c in data_columns(df)]) == [
        ("1", 'a "b"', "x", None),
        # Spark reads the line ends of a file as one kind, also between quotes.
        ("2", "two\nlines", None, None),
        ("3", " pad ", None, "z"),
    ]
    with open(path, "w") as f:
        f.write("only\n\n1\n")
    assert sniff_delimiter(spark, path) == ","
    assert values(read_delimited(spark, path), "only") == [("1",)]
    with open(path, "w") as f:
        f.write(",,\na,b,c\n1,,3\n")
    assert values(read_delimited(spark, path), "a", "b", "c") == [("1", None, "3")]
    with open(path, "w") as f:
        f.write("\n")
    with pytest.raises(ValueError, match="header row"):
        read_delimited(spark, path)


def test_round_trip_keeps_order_over_many_files(spark, tmp_path):
    rows = [(i, str(i), f'q"{i}' if i % 3 else " p, ", None if i % 2 else "a\nb") for i in range(400)]
    df = spark.createDataFrame(rows, f"{RID} bigint, n string, x string, y string").repartition(9)
    path = str(tmp_path / "out")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        write_delimited(df, path)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    back = read_delimited(spark, path, ",")
    assert len(back.inputFiles()) > 1
    assert values(back.orderBy(RID), "n", "x", "y") == [r[1:] for r in rows]


def test_export_counts_bytes(spark, shop, tmp_path):
    data = Dataset("shop.csv", shop)
    summary = data.export(str(tmp_path)).first()
    lines = [",".join(f'"{c}"' if c and "," in c else c or "" for c in r) for r in SHOP]
    text = "\n".join(["id,day,city,amount,flag", *lines])
    assert summary.asDict() == {"filename": "shop_clean.csv", "bytes": len(text.encode()), "rows": 8, "columns": 5}
    parts = sorted(p for p in os.listdir(tmp_path / "shop_clean.csv") if p.startswith("part"))
    written = [open(tmp_path / "shop_clean.csv" / p).read().splitlines()[1:] for p in parts]
    assert sum(written, []) == lines
    assert export_summary(shop.limit(0), "x").first()["rows"] == 0


def test_dataset(spark, shop):
    with pytest.raises(ValueError, match="header row"):
        Dataset.load(shop.select(RID))
    data = Dataset.load(shop, "shop")
    data.propose("trim_whitespace")
    row = data.overview().first()
    assert (row["row_count"], row["column_count"], row["pending_proposals"], row["transforms_applied"]) == (8, 5, 1, 0)
    assert data.profile("city").first()["distinct_count"] == 5
    assert query_rows(data.table, limit=3).rows.count() == data.query(limit=3).rows.count()


def test_rowwise_steps_on_a_stream(spark, shop, tmp_path):
    source = str(tmp_path / "in")
    shop.drop(RID).write.parquet(source)
    stream = spark.readStream.schema(shop.drop(RID).schema).parquet(source)
    steps = [
        {"op": "trim_whitespace", "params": {}},
        {"op": "parse_numbers", "params": {"column": "amount"}},
        {"op": "drop_rows_where", "params": {"column": "amount", "operator": "is_blank"}},
        {"op": "map_values", "params": {"column": "city", "mapping": {"LYON": "Lyon", "lyon": "Lyon"}}},
    ]
    query = (
        apply_rowwise(stream, steps).writeStream.format("memory").queryName("cleaned").trigger(availableNow=True).start()
    )
    query.awaitTermination(120)
    batch = replay(shop, steps).drop(RID)
    assert sorted(spark.table("cleaned").collect()) == sorted(batch.collect())
    with pytest.raises(ValueError, match="whole table"):
        apply_rowwise(stream, [{"op": "deduplicate", "params": {}}])
