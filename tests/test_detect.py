"""Inference, profiles, quantiles and issues."""

import json
import math
import random

import pytest

from tablewash.operators import issues as iss
from tablewash.operators import profile as prof
from tablewash.operators.frequency import Frequencies
from tablewash.operators.quantile import exact_quantiles
from tablewash.operators.table import RID
from tablewash.plans.dataset import Dataset


def plan_text(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_profile(shop):
    rows = {r["column"]: r for r in prof.profile_columns(Frequencies(shop)).collect()}
    assert [r["inferred_type"] for r in rows.values()] == ["string", "date", "string", "number", "boolean"]
    amount = rows["amount"]
    assert (amount["total_rows"], amount["missing_count"], amount["missing_pct"], amount["distinct_count"]) == (8, 2, 25.0, 5)
    stats = amount["number_stats"].asDict()
    numbers = sorted([1200, -300, 1200, 0.45, 80, 99])
    assert stats["median"] == numbers[2] and stats["p25"] == numbers[1] and stats["p75"] == numbers[3]
    assert (stats["sum"], stats["mean"], stats["unparseable_count"]) == (2279.45, 379.9083, 0)
    day = rows["day"]["date_stats"].asDict()
    assert (day["min"], day["max"], day["unparseable_count"]) == ("2026-01-05", "2026-12-06", 1)
    assert sorted(day["formats_present"].values()) == [1, 2, 4]
    assert [tuple(v) for v in rows["id"]["top_values"]][:2] == [("A1", 2), ("A2", 1)]
    assert rows["city"]["sample_values"] == ["Lyon", "lyon ", "LYON", "Nice", "nice"]


def test_kinds_given_agree_with_kinds_found(shop):
    kinds = {r["column"]: r["inferred_type"] for r in prof.infer_types(Frequencies(shop)).collect()}
    given, found = Frequencies(shop, kinds=kinds), Frequencies(shop)
    assert sorted(given.numbers.collect()) == sorted(found.numbers.collect())


def test_empty_table(shop):
    nothing = Frequencies(shop.limit(0))
    rows = prof.common_profile(nothing).collect()
    assert {r["inferred_type"] for r in rows} == {"empty"} and {r["missing_pct"] for r in rows} == {0.0}
    assert iss.detect_issues(nothing).count() == 0


def test_boolean_words_beyond_three_spellings(spark):
    rows = [(i, ["Yes", "yes", "YES", "no", "NO"][i % 5], str(i % 2), ["y", "n", "true", "0"][i % 4]) for i in range(20)]
    df = spark.createDataFrame(rows, f"{RID} bigint, two_words string, digits string, four_words string")
    kinds = {r["column"]: r["inferred_type"] for r in prof.infer_types(Frequencies(df)).collect()}
    assert kinds == {"two_words": "boolean", "digits": "number", "four_words": "string"}


@pytest.mark.parametrize("kind", ["spread", "equal", "tight", "signed", "one"])
def test_quantiles_are_exact(spark, kind):
    rng = random.Random(3)
    data = {
        "spread": [rng.lognormvariate(3, 4) for _ in range(3000)],
        "equal": [7.0] * 900 + [8.0] * 100,
        "tight": [1.7e15 + rng.randint(0, 10**6) for _ in range(3000)],
        "signed": [rng.choice([-1, 1]) * rng.random() * 10 ** rng.randint(-8, 8) for _ in range(3000)],
        "one": [5.5],
    }[kind]
    df = spark.createDataFrame([("c", x, 1) for x in data], "column string, num double, cnt bigint").repartition(5)
    probs = [0.0, 0.25, 0.5, 0.75, 1.0]
    got = {r["p"]: r["value"] for r in exact_quantiles(df, probs).collect()}
    assert got == {p: sorted(data)[math.floor(p * (len(data) - 1))] for p in probs}


def test_issues_and_their_fixes(shop):
    rows = iss.detect_issues(Frequencies(shop)).collect()
    found = {(r["kind"], r["column"]): r for r in rows}
    assert [r["id"] for r in rows] == [f"issue_{i + 1}" for i in range(len(rows))]
    assert {k: r["count"] for k, r in found.items()} == {
        ("duplicate_rows", None): 1,
        ("mixed_date_formats", "day"): 8,
        ("unparseable_dates", "day"): 1,
        ("missing_values", "city"): 1,
        ("whitespace", "city"): 1,
        ("inconsistent_categories", "city"): 5,
        ("missing_values", "amount"): 2,
        ("whitespace", "amount"): 1,
        ("formatted_numbers", "amount"): 4,
    }
    fix = found["inconsistent_categories", "city"]["suggested_fix"]
    assert fix["op"] == "map_values"
    assert json.loads(fix["params"])["mapping"] == {"lyon ": "Lyon", "LYON": "Lyon", "nice": "Nice"}
    assert '"Lyon", "lyon ", "LYON"' in found["inconsistent_categories", "city"]["detail"]
    only = iss.detect_issues(Frequencies(shop), "high", "amount").collect()
    assert [(r["kind"], r["id"]) for r in only] == [("formatted_numbers", found["formatted_numbers", "amount"]["id"])]


def test_outliers_on_both_sides(spark):
    rows = [(i, str(100 + i % 10)) for i in range(40)] + [(40, "-9000"), (41, "-9000"), (42, "5000"), (43, "1e6")]
    df = spark.createDataFrame(rows, f"{RID} bigint, x string")
    (issue,) = iss.outliers(Frequencies(df)).collect()
    assert issue["count"] == 4 and "the lowest: -9000, -9000, 5000, 1000000" in issue["detail"]
    assert json.loads(issue["params"]) == {"column": "x", "operator": "gt", "value": 122.0}


def test_large_mappings_travel_by_name(spark, monkeypatch):
    monkeypatch.setattr(iss, "INLINE_MAPPING", 3)
    rows = [(i, f"{'Label' if i % 2 else 'label'} {i // 2}") for i in range(12)]
    df = spark.createDataFrame(rows, f"{RID} bigint, x string")
    (issue,) = iss.inconsistent_categories(Frequencies(df)).collect()
    assert issue["count"] == 12 and json.loads(issue["params"])["mapping"] == iss.VARIANTS_MAPPING
    data = Dataset.load(df)
    data.propose("map_values", issue["params"])
    data.approve("prop_001")
    assert data.table.select("x").distinct().count() == 6


def test_fixes_remove_their_issues(shop):
    data = Dataset.load(shop)
    kinds = ["duplicate_rows", "inconsistent_categories", "formatted_numbers", "mixed_date_formats"]
    data.apply_fixes(kinds)
    left = {r["kind"] for r in data.issues().select("kind").collect()}
    assert not left & set(kinds)


def test_order_of_partitions_does_not_matter(shop):
    def facts(df):
        freq = Frequencies(df)
        return (
            sorted(map(tuple, prof.top_values(freq).collect())),
            sorted(map(tuple, prof.sample_values(freq).collect())),
            sorted(map(tuple, iss.category_mapping(freq.of_type("string")).collect())),
        )

    assert facts(shop.coalesce(1)) == facts(shop.repartition(7, "amount"))


def test_one_shared_shuffle_and_limited_groups(shop):
    found = iss.outlier_bounds(Frequencies(shop))
    found.collect()
    final = plan_text(found).split("Initial Plan")[0]
    grouped = [line for line in final.splitlines() if "Exchange hashpartitioning(column" in line and ", value" in line]
    assert sum("ReusedExchange" not in line for line in grouped) == 1
    assert "WindowGroupLimit" in plan_text(prof.top_values(Frequencies(shop)))


def test_no_python_in_plans(shop):
    for df in (iss.detect_issues(Frequencies(shop)), prof.profile_columns(Frequencies(shop))):
        assert "Python" not in plan_text(df) and "CartesianProduct" not in plan_text(df)
