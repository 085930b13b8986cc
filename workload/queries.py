"""Registered queries: every operator over whole tables of a folder."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablewash.functions import coerce_date, coerce_number, date_shape, is_blank, norm_key, strip
from tablewash.operators import aggregate as agg
from tablewash.operators import issues as iss
from tablewash.operators import profile as prof
from tablewash.operators.diff import diff_examples, diff_frames, diff_summary
from tablewash.operators.frequency import Frequencies
from tablewash.operators.keyed_pages import page_after
from tablewash.operators.query import filter_rows, in_order, query_rows
from tablewash.operators.sketches import SketchStore, frequent_values
from tablewash.operators.table import RID, col, data_columns, with_order
from tablewash.operators.transforms import apply_op, plan_step
from tablewash.plans.autofix import suggested_fixes
from tablewash.plans.dataset import Dataset
from tablewash.plans.lineage import cut_lineage, ensure_checkpoint_dir
from tablewash.plans.recipe import Recipe, replay
from tablewash.sources.delimited import export_summary, read_delimited, sniff_delimiter, write_delimited
from tablewash.sources.messy_sales import messy_sales

Query = Callable[[SparkSession, str], DataFrame]

SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
SEGMENT_MAP = {s: s.capitalize() for s in SEGMENTS} | {s.lower(): s.capitalize() for s in SEGMENTS}


def sales(spark: SparkSession, folder: str) -> DataFrame:
    return with_order(messy_sales(spark, folder), "rid")


def table(spark: SparkSession, folder: str, name: str, order_by: str | None = None) -> DataFrame:
    return with_order(spark.read.parquet(f"{folder}/{name}.parquet"), order_by)


def shown(df: DataFrame, *columns: str) -> DataFrame:
    """The row id as ``rid`` next to some or all data columns."""
    return df.select(F.col(RID).alias("rid"), *(columns or data_columns(df)))


def ranked(ordered: DataFrame, *columns: str) -> DataFrame:
    """Every row of a sorted frame with its ``place``, from 1.

    The place within its task plus the rows of the tasks before: no window holds rows.
    """
    kept = cut_lineage(ordered.select(F.monotonically_increasing_id().alias("_at"), *[col(c) for c in columns]))
    task = F.shiftright("_at", 33)
    sizes = kept.groupBy(task.alias("_task")).agg(F.count(F.lit(1)).alias("n"))
    # One row per task.
    before = sizes.select("_task", (F.sum("n").over(Window.orderBy("_task")) - F.col("n")).alias("_before"))
    place = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return kept.join(F.broadcast(before), task == F.col("_task")).select(place.alias("place"), *columns)


def scratch(spark: SparkSession) -> str:
    """A new path in the folder all executors share."""
    return f"{ensure_checkpoint_dir(spark)}/csv-{uuid.uuid4().hex}"


# ---- cells


def _cells(**columns) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        df = sales(spark, folder)
        return df.select(F.col(RID).alias("rid"), *[f(F.col(c)).alias(n) for n, (c, f) in columns.items()])

    return query


def _day_first(c):
    return coerce_date(c, True)


CELLS: dict[str, Query] = {
    "c_is_blank": _cells(
        priority_blank=("priority", is_blank), amount_blank=("amount", is_blank), quantity_blank=("quantity", is_blank)
    ),
    "c_coerce_number": _cells(
        amount_number=("amount", coerce_number),
        quantity_number=("quantity", coerce_number),
        discount_number=("discount", coerce_number),
        date_number=("order_date", coerce_number),
    ),
    "c_coerce_date": _cells(order_day=("order_date", coerce_date), amount_day=("amount", coerce_date)),
    "c_coerce_date_dayfirst": _cells(order_day=("order_date", _day_first)),
    "c_date_shape": _cells(shape=("order_date", lambda c: date_shape(strip(c)))),
    "c_norm_key": _cells(segment_key=("segment", norm_key), priority_key=("priority", norm_key)),
}


# ---- files


def s_sniff(spark: SparkSession, folder: str) -> DataFrame:
    df = sales(spark, folder)
    found = []
    for name, delimiter in (("comma", ","), ("tab", "\t"), ("semicolon", ";"), ("pipe", "|")):
        path = scratch(spark)
        write_delimited(df, path, delimiter)
        found.append((name, sniff_delimiter(spark, path) == delimiter))
    return spark.createDataFrame(found, "written_with string, recognised boolean")


def s_read_delimited(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch(spark)
    write_delimited(sales(spark, folder), path, "|")
    back = read_delimited(spark, path)
    return back.drop(RID)


def s_export_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Texts with quotes, delimiters and line breaks through a file and back."""
    path = scratch(spark)
    turns = spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text")
    write_delimited(with_order(turns), path)
    back = read_delimited(spark, path, ",")
    return back.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), "role", "text"
    )


def s_export_summary(spark: SparkSession, folder: str) -> DataFrame:
    return export_summary(sales(spark, folder), "messy_sales_clean.csv")


FILES: dict[str, Query] = {f.__name__: f for f in (s_sniff, s_read_delimited, s_export_roundtrip, s_export_summary)}


# ---- inference and profiles


def _kept(f: Callable[[Frequencies], DataFrame]) -> Query:
    """From the summary store of the table."""
    return lambda spark, folder: f(Dataset.load(messy_sales(spark, folder), "messy_sales", "rid").frequencies()).drop("pos")


def _profile(f: Callable[[Frequencies], DataFrame]) -> Query:
    return lambda spark, folder: f(Frequencies(sales(spark, folder))).drop("pos")


def i_overview(spark: SparkSession, folder: str) -> DataFrame:
    data = Dataset.load(messy_sales(spark, folder), "messy_sales", "rid")
    return data.overview().drop("pos")


def p_profile(spark: SparkSession, folder: str) -> DataFrame:
    """The whole record of every column."""
    record = prof.profile_columns(Dataset.load(messy_sales(spark, folder), "messy_sales", "rid").frequencies())
    formats = F.array_sort(F.map_entries("date_stats.formats_present"))

    def listed(items, text) -> Column:
        return F.array_join(F.transform(items, text), "|")

    numbers = ("n", "min", "max", "mean", "median", "p25", "p75", "sum")
    return record.select(
        "column", "inferred_type", "total_rows", "missing_count", "missing_pct", "distinct_count",
        listed("sample_values", lambda x: x).alias("samples"),
        *[F.col(f"number_stats.{c}").alias(c) for c in numbers],
        F.col("date_stats.min").alias("first_date"), F.col("date_stats.max").alias("last_date"),
        F.coalesce("number_stats.unparseable_count", "date_stats.unparseable_count").alias("unparseable_count"),
        listed(formats, lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string"))).alias("formats"),
        listed("top_values", lambda x: F.concat(x["value"], F.lit("="), x["count"].cast("string"))).alias("top"),
    )


PROFILES: dict[str, Query] = {
    "i_infer_types": _profile(prof.infer_types),
    "i_overview": i_overview,
    "p_common": _profile(prof.common_profile),
    "p_samples": _profile(prof.sample_values),
    "p_number": _kept(prof.number_profile),
    "p_date": _profile(prof.date_profile),
    "p_date_formats": _profile(prof.date_formats),
    "p_top_values": _profile(prof.top_values),
    "p_profile": p_profile,
}


# ---- issues


def _issue_columns(df: DataFrame) -> DataFrame:
    return df.select("kind", "severity", "column", "count", "detail", "op")


def _from_counts(kind: str) -> Query:
    return lambda spark, folder: _issue_columns(
        iss.issues_from_counts(Frequencies(sales(spark, folder)), [kind])
    )


def d_duplicate_rows(spark: SparkSession, folder: str) -> DataFrame:
    return _issue_columns(iss.duplicate_rows(sales(spark, folder)))


def d_outliers(spark: SparkSession, folder: str) -> DataFrame:
    return _issue_columns(iss.outliers(Frequencies(sales(spark, folder))))


def d_categories(spark: SparkSession, folder: str) -> DataFrame:
    values = Frequencies(sales(spark, folder)).of_type("string")
    return iss.category_groups(values).drop("group_rid")


def d_category_mapping(spark: SparkSession, folder: str) -> DataFrame:
    return iss.category_mapping(Frequencies(sales(spark, folder)).of_type("string"))


def d_all(spark: SparkSession, folder: str) -> DataFrame:
    issues = Dataset.load(messy_sales(spark, folder), "messy_sales", "rid").issues()
    return issues.select("id", "kind", "severity", "column", "count", F.col("suggested_fix.op").alias("op"))


def _filtered(severity: str = "all", column: str | None = None) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        issues = Dataset.load(messy_sales(spark, folder), "messy_sales", "rid").issues(severity, column)
        return issues.select("id", "kind", "severity", "column", "count", F.col("suggested_fix.op").alias("op"))

    return query


def d_by_severity(spark: SparkSession, folder: str) -> DataFrame:
    return iss.count_by_severity(Dataset.load(messy_sales(spark, folder), "messy_sales", "rid").issues())


def _found(spark: SparkSession, folder: str) -> DataFrame:
    return Dataset.load(messy_sales(spark, folder), "messy_sales", "rid").issues()


def d_details(spark: SparkSession, folder: str) -> DataFrame:
    """All issues with their sentences; the spellings of a label are compared by d_fix_mapping."""
    spelt = F.col("kind") == "inconsistent_categories"
    detail = F.when(spelt, F.regexp_extract("detail", "^[0-9]+ labels are spelt in several ways", 0)).otherwise(F.col("detail"))
    return _found(spark, folder).select("id", "kind", "column", "count", detail.alias("detail"))


def d_fixes(spark: SparkSession, folder: str) -> DataFrame:
    """All suggested fixes with their parameters but the mappings."""
    params = [F.get_json_object("suggested_fix.params", f"$.{p}").alias(f"fix_{p}") for p in ("column", "strategy", "operator")]
    return _found(spark, folder).select("id", F.col("suggested_fix.op").alias("op"), *params)


def d_fix_mapping(spark: SparkSession, folder: str) -> DataFrame:
    """What the suggested mappings replace, whether written out or named."""
    issues = _found(spark, folder).where("kind = 'inconsistent_categories'")
    fixes = {r["column"]: r["params"] for r in issues.select("column", "suggested_fix.params").collect()}  # one a column at most
    parts = []
    for column, params in fixes.items():
        fix = json.loads(params)
        if isinstance(fix["mapping"], dict):
            rows = spark.createDataFrame(list(fix["mapping"].items()), "variant string, canonical string")
        else:
            rows = iss.stored_mapping(spark.read.parquet(fix["table"]), column)
        parts.append(rows.select(F.lit(column).alias("column"), "variant", "canonical"))
    none = spark.createDataFrame([], "column string, variant string, canonical string")
    return reduce(DataFrame.unionByName, parts, none)


ISSUES: dict[str, Query] = {
    "d_duplicate_rows": d_duplicate_rows,
    "d_missing": _from_counts("missing_values"),
    "d_whitespace": _from_counts("whitespace"),
    "d_formatted_numbers": _from_counts("formatted_numbers"),
    "d_outliers": d_outliers,
    "d_mixed_dates": _from_counts("mixed_date_formats"),
    "d_unparseable_dates": _from_counts("unparseable_dates"),
    "d_categories": d_categories,
    "d_category_mapping": d_category_mapping,
    "d_all": d_all,
    "d_details": d_details,
    "d_fixes": d_fixes,
    "d_fix_mapping": d_fix_mapping,
    "d_severity": _filtered(severity="high"),
    "d_column": _filtered(column="amount"),
    "d_by_severity": d_by_severity,
}


# ---- queries


def _where(*filters: dict, columns: tuple[str, ...] = ()) -> Query:
    return lambda spark, folder: shown(filter_rows(sales(spark, folder), list(filters)), *columns)


def _is(column: str, operator: str, value=None) -> dict:
    return {"column": column, "operator": operator, "value": value}


def _page(**arguments) -> Query:
    return lambda spark, folder: query_rows(sales(spark, folder), **arguments).rows


def q_contains(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages", "page_id")
    return filter_rows(pages, [_is("url", "contains", "BLOG.")]).select(F.col(RID).alias("page_id"), "url")


def q_starts_with(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages", "page_id")
    return filter_rows(pages, [_is("url", "starts_with", "HTTPS://")]).select(F.col(RID).alias("page_id"), "url")


def _sorted(column: str, direction: str) -> Query:
    return lambda spark, folder: ranked(
        in_order(sales(spark, folder), {"column": column, "direction": direction}), "order_id", column
    )


def q_matched(spark: SparkSession, folder: str) -> DataFrame:
    return query_rows(sales(spark, folder), filters=[_is("segment", "contains", "auto")]).matched


def q_page_after(spark: SparkSession, folder: str) -> DataFrame:
    """The third page of 50, each one found by the cursor of the page before."""
    df, cursor = sales(spark, folder), None
    how = {"sort": {"column": "quantity", "direction": "desc"}, "columns": ["order_id", "quantity"]}
    for _ in range(2):
        cursor = page_after(df, cursor, **how).cursor()
    return page_after(df, cursor, **how).rows


def q_in_long(spark: SparkSession, folder: str) -> DataFrame:
    """Orders of a list of 100,000 customers."""
    orders = table(spark, folder, "orders", "o_orderkey")
    wanted = list(range(2, 300_002, 3))
    return filter_rows(orders, [_is("o_custkey", "in", wanted)]).select(F.col(RID).alias("o_orderkey"), "o_custkey")


def q_in_table(spark: SparkSession, folder: str) -> DataFrame:
    """Orders of the customers in debt, who come as a table."""
    orders = table(spark, folder, "orders", "o_orderkey")
    debtors = spark.read.parquet(f"{folder}/customer.parquet").where("c_acctbal < 0").select("c_custkey")
    found = filter_rows(orders, [_is("o_custkey", "in", debtors)])
    return found.select(F.col(RID).alias("o_orderkey"), "o_custkey", "o_orderstatus")


QUERIES: dict[str, Query] = {
    "q_filter_and": _where(_is("segment", "contains", "mach"), _is("amount", "gt", 100000), _is("priority", "not_blank")),
    "q_eq": _where(_is("amount", "eq", "112,946")),
    "q_neq": _where(_is("priority", "neq", "1-URGENT"), columns=("priority",)),
    "q_gt": _where(_is("amount", "gt", 400000), columns=("amount",)),
    "q_gte": _where(_is("order_date", "gte", "2000-01-01"), columns=("order_date",)),
    "q_lt": _where(_is("amount", "lt", "-450,000"), columns=("amount",)),
    "q_lte": _where(_is("discount", "lte", "2%"), columns=("discount",)),
    "q_contains": q_contains,
    "q_starts_with": q_starts_with,
    "q_in": _where(_is("quantity", "in", ["7", 9, "N/A"]), columns=("quantity",)),
    "q_is_blank": _where(_is("priority", "is_blank"), columns=("priority",)),
    "q_not_blank": _where(_is("amount", "not_blank"), columns=("amount",)),
    "q_sort_num": _page(sort={"column": "amount", "direction": "asc"}, columns=["order_id", "amount"], limit=60),
    "q_sort_text": _page(
        sort={"column": "priority", "direction": "desc"}, columns=["order_id", "priority"], limit=200, offset=100
    ),
    "q_sort_num_all": _sorted("amount", "asc"),
    "q_sort_text_all": _sorted("priority", "desc"),
    "q_project": lambda spark, folder: sales(spark, folder).select("priority", "order_id"),
    "q_page": _page(sort={"column": "quantity", "direction": "desc"}, columns=["order_id", "quantity"], offset=30),
    "q_matched": q_matched,
    "q_page_after": q_page_after,
    "q_in_long": q_in_long,
    "q_in_table": q_in_table,
}


# ---- aggregates


def _groups(name: str, group_by: list[str], *metrics: dict) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        df = sales(spark, folder) if name == "messy_sales" else table(spark, folder, name)
        return agg.aggregate_groups(df, group_by, list(metrics)).drop(agg.FIRST)

    return query


def a_sort_limit(spark: SparkSession, folder: str) -> DataFrame:
    metrics = [{"fn": "count", "as": "n"}, {"fn": "sum", "column": "amount"}]
    return agg.aggregate(
        sales(spark, folder), ["order_date"], metrics, {"column": "sum_amount", "direction": "desc"}, limit=25
    )


def a_first_seen(spark: SparkSession, folder: str) -> DataFrame:
    """Groups that nobody sorted come in the order of their first rows."""
    return agg.aggregate(sales(spark, folder), ["order_date"], [{"fn": "count", "as": "n"}], limit=25)


def a_first_seen_all(spark: SparkSession, folder: str) -> DataFrame:
    groups = agg.aggregate(sales(spark, folder), ["order_date"], [{"fn": "count", "as": "n"}])
    return ranked(groups, "order_date", "n")


def a_group_total(spark: SparkSession, folder: str) -> DataFrame:
    return agg.group_total(sales(spark, folder), ["segment", "priority"])


def _chart(sort: str, limit: int) -> Query:
    return lambda spark, folder: agg.chart_series(
        sales(spark, folder), "order_date", {"fn": "sum", "column": "amount"}, sort, limit
    )


def a_distinct_approx(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct orders by segment: the exact count, and whether the sketch's is within 5 %."""
    exact = {"fn": "distinct", "column": "order_id", "as": "orders"}
    groups = agg.aggregate(sales(spark, folder), ["segment"], [exact, {**exact, "approximate": True, "as": "near"}])
    within = F.abs(F.col("near") - F.col("orders")) <= F.col("orders") * 0.05
    return groups.select("segment", "orders", within.alias("within_bound"))


def p_sketches(spark: SparkSession, folder: str) -> DataFrame:
    """Frequent values of orders from sketches that were stored by year and merged."""
    orders, year = table(spark, folder, "orders", "o_orderkey"), F.year("o_orderdate")
    store = SketchStore(spark, scratch(spark))
    columns = ["o_orderpriority", "o_orderstatus"]
    # Two loads: the second one adds the years that are new.
    store.add(orders.where(year < 1995), year, columns)
    store.add(orders, year, columns)
    return frequent_values(store.sketches(), 0.05)


AGGREGATES: dict[str, Query] = {
    "a_group1": _groups("messy_sales", ["segment"], {"fn": "count", "as": "n"}),
    "a_group2": _groups("messy_sales", ["segment", "priority"], {"fn": "count", "as": "n"}),
    "a_global": _groups("messy_sales", [], {"fn": "count"}, {"fn": "sum", "column": "amount"}),
    "a_count": _groups("messy_sales", ["priority"], {"fn": "count", "column": "amount"}),
    "a_distinct_approx": a_distinct_approx,
    "p_sketches": p_sketches,
    "a_distinct": _groups(
        "messy_sales", ["segment"], {"fn": "distinct", "column": "order_id"}, {"fn": "distinct", "column": "priority"}
    ),
    "a_sum": _groups(
        "lineitem",
        ["l_returnflag", "l_linestatus"],
        {"fn": "sum", "column": "l_extendedprice"},
        {"fn": "sum", "column": "l_quantity", "as": "total_quantity"},
    ),
    "a_avg": _groups(
        "messy_sales", ["priority_flag", "segment"], {"fn": "avg", "column": "amount"}, {"fn": "avg", "column": "discount"}
    ),
    "a_min": _groups(
        "messy_sales", ["segment"], {"fn": "min", "column": "amount"}, {"fn": "min", "column": "order_date"}
    ),
    "a_max": _groups(
        "messy_sales", ["segment"], {"fn": "max", "column": "amount"}, {"fn": "max", "column": "priority"}
    ),
    "a_default": _groups("messy_sales", ["priority_flag"]),
    "a_sort_limit": a_sort_limit,
    "a_group_total": a_group_total,
    "a_chart_value_desc": _chart("value_desc", 12),
    "a_chart_category": _chart("category_asc", 40),
    "a_chart_value_asc": _chart("value_asc", 300),
    "a_first_seen": a_first_seen,
    "a_first_seen_all": a_first_seen_all,
}


# ---- transforms


def _op(op: str, *columns: str, **params) -> Query:
    return lambda spark, folder: shown(apply_op(sales(spark, folder), op, params), *columns)


def t_map_table(spark: SparkSession, folder: str) -> DataFrame:
    df = sales(spark, folder)
    mapping = iss.category_mapping(Frequencies(df, ["segment"]).present)
    return shown(apply_op(df, "map_values", {"column": "segment", "mapping": mapping}), "segment")


def t_split(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part", "p_partkey").select(RID, "p_name")
    split = apply_op(part, "split_column", {"column": "p_name", "delimiter": " ", "into": ["colour", "thing", "rest"]})
    return split.select(F.col(RID).alias("p_partkey"), "p_name", "colour", "thing", "rest")


def _derive(operation: str, sources: list[str], **params) -> Query:
    return _op("derive_column", "derived", name="derived", operation=operation, **{"from": sources}, **params)


def t_sort_rows(spark: SparkSession, folder: str) -> DataFrame:
    """First page by the row order that sorting left."""
    ordered = apply_op(sales(spark, folder), "sort_rows", {"column": "quantity", "direction": "desc"})
    return query_rows(ordered, columns=["order_id", "quantity"], limit=200).rows


def t_sort_rows_all(spark: SparkSession, folder: str) -> DataFrame:
    """Every row, by the row order that sorting left."""
    ordered = cut_lineage(apply_op(sales(spark, folder), "sort_rows", {"column": "quantity", "direction": "desc"}))
    return ranked(in_order(ordered, None), "order_id", "quantity")


TRANSFORMS: dict[str, Query] = {
    "t_trim": _op("trim_whitespace", "segment", "priority", column="segment"),
    "t_trim_all": _op("trim_whitespace"),
    "t_case_lower": _op("normalize_case", "segment", column="segment", mode="lower"),
    "t_case_upper": _op("normalize_case", "segment", column="segment", mode="upper"),
    "t_case_title": _op("normalize_case", "priority", column="priority", mode="title"),
    "t_parse_numbers": _op("parse_numbers", "amount", column="amount"),
    "t_parse_dates": _op("parse_dates", "order_date", column="order_date"),
    "t_parse_dates_dayfirst": _op("parse_dates", "order_date", column="order_date", day_first=True),
    "t_fill_constant": _op("fill_missing", "priority", column="priority", strategy="constant", value="Unknown"),
    "t_fill_mean": _op("fill_missing", "quantity", column="quantity", strategy="mean"),
    "t_fill_median": _op("fill_missing", "amount", column="amount", strategy="median"),
    "t_fill_mode": _op("fill_missing", "priority", column="priority", strategy="mode"),
    "t_fill_forward": _op("fill_missing", "priority", "quantity", column="priority", strategy="forward"),
    "t_map_values": _op("map_values", "segment", column="segment", mapping=SEGMENT_MAP),
    "t_map_table": t_map_table,
    "t_rename": _op("rename_column", column="segment", to="market"),
    "t_drop": _op("drop_column", columns=["amount", "discount"]),
    "t_drop_rows": _op("drop_rows_where", column="amount", operator="gt", value=1000000),
    "t_keep_rows": _op("keep_rows_where", column="amount", operator="gt", value=1000000),
    "t_dedup_all": _op("deduplicate"),
    "t_dedup_keys": _op("deduplicate", columns=["segment", "priority"]),
    "t_split": t_split,
    "t_derive_add": _derive("add", ["amount", "quantity"]),
    "t_derive_sub": _derive("subtract", ["amount", "quantity"]),
    "t_derive_mul": _derive("multiply", ["quantity", "discount"]),
    "t_derive_div": _derive("divide", ["quantity", "discount"]),
    "t_derive_concat": _derive("concat", ["segment", "priority", "quantity"], separator="/"),
    "t_coerce_number": _op("coerce_type", "discount", column="discount", type="number"),
    "t_coerce_string": lambda spark, folder: shown(
        apply_op(
            apply_op(sales(spark, folder), "parse_numbers", {"column": "discount"}),
            "coerce_type",
            {"column": "discount", "type": "string"},
        ),
        "discount",
    ),
    "t_coerce_date": _op("coerce_type", "order_date", column="order_date", type="date"),
    "t_coerce_boolean": _op("coerce_type", "priority_flag", column="priority_flag", type="boolean"),
    "t_sort_rows": t_sort_rows,
    "t_sort_rows_all": t_sort_rows_all,
}


# ---- recipes

CLEANING = [
    {"op": "deduplicate", "params": {}},
    {"op": "trim_whitespace", "params": {"column": "segment"}},
    {"op": "map_values", "params": {"column": "segment", "mapping": SEGMENT_MAP}},
    {"op": "parse_numbers", "params": {"column": "amount"}},
]
REVENUE = [{"fn": "count", "as": "orders"}, {"fn": "sum", "column": "amount", "as": "revenue"}]


def _recipe(spark: SparkSession, folder: str) -> Recipe:
    recipe = Recipe(sales(spark, folder))
    for spec in CLEANING:
        recipe.apply(spec["op"], spec["params"])
    return recipe


def revenue_by_segment(spark: SparkSession, folder: str) -> DataFrame:
    return agg.aggregate(
        replay(sales(spark, folder), CLEANING), ["segment"], REVENUE, {"column": "revenue", "direction": "desc"}
    )


def _summary(df: DataFrame) -> DataFrame:
    return df.select("rows_changed", "rows_removed", "cells_changed")


def r_diff_map(spark: SparkSession, folder: str) -> DataFrame:
    return _summary(diff_summary(plan_step(sales(spark, folder), **CLEANING[2])))


def r_diff_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return _summary(diff_summary(plan_step(sales(spark, folder), "deduplicate", {})))


def r_diff_join(spark: SparkSession, folder: str) -> DataFrame:
    before = sales(spark, folder)
    return _summary(diff_frames(before, replay(before, CLEANING)))


def r_diff_examples(spark: SparkSession, folder: str) -> DataFrame:
    return diff_examples(plan_step(sales(spark, folder), "trim_whitespace", {}))


def r_propose(spark: SparkSession, folder: str) -> DataFrame:
    """A staged change: its diff is known and the table is as it was."""
    recipe = Recipe(sales(spark, folder))
    proposal = recipe.propose("parse_numbers", {"column": "amount"}, "currency text will not sum")
    return recipe.list_proposals("pending", with_diff=True).select(
        "id", "op", "status", "summary", "diff.rows_changed", "diff.cells_changed", "diff.unparseable"
    ).where(F.col("id") == proposal.id)


def r_undo(spark: SparkSession, folder: str) -> DataFrame:
    recipe = _recipe(spark, folder)
    recipe.undo()
    return shown(recipe.current)


def r_reset(spark: SparkSession, folder: str) -> DataFrame:
    recipe = _recipe(spark, folder)
    recipe.reset()
    return shown(recipe.current)


def r_proposals(spark: SparkSession, folder: str) -> DataFrame:
    recipe = Recipe(sales(spark, folder))
    recipe.apply("deduplicate", {})
    recipe.reject(recipe.propose("drop_column", {"column": "discount"}).id, "still needed")
    recipe.propose("trim_whitespace", {}, "whitespace splits groups")
    return recipe.list_proposals(with_diff=True).select(
        "id", "op", "params", "status", "summary", "rationale", "human_note",
        "diff.rows_changed", "diff.rows_removed", "diff.cells_changed",
    )


def r_change_log(spark: SparkSession, folder: str) -> DataFrame:
    """The log next to the rows that each applied step left."""
    recipe = _recipe(spark, folder)
    sizes = []
    for position in range(len(CLEANING)):
        after = replay(sales(spark, folder), CLEANING[: position + 1])
        sizes.append(after.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(position).alias("position"), "row_count"))
    counts = reduce(DataFrame.unionByName, sizes)
    return recipe.change_log().join(F.broadcast(counts), "position").select("id", "proposal_id", "op", "summary", "row_count")


def r_autofix(spark: SparkSession, folder: str) -> DataFrame:
    """Detect, then apply the fixes of some kinds."""
    df = sales(spark, folder)
    kinds = ["duplicate_rows", "inconsistent_categories", "formatted_numbers"]
    fixes = suggested_fixes(iss.detect_issues(Frequencies(df)), kinds)
    return shown(replay(df, fixes), "segment", "amount", "discount")


def r_replay_frames(spark: SparkSession, folder: str) -> DataFrame:
    """A recipe that was given two frames, a mapping and a list, replayed from its JSON."""
    df = sales(spark, folder)
    names = spark.read.parquet(f"{folder}/customer.parquet").select("c_mktsegment").distinct()
    spelled = F.explode(F.array("c_mktsegment", F.lower("c_mktsegment"))).alias("variant")
    mapping = names.select(spelled, F.initcap("c_mktsegment").alias("canonical"))
    recipe = Recipe(df)
    recipe.apply("map_values", {"column": "segment", "mapping": mapping})
    recipe.apply("keep_rows_where", {"column": "segment", "operator": "in", "value": names.select(F.initcap("c_mktsegment"))})
    return shown(replay(df, recipe.to_json()), "segment")


RECIPES: dict[str, Query] = {
    "r_clean_revenue": revenue_by_segment,
    **{
        f.__name__: f
        for f in (
            r_replay_frames,
            r_diff_map,
            r_diff_dedup,
            r_diff_join,
            r_diff_examples,
            r_propose,
            r_undo,
            r_reset,
            r_proposals,
            r_change_log,
            r_autofix,
        )
    },
}

ALL: dict[str, Query] = {
    **CELLS, **FILES, **PROFILES, **ISSUES, **QUERIES, **AGGREGATES, **TRANSFORMS, **RECIPES,
}
