"""Group by, metrics, sorted pages of groups, and chart series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewash.functions.text import is_blank
from tablewash.operators.query import in_order
from tablewash.operators.sketches import approximate_distinct
from tablewash.operators.sums import PARTS, digit_sums, with_digits, with_totals
from tablewash.operators.table import RID, cell_number, cell_text, col, require_columns

FUNCTIONS = ("count", "sum", "avg", "min", "max", "distinct")
BLANK_GROUP = "(blank)"
CHART_SIZE = 12
CHART_SORTS = ("value_desc", "value_asc", "category_asc")
CHART_TYPES = ("bar", "line")
# Hidden: the first row of a group, which orders groups nobody sorted.
FIRST = "_first"


def metric_name(metric: dict) -> str:
    return metric.get("as") or f"{metric['fn']}_{metric.get('column') or 'rows'}"


def _checked(df: DataFrame, metric: dict) -> None:
    if metric["fn"] not in FUNCTIONS:
        raise ValueError(f'"{metric["fn"]}" is no metric; there are {", ".join(FUNCTIONS)}.')
    if metric["fn"] != "count":
        require_columns(df, [metric.get("column")])


def _distinct(df: DataFrame, metric: dict) -> Column:
    text = cell_text(df, metric["column"])
    known = F.when(~is_blank(text), text)
    # With ``approximate`` a sketch of fixed size per group instead of its values.
    return approximate_distinct(known) if metric.get("approximate") else F.count_distinct(known)


def _plain_groups(df: DataFrame, keys: list[Column], metrics: list[dict]) -> DataFrame:
    """Metrics that one aggregation holds: the values as ``_m0``, ``_m1``, ..."""

    def value(m: dict) -> Column:
        if m["fn"] == "count":
            return F.count(F.lit(1))
        if m["fn"] == "distinct":
            return _distinct(df, m)
        return {"min": F.min, "max": F.max}[m["fn"]](cell_number(df, m["column"]))

    return df.groupBy(*keys).agg(*[value(m).alias(f"_m{i}") for i, m in enumerate(metrics)], F.min(RID).alias(FIRST))


def _summed_groups(df: DataFrame, keys: list[Column], metrics: list[dict]) -> DataFrame:
    """Groups with exact sums: a row becomes a base entry and the digits of each number it holds.

    The entries are added by group, metric and bin, so a hot group shrinks
    before the shuffle to a few entries per metric.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    summed = [i for i, m in enumerate(metrics) if m["fn"] in ("sum", "avg")]
    extremes = [i for i, m in enumerate(metrics) if m["fn"] in ("min", "max")]
    numbers = {c: cell_number(df, c) for c in {metrics[i]["column"] for i in summed + extremes}}
    order = list(numbers)
    place = {c: f"_n{j}" for j, c in enumerate(order)}
    cells = df.select(*[k.alias(n) for k, n in zip(keys, names)], F.col(RID).alias("_row"), *[numbers[c].alias(place[c]) for c in order])
    none, one = F.lit(None).cast("double"), F.lit(1).cast("bigint")
    sources = list(dict.fromkeys(metrics[i]["column"] for i in summed))

    def entry(source: int, number: Column, carried: bool) -> Column:
        extra = [(F.col(place[metrics[i]["column"]]) if carried else none).alias(f"_x{i}") for i in extremes]
        return F.struct(F.lit(source).alias("_source"), number.alias("_num"), one.alias("_times"), *extra)

    entries = [entry(-1, F.lit(0.0), True), *[entry(j, F.col(place[c]), False) for j, c in enumerate(sources)]]
    split = cells.select(*names, "_row", F.inline(F.array(*entries))).where("_num is not null")

    def best(i: int) -> Column:
        return (F.min if metrics[i]["fn"] == "min" else F.max)(f"_x{i}").alias(f"_x{i}")

    firsts = [F.min("_row").alias("_row"), *[best(i) for i in extremes]]
    binned = with_digits(split, "_num", "_times").groupBy(*names, "_source", "bin").agg(*digit_sums(), *firsts)

    def of(source: int, x: Column) -> Column:
        return F.when(F.col("_source") == source, x)

    groups = binned.groupBy(*names).agg(
        *[F.collect_list(of(j, F.struct(*PARTS))).alias(f"_t{j}") for j in range(len(sources))],
        *[F.sum(of(j, F.col("n"))).alias(f"_c{j}") for j in range(len(sources))],
        F.sum(of(-1, F.col("n"))).alias("_rows"),
        *firsts,
    )
    totals = with_totals(groups, [f"_t{j}" for j in range(len(sources))])

    def value(i: int, m: dict) -> Column:
        if m["fn"] == "count":
            return F.col("_rows")
        if m["fn"] in ("min", "max"):
            return F.col(f"_x{i}")
        j = sources.index(m["column"])
        return F.round(F.col(f"_t{j}") if m["fn"] == "sum" else F.col(f"_t{j}") / F.col(f"_c{j}"), 4)

    return totals.select(*names, *[value(i, m).alias(f"_m{i}") for i, m in enumerate(metrics)], F.col("_row").alias(FIRST))


def aggregate_groups(df: DataFrame, group_by: list[str], metrics: list[dict] | None = None) -> DataFrame:
    """Every group with its metrics, plus the hidden first row of the group.

    Metrics are partial aggregates: a hot group shrinks before the shuffle,
    and exact distinct counts spread over (group, value) first.
    """
    require_columns(df, group_by)
    metrics = metrics or [{"fn": "count", "as": "count"}]
    for m in metrics:
        _checked(df, m)
    keys = [F.coalesce(cell_text(df, c), F.lit(BLANK_GROUP)) for c in group_by]
    names = [f"_k{i}" for i in range(len(keys))]
    named = [k.alias(n) for k, n in zip(keys, names)]
    summed = any(m["fn"] in ("sum", "avg") for m in metrics)
    apart = [i for i, m in enumerate(metrics) if m["fn"] == "distinct"] if summed else []
    others = [m for i, m in enumerate(metrics) if i not in apart]
    groups = _summed_groups(df, keys, others) if summed else _plain_groups(df, named, metrics)
    at = {i: f"_m{j}" for j, i in enumerate(i for i in range(len(metrics)) if i not in apart)}
    if apart:
        # Distinct values cannot be added up bin by bin: they are counted apart.
        counts = df.groupBy(*[k.alias(f"_d{i}") for i, k in enumerate(keys)]).agg(
            *[_distinct(df, metrics[i]).alias(f"_a{i}") for i in apart]
        )
        # Without keys both sides are one row.
        same = [F.col(n) == F.col(f"_d{i}") for i, n in enumerate(names)] or [F.lit(True)]
        groups = groups.join(counts, same)
        at |= {i: f"_a{i}" for i in apart}
    out = [F.col(n).alias(c) for n, c in zip(names, group_by)]
    groups = groups.select(*out, *[F.col(at[i]).alias(metric_name(m)) for i, m in enumerate(metrics)], FIRST)
    # Without keys an empty table still yields a row; it has no groups.
    return groups if group_by else groups.where(F.col(FIRST).isNotNull())


def sorted_groups(groups: DataFrame, sort_by: dict | None = None, limit: int | None = None) -> DataFrame:
    """Groups in order, all of them unless a limit is given."""
    output = [c for c in groups.columns if c != FIRST]
    if sort_by:
        require_columns(groups.drop(FIRST), [sort_by["column"]])
    ordered = in_order(groups, sort_by, FIRST)
    page = ordered if limit is None else ordered.limit(limit)
    return page.select(*[col(c) for c in output])


def aggregate(
    df: DataFrame,
    group_by: list[str] | None = None,
    metrics: list[dict] | None = None,
    sort_by: dict | None = None,
    limit: int | None = None,
) -> DataFrame:
    return sorted_groups(aggregate_groups(df, group_by or [], metrics), sort_by, limit)


def group_total(df: DataFrame, group_by: list[str]) -> DataFrame:
    return aggregate_groups(df, group_by).agg(F.count(F.lit(1)).alias("groups"))


def chart_title(group_by: str, metric: dict, title: str | None = None) -> str:
    of = f" of {metric['column']}" if metric.get("column") else ""
    return title or f"{metric['fn']}{of} by {group_by}"


def chart_series(
    df: DataFrame,
    group_by: str,
    metric: dict,
    sort: str = "value_desc",
    limit: int = CHART_SIZE,
    chart_type: str = "bar",
) -> DataFrame:
    """One category and one value per row, ready to plot."""
    if sort not in CHART_SORTS:
        raise ValueError(f'Unknown chart sort "{sort}". Use {", ".join(CHART_SORTS)}.')
    if chart_type not in CHART_TYPES:
        raise ValueError(f'Unknown chart type "{chart_type}". Use {" or ".join(CHART_TYPES)}.')
    value = metric_name(metric)
    order = (
        {"column": group_by, "direction": "asc"}
        if sort == "category_asc"
        else {"column": value, "direction": "asc" if sort == "value_asc" else "desc"}
    )
    series = aggregate(df, [group_by], [{**metric, "as": value}], order, limit or CHART_SIZE)
    return series.where(col(value).isNotNull())
