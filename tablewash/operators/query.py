"""Filter, sort, project and page."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewash.functions.compare import predicate, sort_keys
from tablewash.operators.membership import filtered, split_long
from tablewash.operators.table import RID, col, column_type, data_columns, fresh, require_columns

PAGE_SIZE = 50


def condition(df: DataFrame, column: str, operator: str = "eq", value: Any = None) -> Column:
    require_columns(df, [column])
    return predicate(col(column), column_type(df, column), operator, value)


def filter_rows(df: DataFrame, filters: list[dict]) -> DataFrame:
    """Rows that meet all conditions, each ``{column, operator, value}``.

    The value of ``in`` may be a list of any length or a one-column frame.
    """
    plain, long = split_long(filters)
    conditions = [condition(df, f["column"], f.get("operator") or "eq", f.get("value")) for f in plain]
    return filtered(df, long, conditions)


def in_order(df: DataFrame, sort: dict | None, last: str = RID) -> DataFrame:
    """Sort by ``{column, direction}``, ties by the column ``last``.

    The keys become columns first. As expressions in the ordering they would
    be worked out again for every comparison.
    """
    if not sort:
        return df.orderBy(last)
    column, direction = sort["column"], sort.get("direction") or "asc"
    require_columns(df, [column])
    if direction not in ("asc", "desc"):
        raise ValueError(f'Unknown sort direction "{direction}". Use asc or desc.')
    keys = sort_keys(col(column), column_type(df, column))
    names = [fresh(df, f"_s{i}") for i in range(len(keys))]
    by = [col(n).desc() if direction == "desc" else col(n).asc() for n in names]
    keyed = df.select("*", *[k.alias(n) for k, n in zip(keys, names)])
    return keyed.orderBy(*by, last)


@dataclass(frozen=True)
class Page:
    """One page of a query; ``matched`` is its one-row total, still lazy."""

    rows: DataFrame
    matched: DataFrame


def query_rows(
    df: DataFrame,
    filters: list[dict] | None = None,
    sort: dict | None = None,
    columns: list[str] | None = None,
    limit: int = PAGE_SIZE,
    offset: int = 0,
) -> Page:
    """Filter, sort, project and page. Spark plans the page as a top-k."""
    chosen = list(columns) if columns else data_columns(df)
    require_columns(df, chosen)
    found = filter_rows(df, filters or [])
    # The order may need columns that the projection leaves out.
    page = in_order(found, sort).offset(offset).limit(limit)
    matched = found.agg(F.count(F.lit(1)).alias("matched_rows"))
    return Page(page.select(*[col(c) for c in chosen]), matched)
