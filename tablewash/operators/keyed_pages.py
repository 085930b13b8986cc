"""Pages by key: each begins after the last row of the one before.

An offset makes Spark order every row up to the page. A cursor holds the sort
keys and the row id of the last row seen; rows at or before it are filtered
out, for number columns and row ids already in the file scan, and any page is a
top-k of the page's size.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewash.functions.compare import sort_keys
from tablewash.operators.query import PAGE_SIZE, filter_rows
from tablewash.operators.table import RID, col, column_type, data_columns, fresh, require_columns

_SCANNED = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType)


@dataclass(frozen=True)
class KeyedPage:
    """``rows`` is the lazy page; ``cursor`` runs it and says where the next one begins."""

    rows: DataFrame
    # The page with its keys, in order.
    keyed: DataFrame
    order: dict
    limit: int

    def cursor(self) -> str | None:
        """For the next page's ``after``; None if this page is not full."""
        found = self.keyed.collect()
        if len(found) < self.limit:
            return None
        *keys, rid = found[-1]
        return json.dumps({**self.order, "keys": keys, "rid": rid}, ensure_ascii=False)


def _later(key: Column, at: Column, known: bool, descending: bool) -> Column:
    """Whether a key sorts after the cursor's: nulls first upwards, last downwards, as Spark orders them."""
    if descending:
        return (key.isNull() | (key < at)) if known else F.lit(False)
    return (key > at) if known else key.isNotNull()


def _scan_bound(df: DataFrame, column: str, at: float | None, descending: bool) -> Column | None:
    """What the rows after the cursor have in common and a file scan understands."""
    if not isinstance(column_type(df, column), _SCANNED) or at is None:
        return None
    if descending:
        # A NaN counts as no number, hence as null, but as the largest in comparisons.
        return col(column).isNull() | (col(column) <= F.lit(at)) | F.isnan(col(column).cast("double"))
    return col(column) >= F.lit(at)


def page_after(
    df: DataFrame,
    after: str | None = None,
    filters: list[dict] | None = None,
    sort: dict | None = None,
    columns: list[str] | None = None,
    limit: int = PAGE_SIZE,
) -> KeyedPage:
    """The page after a cursor (the first without one), in the order of ``query_rows``.

    Pages join up without gaps or repeats while the table stays as it is; ties
    are told apart by the row id. A cursor of another order raises.
    """
    chosen = list(columns) if columns else data_columns(df)
    require_columns(df, chosen)
    if limit < 1:
        raise ValueError("A page holds one row at least.")
    order = {"column": None, "direction": "asc"}
    if sort:
        order = {"column": sort["column"], "direction": sort.get("direction") or "asc"}
        require_columns(df, [order["column"]])
    if order["direction"] not in ("asc", "desc"):
        raise ValueError(f'Unknown sort direction "{order["direction"]}". Use asc or desc.')
    descending = order["direction"] == "desc"
    found = filter_rows(df, filters or [])
    keys = sort_keys(col(order["column"]), column_type(df, order["column"])) if sort else []
    names = [fresh(df, f"_s{i}") for i in range(len(keys))]
    if after is not None:
        at = json.loads(after)
        if {k: at[k] for k in order} != order:
            raise ValueError("The cursor belongs to another order.")
        bound = _scan_bound(df, order["column"], at["keys"][1], descending) if sort else F.col(RID) > at["rid"]
        found = found if bound is None else found.where(bound)
    keyed = found.select("*", *[k.alias(n) for k, n in zip(keys, names)])
    if after is not None and sort:
        keyed = keyed.where(_after(names, keys, at, descending))
    by = [col(n).desc() if descending else col(n).asc() for n in names]
    page = keyed.orderBy(*by, RID).limit(limit)
    # The text under its collation goes back to plain text for the cursor.
    marks = [F.collate(col(n), "UTF8_BINARY").alias(n) if i == 2 else col(n) for i, n in enumerate(names)]
    return KeyedPage(page.select(*[col(c) for c in chosen]), page.select(*marks, RID), order, limit)


def _after(names: list[str], keys: list[Column], at: dict, descending: bool) -> Column:
    """Keys after the cursor's, compared one after the other, then the row id."""
    values = at["keys"]
    # The third key is the text under the collation of the order.
    wanted = [F.collate(F.lit(v), "UNICODE") if i == 2 and v is not None else F.lit(v) for i, v in enumerate(values)]

    def tail(i: int) -> Column:
        if i == len(names):
            return F.col(RID) > F.lit(at["rid"])
        known, key = values[i] is not None, col(names[i])
        same = (key == wanted[i]) if known else key.isNull()
        return _later(key, wanted[i], known, descending) | (same & tail(i + 1))

    return tail(0)
