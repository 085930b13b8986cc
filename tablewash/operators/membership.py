"""Conditions against long lists of values: a join where ``in`` takes literals.

Cell and value meet in one key. A cell that reads as a number matches by the
number alone, as equal texts are equal numbers; any other cell matches by its
text; empty cells match a listed null or ``''``. So the join has one
equality, and Spark may broadcast it, filter at run time or split hot keys.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewash.functions.compare import all_of
from tablewash.functions.numbers import coerce_number, number_of
from tablewash.functions.text import num_text, text_of
from tablewash.operators.table import cell_number, cell_text, col, column_type, data_columns, fresh, require_columns

# Lists up to this length stay literals of the plan; the answer is the same.
LITERALS = 1_000
# Lists handed over as parameters are broadcast up to this many characters.
_BROADCAST_CHARS = 32_000_000
_EMPTY = "e"


def is_long(value: Any) -> bool:
    return isinstance(value, DataFrame) or (isinstance(value, (list, tuple, set, frozenset)) and len(value) > LITERALS)


def _key(number: Column, text: Column, numeric: bool) -> Column:
    """``e`` for empty, ``n`` and the number, or ``t`` and the text; null meets nothing."""
    by_number = F.concat(F.lit("n"), (number + F.lit(0.0)).cast("string"))
    if numeric:
        return by_number
    return F.when(text.isNull() | (text == ""), _EMPTY).otherwise(F.coalesce(by_number, F.concat(F.lit("t"), text)))


def _cell_key(df: DataFrame, column: str) -> Column:
    numeric = isinstance(column_type(df, column), T.NumericType)
    key = _key(cell_number(df, column), cell_text(df, column), numeric)
    # A NaN is no number and not empty either.
    return F.when(col(column).isNull(), _EMPTY).otherwise(key) if numeric else key


def _listed(df: DataFrame, values: Any) -> tuple[DataFrame, bool]:
    """The list as rows ``text, number``, and whether its size is known to be small."""
    if isinstance(values, DataFrame):
        names = data_columns(values)
        if len(names) != 1:
            raise ValueError('A table for "in" has one column of values.')
        kind = values.schema[names[0]].dataType
        return values.select(text_of(col(names[0]), kind).alias("text"), number_of(col(names[0]), kind).alias("number")), False

    def row(v: Any) -> tuple[str | None, float | None]:
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            return None, float(v)
        return (("true" if v else "false") if isinstance(v, bool) else v if v is None else str(v)), None

    rows = list(dict.fromkeys(row(v) for v in values))
    given = df.sparkSession.createDataFrame(rows, "text string, number double")
    known = given.select(F.coalesce("text", num_text(F.col("number"))).alias("text"))
    small = sum(len(t or "") + 24 for t, _ in rows) <= _BROADCAST_CHARS
    return known.select("text", coerce_number(F.col("text")).alias("number")), small


def _keys(df: DataFrame, column: str, values: Any, name: str) -> DataFrame:
    """The distinct keys of the list."""
    listed, small = _listed(df, values)
    numeric = isinstance(column_type(df, column), T.NumericType)
    empty = F.col("text").isNull() | (F.col("text") == "")
    key = F.when(empty, _EMPTY).otherwise(_key(F.col("number"), F.col("text"), numeric))
    keys = listed.select(key.alias(name)).where(col(name).isNotNull()).distinct()
    return F.broadcast(keys) if small else keys


def _range(df: DataFrame, column: str, values: Any) -> Column | None:
    """For a number column and a list of numbers: the range that holds them, which a file scan can use."""
    if isinstance(values, DataFrame) or not values or not isinstance(column_type(df, column), T.NumericType):
        return None
    # Beyond 2**53 whole numbers meet as doubles, which a range of exact ones would not follow; a NaN has no place.
    if not all(isinstance(v, (int, float)) and not isinstance(v, bool) and abs(v) < 2**53 for v in values):
        return None
    return col(column).between(min(values), max(values))


def rows_in(df: DataFrame, column: str, values: Any) -> DataFrame:
    """Rows whose cell equals a value of a list of any length, or of a one-column frame."""
    require_columns(df, [column])
    bounds = _range(df, column, values)
    found = df if bounds is None else df.where(bounds)
    key, wanted = fresh(df, "_cell"), fresh(df, "_wanted")
    keyed = found.select("*", _cell_key(df, column).alias(key))
    met = keyed.join(_keys(df, column, values, wanted), col(key) == col(wanted), "left_semi")
    return met.select(*[col(c) for c in df.columns])


def marked_in(df: DataFrame, column: str, values: Any) -> tuple[DataFrame, Column]:
    """All rows, and the column that tells whether the cell is listed."""
    require_columns(df, [column])
    wanted = fresh(df, "_wanted")
    marked = df.join(_keys(df, column, values, wanted), _cell_key(df, column) == col(wanted), "left")
    return marked, col(wanted).isNotNull()


def split_long(filters: list[dict]) -> tuple[list[dict], list[dict]]:
    """Filters that are expressions, and those against long lists."""
    long = [f for f in filters if f.get("operator") == "in" and is_long(f.get("value"))]
    return [f for f in filters if not any(f is g for g in long)], long


def filtered(df: DataFrame, filters: list[dict], conditions: list[Column]) -> DataFrame:
    """Plain conditions first, then the lists one by one."""
    out = df.where(all_of(conditions)) if conditions else df
    for f in filters:
        out = rows_in(out, f["column"], f["value"])
    return out
