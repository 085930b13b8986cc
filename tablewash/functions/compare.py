"""Filter predicates and the sort order of cells."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewash.functions.dates import coerce_date
from tablewash.functions.numbers import coerce_number, number_of
from tablewash.functions.text import is_blank, num_text, text_of

# The operators a filter may name.
OPERATORS = (
    "eq", "neq", "gt", "gte", "lt", "lte", "contains", "starts_with", "in", "is_blank", "not_blank",
)

_ORDERINGS = {
    "gt": lambda a, b: a > b,
    "gte": lambda a, b: a >= b,
    "lt": lambda a, b: a < b,
    "lte": lambda a, b: a <= b,
}


def literal_text(value: Any) -> Column:
    """Text form of a parameter, by the rules that apply to cells."""
    if value is None:
        return F.lit(None).cast("string")
    if isinstance(value, bool):
        return F.lit("true" if value else "false")
    if isinstance(value, (int, float)):
        return num_text(F.lit(float(value)))
    return F.lit(str(value))


def predicate(c: Column, data_type: T.DataType, operator: str, value: Any = None) -> Column:
    """Whether a cell meets a condition; null counts as "no" (see ``holds``).

    Parameters are literals, so Spark folds their coercion and what is left
    is often a plain comparison that reaches the file scan.
    """
    text, number = text_of(c, data_type), number_of(c, data_type)
    # A number has no placeholder texts: it is blank when it is missing.
    numeric = isinstance(data_type, T.NumericType)
    blank = c.isNull() if numeric else is_blank(text)
    if operator == "is_blank":
        return blank
    if operator == "not_blank":
        return ~blank
    if operator == "contains":
        return F.lower(text).contains(F.lower(literal_text(value)))
    if operator == "starts_with":
        return F.lower(text).startswith(F.lower(literal_text(value)))
    if operator == "eq":
        return _equal(c, text, number, numeric, value)
    if operator == "neq":
        return ~holds(_equal(c, text, number, numeric, value))
    if operator == "in":
        if not isinstance(value, (list, tuple, set)):
            raise ValueError('Operator "in" needs a list of values.')
        return _is_in(c, text, number, numeric, list(value))
    if operator in _ORDERINGS:
        return _ordered(c, text, number, numeric, blank, operator, value)
    raise ValueError(f'Unknown operator "{operator}". Use {", ".join(OPERATORS)}.')


def holds(condition: Column) -> Column:
    """Two-valued form of a predicate, for negation and projection."""
    return F.coalesce(condition, F.lit(False))


def _empty(value: Any) -> bool:
    return value is None or value == ""


def _equal(c: Column, text: Column, number: Column, numeric: bool, value: Any) -> Column:
    wanted = literal_text(value)
    if _empty(value):
        return c.isNull() if numeric else text.isNull() | (text == "")
    if numeric:
        return number == coerce_number(wanted)
    # Null unless both are numbers, and then the text decides.
    return F.coalesce(number == coerce_number(wanted), text == wanted)


def _is_in(c: Column, text: Column, number: Column, numeric: bool, values: list[Any]) -> Column:
    texts = [literal_text(v) for v in values if not _empty(v)]
    found = F.lit(False)
    if texts:
        found = holds(number.isin(*[coerce_number(t) for t in texts]))
        if not numeric:
            found = found | holds(text.isin(*texts))
    if len(texts) < len(values):
        found = found | (c.isNull() if numeric else text.isNull() | (text == ""))
    return found


def _ordered(
    c: Column, text: Column, number: Column, numeric: bool, blank: Column, operator: str, value: Any
) -> Column:
    compare = _ORDERINGS[operator]
    wanted = literal_text(value)
    if numeric and isinstance(value, (int, float)) and not isinstance(value, bool):
        # A number cell against a number: nothing to coerce. The bare
        # comparison reaches the scan; the other one rejects a NaN.
        return compare(c, F.lit(value)) & number.isNotNull()
    # Each comparison is null unless both sides can be read that way.
    verdict = F.coalesce(
        compare(number, coerce_number(wanted)),
        compare(coerce_date(text), coerce_date(wanted)),
        compare(text, wanted),
    )
    return ~blank & verdict


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def sort_keys(c: Column, data_type: T.DataType) -> list[Column]:
    """Empty cells, then numbers by value, then text in locale order."""
    number = number_of(c, data_type)
    if isinstance(data_type, T.NumericType):
        return [number.isNotNull(), number]
    text = text_of(c, data_type)
    empty = text.isNull() | (text == "")
    return [
        F.when(empty, 0).when(number.isNotNull(), 1).otherwise(2),
        number,
        F.when(~empty & number.isNull(), F.collate(text, "UNICODE")),
    ]
