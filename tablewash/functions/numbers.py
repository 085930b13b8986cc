"""Number semantics of a cell."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewash.functions.text import NUMERIC_TYPES, WS, strip

# Currency signs that may surround a number.
CURRENCY_SIGNS = "$€£¥₹"

_NOISE = rf"(?!^ )[{CURRENCY_SIGNS},%{WS}]"
# Fixed value: what is left of a number once signs and separators are gone.
_NUMERAL = r"^-?\d*\.?\d+([eE][-+]?\d+)?\z"
# Fixed value: a character that no number holds, however it is written.
_FOREIGN = rf"[^\d{CURRENCY_SIGNS},%{WS}().eE+-]"
# Fixed value: the shape of a number as people format it.
_FORMATTED = (
    rf"^[{WS}]*[-(]?[{WS}]*[{CURRENCY_SIGNS}]?[{WS}]*[\d,]+(\.\d+)?[{WS}]*%?[{WS}]*\)?[{WS}]*\z"
)


def coerce_number(c: Column) -> Column:
    """Read ``$1,234.50``, ``(90)`` or ``12%`` as a double, null if it is not one.

    A trimmed cell cannot start with a space, so a leading space is free to
    carry "was in parentheses" through the clean-up of the other characters.
    Most texts are told by one foreign character and are null from there on.
    """
    text = strip(c)
    cell = F.when(~text.rlike(_FOREIGN), text)
    marked = F.regexp_replace(cell, r"^\((.*)\)\z", " $1")
    numeral = F.regexp_replace(F.regexp_replace(marked, _NOISE, ""), "^(?: -?|-)", "-")
    percent = cell.rlike(rf"%[{WS}]*\)?\z")
    size = F.get(F.regexp_extract_all(numeral, F.lit(_NUMERAL), F.lit(0)), F.lit(0)).try_cast("double")
    value = size / F.when(percent, F.lit(100.0)).otherwise(F.lit(1.0)) + F.lit(0.0)
    return F.when(F.abs(value) < F.lit(float("inf")), value)


def number_of(c: Column, data_type: T.DataType) -> Column:
    """Number held by a column of any type; NaN and infinities count as none."""
    if isinstance(data_type, T.StringType):
        return coerce_number(c)
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        wide = c.cast("double")
        return F.when(F.abs(wide) < F.lit(float("inf")), wide + F.lit(0.0))
    if isinstance(data_type, NUMERIC_TYPES):
        return c.cast("double")
    return F.lit(None).cast("double")


def formatted_number(c: Column) -> Column:
    """Whether the text is laid out like a number (``1e5`` is not)."""
    return ~c.rlike(_FOREIGN) & c.rlike(_FORMATTED)


def round_display(n: Column) -> Column:
    """Rounding used in messages and suggested bounds."""
    return F.when(F.abs(n) >= 100, F.floor(n + F.lit(0.5)).cast("double")).otherwise(F.round(n, 2))


def _limbs(num: Column) -> tuple[Column, Column, Column]:
    """``num`` as 10**18 times the first, plus the second (both whole), plus the third; null beyond 10**26."""
    limb = F.lit(Decimal(10**18))
    fixed = num.try_cast(T.DecimalType(38, 12))
    whole = F.when(fixed < 0, F.ceil(fixed)).otherwise(F.floor(fixed)).cast(T.DecimalType(27, 0))
    low = (whole % limb).cast(T.DecimalType(19, 0))
    high = ((whole - low) / limb).cast(T.DecimalType(9, 0))
    return high, low, (fixed % F.lit(Decimal(1))).cast(T.DecimalType(13, 12))


def joined(high: Column, low: Column, part: Column) -> Column:
    """The double of three exact sums, through one decimal where it holds them."""
    wide = T.DecimalType(38, 12)
    near = F.when(high == 0, F.try_add(low.try_cast(wide), part.try_cast(wide))).cast("double")
    far = high.cast("double") * F.lit(1e18) + low.cast("double") + part.cast("double")
    return F.coalesce(near, far)


def exact_sum(num: Column) -> Column:
    """Sum to 4 decimals that does not depend on the order of the rows.

    Adds decimals, whole and fractional parts apart where one total is too
    long; a group holding a value beyond 10**26 falls back to the double sum.
    """
    fixed = num.try_cast(T.DecimalType(38, 12))
    held = F.count(num) == F.count(fixed)
    total = F.when(held, F.try_sum(fixed))
    apart = F.when(held, joined(*[F.try_sum(x) for x in _limbs(num)]))
    return F.coalesce(F.round(total, 4).cast("double"), F.round(F.coalesce(apart, F.sum(num)), 4))


def exact_mean(num: Column) -> Column:
    """Mean to 4 decimals over the numeric cells, null if there are none."""
    fixed = num.try_cast(T.DecimalType(38, 12))
    held = F.count(num) == F.count(fixed)
    total = F.when(held, F.try_sum(fixed)).cast("double")
    apart = F.when(held, joined(*[F.try_sum(x) for x in _limbs(num)]))
    n = F.count(num)
    return F.when(n > 0, F.round(F.coalesce(total, apart, F.sum(num)) / n, 4))


def weighted_sums(num: Column, cnt: Column) -> tuple[list[Column], Column, Column]:
    """Sum of ``num`` taken ``cnt`` times: in three exact parts for ``joined``, whether whole, and double.

    The parts leave out values beyond 10**26; then "whole" is false.
    """
    times = cnt.cast(T.DecimalType(19, 0))
    limbs = _limbs(num)
    parts = [F.try_sum(x * times) for x in limbs]
    return parts, F.count(limbs[1]) == F.count(num), F.sum(num * cnt)
