"""Date semantics of a cell. Dates stay ISO text until a type is asked for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablewash.functions.text import WS, strip

# Month names by their first three letters.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")

# Names of the ways to write a date.
SHAPE_ISO = "ISO (yyyy-mm-dd)"
SHAPE_SLASH = "slash/dot (d/m/y or m/d/y)"
SHAPE_TEXT = "text month (12 Mar 2026)"
SHAPES = (SHAPE_ISO, SHAPE_SLASH, SHAPE_TEXT)

_START = rf"^(\d{{1,4}}[-/.]|\d{{1,2}}[{WS}]|[A-Za-z]{{3,9}}[{WS}])"
# A year but 0000, months 1 to 12, days 1 to 31 in any month.
_CALENDAR = r"(?<=^ [xcz]-)(?!0000)\d{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])\z"
_ABOVE_12 = r"0?(?:1[3-9]|[2-9]\d)|[1-9]\d\d"


def _layouts(day_first: bool) -> list[tuple[str, str]]:
    """Pattern and the ``year rule - year - month - day`` layout it stands for.

    The year rule is ``x`` (as written), ``c`` (two digits pivot at 70) or
    ``z`` (two digits are 20xx); the patterns after the layouts settle it.
    """
    first_is_day = " c-$3-$2-$1"
    first_is_month = " c-$3-$1-$2"
    layouts = [
        (r"(?s)^(\d{4})-(\d{1,2})-(\d{1,2}).*", " x-$1-$2-$3"),
        (r"^(\d{4})[/.](\d{1,2})[/.](\d{1,4})\z", " x-$1-$2-$3"),
        (rf"^({_ABOVE_12})[/.](\d{{1,2}})[/.](\d{{1,4}})\z", first_is_day),
    ]
    if day_first:
        layouts += [
            (rf"^(\d{{1,3}})[/.]({_ABOVE_12})[/.](\d{{1,4}})\z", first_is_month),
            (r"^(\d{1,3})[/.](\d{1,2})[/.](\d{1,4})\z", first_is_day),
        ]
    else:
        layouts.append((r"^(\d{1,3})[/.](\d{1,2})[/.](\d{1,4})\z", first_is_month))
    return layouts + [
        (rf"^(\d{{1,2}})[{WS}]+([A-Za-z]{{3}})[A-Za-z]{{0,6}}[{WS}]+(\d{{2,4}})\z", " z-$3-$2-$1"),
        (rf"^([A-Za-z]{{3}})[A-Za-z]{{0,6}}[{WS}]+(\d{{1,2}}),?[{WS}]+(\d{{2,4}})\z", " z-$3-$1-$2"),
        (r"^ c-0*([7-9]\d)-", " x-19$1-"),
        (r"^ [cz]-0*(\d\d)-", " x-20$1-"),
        (r"^ [cz]-(\d)-", " x-200$1-"),
        (r"^ [cz]-(\d{3})-", " x-0$1-"),
    ]


# Month and day without needless zeros, then with two digits.
_TWO_DIGITS = (
    (r"^( [xcz]-\d{4})-0*(\d{1,2})-0*(\d{1,2})\z", "$1-0$2-0$3"),
    (r"-0?(\d\d)(?=-|\z)", "-$1"),
)


def coerce_date(c: Column, day_first: bool = False) -> Column:
    """Read a date in any accepted layout as ``yyyy-mm-dd`` text, else null.

    Each layout rewrites the cell to one common form that starts with a space.
    A trimmed cell never does, so the layouts chain without testing each
    other, and no step needs its input twice: the generated code stays small.
    """
    cell = strip(c)
    common = cell
    for pattern, layout in _layouts(day_first):
        common = F.regexp_replace(common, pattern, layout)
    common = F.lower(common)
    for i, name in enumerate(MONTHS, 1):
        common = F.replace(common, F.lit(f"-{name}-"), F.lit(f"-{i}-"))
    for pattern, layout in _TWO_DIGITS:
        common = F.regexp_replace(common, pattern, layout)
    found = F.regexp_extract_all(F.when(cell.rlike(_START), common), F.lit(_CALENDAR), F.lit(0))
    return F.get(found, F.lit(0))


def date_shape(c: Column) -> Column:
    """Which way of writing dates the text uses; stricter than coerce_date."""
    # The three patterns.
    shape = (
        F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}"), SHAPE_ISO)
        .when(c.rlike(r"^\d{1,4}[/.]\d{1,2}[/.]\d{1,4}\z"), SHAPE_SLASH)
        .when(
            c.rlike(
                rf"^\d{{1,2}}[{WS}]+[A-Za-z]{{3,9}}[{WS}]+\d{{2,4}}\z"
                rf"|^[A-Za-z]{{3,9}}[{WS}]+\d{{1,2}},?[{WS}]+\d{{2,4}}\z"
            ),
            SHAPE_TEXT,
        )
    )
    return F.when(c.rlike(_START), shape)


def date_ordinal(iso: Column) -> Column:
    """ISO text as yyyymmdd integer: same order, and hash aggregation can keep it."""
    return F.regexp_replace(iso, "-", "").cast("int")


def from_ordinal(n: Column) -> Column:
    digits = F.lpad(n.cast("string"), 8, "0")
    return F.concat_ws("-", digits.substr(1, 4), digits.substr(5, 2), digits.substr(7, 2))
