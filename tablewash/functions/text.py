"""Text semantics of a cell: trimming, blanks, grouping keys, text form.

Everything here maps ``Column -> Column`` and is built from JVM functions, so
it stays inside whole-stage code generation and constant-folds on literals.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The characters that count as whitespace around a cell.
WHITESPACE = (
    "\t\n\x0b\f\r \u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)
# The same set as the inside of a regular-expression character class.
WS = r"\t\n\x0B\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"

# Words that stand for a missing value.
BLANK_WORDS = ("na", "n/a", "null", "none", "nil", "-", "--", "?")

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def strip(c: Column) -> Column:
    """Trim the whole whitespace set; Spark's ``trim`` only knows the space."""
    return F.btrim(c, F.lit(WHITESPACE))


def is_blank(c: Column) -> Column:
    """Null, whitespace only, or a placeholder such as ``N/A``; never null."""
    return c.isNull() | F.lower(strip(c)).isin("", *BLANK_WORDS)


def norm_key(c: Column) -> Column:
    """Key under which spellings of one label meet. Trims before it folds."""
    return F.regexp_replace(F.lower(strip(c)), f"[{WS}._-]+", " ")


def num_text(x: Column) -> Column:
    """Shortest decimal text of a double: ``39545.0`` reads ``39545``.

    Plain digits from 1e-6 up to 1e21, exponent form outside of that range.
    """
    raw = x.cast("string")
    size = F.abs(x)

    def plain(scale: int) -> Column:
        fixed = raw.try_cast(T.DecimalType(38, scale)).cast("string")
        return F.regexp_replace(fixed, r"\.?0+\z", "")

    return (
        F.when(size == 0, F.lit("0"))
        .when(size >= 1e21, F.regexp_replace(raw, r"(\.0)?E", "e+"))
        .when(size >= 1e15, raw.try_cast(T.DecimalType(38, 0)).cast("string"))
        .when(F.floor(size) == size, x.cast("bigint").cast("string"))
        .when(size >= 1e7, plain(10))
        .when(size >= 1e-3, raw)
        .when(size >= 1e-6, plain(28))
        .otherwise(F.regexp_replace(raw, r"(\.0)?E", "e"))
    )


def text_of(c: Column, data_type: T.DataType) -> Column:
    """Text form of a column of any type; strings pass through untouched."""
    if isinstance(data_type, T.StringType):
        return c
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        return num_text(c.cast("double"))
    if isinstance(data_type, T.DecimalType):
        fixed = c.cast("string")
        return F.when(fixed.contains("."), F.regexp_replace(fixed, r"\.?0+\z", "")).otherwise(fixed)
    if isinstance(data_type, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(c)
    return c.cast("string")
