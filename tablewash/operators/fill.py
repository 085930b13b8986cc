"""Filling blanks from above without sorting the table in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablewash.operators.table import RID, col, fresh

# Bits of the row id that a bucket spans, then of the bucket number that a
# group spans, and so on up to the whole of 64 bits. Row ids are unique, so no
# bucket holds more than 65,536 rows and the last window 16, whatever the ids.
_ROW_BITS = 16
_FAN_BITS = (12, 12, 12, 8)


def _from_before(lasts: DataFrame, fans: tuple[int, ...]) -> DataFrame:
    """``(b, carried)`` from ``(b, last)``: the last value of an earlier b."""
    before = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    if not fans:
        # What is left is one row per 2**60 row ids.
        return lasts.select("b", F.last("last", ignorenulls=True).over(before).alias("carried"))
    grouped = lasts.withColumn("g", F.shiftright("b", fans[0]))
    inside = F.last("last", ignorenulls=True).over(
        Window.partitionBy("g").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    )
    held = F.when(F.col("last").isNotNull(), F.col("b"))
    ends = grouped.groupBy(F.col("g").alias("b")).agg(F.max_by("last", held).alias("last"))
    outside = _from_before(ends, fans[1:]).select(F.col("b").alias("g"), F.col("carried").alias("outer"))
    return (
        grouped.select("b", "g", inside.alias("inner"))
        .join(outside, "g", "left")
        .select("b", F.coalesce("inner", "outer").alias("carried"))
    )


def with_value_above(df: DataFrame, value: Column, name: str) -> DataFrame:
    """Add the last non-null ``value`` at or above each row.

    One shuffle of the rows by bucket; the join with the carried values uses
    the same partitioning.
    """
    v, b, c, a = (fresh(df, n) for n in ("_v", "_b", "_c", "_a"))
    bucketed = df.select("*", value.alias(v), F.shiftright(RID, _ROW_BITS).alias(b))
    seen = F.when(col(v).isNotNull(), F.col(RID))
    lasts = bucketed.groupBy(col(b).alias("b")).agg(F.max_by(col(v), seen).alias("last"))
    carried = _from_before(lasts, _FAN_BITS).select(F.col("b").alias(b), F.col("carried").alias(c))
    above = F.last(col(v), ignorenulls=True).over(
        Window.partitionBy(col(b)).orderBy(RID).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    filled = bucketed.withColumn(a, above).join(carried, b, "left")
    return filled.select(*[col(x) for x in df.columns], F.coalesce(col(a), col(c)).alias(name))
