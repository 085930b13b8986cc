"""Exact quantiles by radix selection on the bits of doubles.

The wanted value is the one at position ``floor(p * (n - 1))``. The bits of a
double, sign, exponent, mantissa, order like the numbers themselves once a
negative one counts down. A histogram over the highest share of the bits
tells which bucket holds a rank; the next share is looked at within that bucket
only, for all columns and probabilities at once. After the last share a bucket
is one number, so nothing is ranked, wherever the numbers crowd.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Bits below each share, from the highest: shares of 20, 22 and 22 bits.
_BELOW = (44, 22, 0)
_SMALLEST_NORMAL = -1022


def with_order_bits(numbers: DataFrame) -> DataFrame:
    """The rows with ``bits``, a BIGINT that orders and tells apart the finite doubles ``num``.

    Up to the sign these are the bits that a double is stored in.
    """
    size = F.abs(F.col("num"))
    kept = numbers.columns
    # The logarithm may be off by one at powers of two.
    guess = numbers.select(*kept, F.floor(F.log2(F.when(size > 0, size))).cast("int").alias("_e"))
    share = size / F.pow(F.lit(2.0), F.col("_e"))
    exponent = F.col("_e") + F.when(share >= 2, 1).when(share < 1, -1).otherwise(0)
    known = guess.select(*kept, exponent.alias("_e"))
    mantissa = ((size / F.pow(F.lit(2.0), F.col("_e")) - 1) * F.lit(2.0**52)).cast("bigint")
    normal = (F.col("_e") - _SMALLEST_NORMAL + 1).cast("bigint") * F.lit(1 << 52) + mantissa
    small = (size / F.lit(5e-324)).cast("bigint")
    bits = F.coalesce(F.when(F.col("_e") >= _SMALLEST_NORMAL, normal).otherwise(F.when(size < 1, small)), F.lit(0))
    signed = known.select(*kept, bits.alias("bits"))
    return signed.select(*kept, F.when(F.col("num") < 0, -F.col("bits")).otherwise(F.col("bits")).alias("bits"))


def _holding_rank(hist: DataFrame, by: list[str], order: str) -> DataFrame:
    """Rows whose running count first passes ``rank``; rank becomes relative."""
    upto = F.sum("c").over(
        Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        hist.withColumn("upto", upto)
        .where((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("c")))
        .withColumn("rank", F.col("rank") - (F.col("upto") - F.col("c")))
        .drop("upto", "c")
    )


def coarse_histogram(numbers: DataFrame, *extra: Column) -> tuple[DataFrame, DataFrame]:
    """``numbers`` with their bits and highest share ``b``, and its histogram with any ``extra`` sums."""
    placed = with_order_bits(numbers).withColumn("b", F.shiftright("bits", _BELOW[0]))
    hist = placed.groupBy("column", "b").agg(
        F.sum("cnt").alias("c"), F.min("num").alias("lo"), F.max("num").alias("hi"), *extra
    )
    return placed, hist


def exact_quantiles(numbers: DataFrame, probs: list[float]) -> DataFrame:
    """``(column, p, value, n)`` from ``(column, num, cnt)``.

    ``numbers`` may repeat a number; repeated rows only cost time.
    """
    return quantiles_of(*coarse_histogram(numbers), probs)


def quantiles_of(placed: DataFrame, hist: DataFrame, probs: list[float]) -> DataFrame:
    # At most 2**20 buckets per column, whatever the table size.
    n = F.sum("c").over(Window.partitionBy("column"))
    wanted = F.explode(F.array(*[F.lit(float(p)) for p in probs]))
    ranked = (
        hist.select("column", "b", "c", n.alias("n"))
        .select("*", wanted.alias("p"))
        .withColumn("rank", F.floor(F.col("p") * (F.col("n") - 1)))
    )
    # One row per column and probability from here on the broadcast side.
    target = _holding_rank(ranked, ["column", "p"], "b")
    inside = placed.select("column", "num", "cnt", "bits", "b")
    for above, below in zip(_BELOW, _BELOW[1:]):
        chosen = target.select("column", "p", "n", "rank", "b")
        inside = inside.join(F.broadcast(chosen), ["column", "b", *(["p"] if above != _BELOW[0] else [])])
        inside = inside.select("column", "p", "n", "rank", "num", "cnt", "bits", F.shiftright("bits", below).alias("b"))
        shares = inside.groupBy("column", "p", "n", "rank", "b").agg(F.sum("cnt").alias("c"), F.min("num").alias("num"))
        target = _holding_rank(shares, ["column", "p"], "b")
        inside = inside.drop("n", "rank")
    return target.select("column", "p", F.col("num").alias("value"), "n")
