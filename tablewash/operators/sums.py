"""Exact sums of doubles in any order of rows.

A double is a whole number of at most 53 bits times a power of two. It is cut
into digits of 23 bits; a ``bin`` is the place of its lowest digit. Digits of
equal bin are added as BIGINT in one hash aggregation, which is exact for some
10**11 rows of a group whatever their size; a group has 98 bins at most. The
digits are carried and become a double only at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 23
DIGITS = 4
_BASE = 1 << BITS
PARTS = ["bin", *[f"d{i}" for i in range(DIGITS)]]


def _times_power(x: Column, exponent: Column) -> Column:
    """``x * 2**exponent`` in two steps, as one power may be too large for a double."""
    half = F.floor(exponent / 2)
    two = F.lit(2.0)
    return x * F.pow(two, half) * F.pow(two, exponent - half)


def with_digits(rows: DataFrame, num: str, times: str) -> DataFrame:
    """The rows with ``bin`` and ``d0 .. d3`` of the finite double ``num``, taken ``times`` times, in place of both; ``n`` counts.

    Step by step, so that no expression is repeated within another.
    """
    kept = [F.col(c) for c in rows.columns if c not in (num, times)]
    # One bit to spare on either side: the logarithm may be off by one at powers of two.
    place = F.floor((F.floor(F.log2(F.abs(F.col(num)))) - 53) / BITS).cast("int")
    at = F.when(F.col(num) == 0, F.lit(0)).otherwise(place)
    cut = rows.select(*kept, num, F.col(times).cast("bigint").alias("n"), at.alias("bin"))
    cut = cut.select(*kept, "n", "bin", _times_power(F.col(num), F.col("bin") * -BITS).alias("_m"))
    # A cast drops what is behind the point.
    cut = cut.select("*", (F.col("_m") / F.lit(float(_BASE))).cast("bigint").alias("_high"))
    cut = cut.select("*", F.expr(f"_high div {_BASE}").alias("_rest"))
    parts = [
        (F.col("_m") - F.col("_high").cast("double") * F.lit(float(_BASE))).cast("bigint"),
        F.col("_high") % F.lit(_BASE),
        F.col("_rest") % F.lit(_BASE),
        F.expr(f"_rest div {_BASE}"),
    ]
    return cut.select(*kept, "n", "bin", *[(d * F.col("n")).alias(f"d{i}") for i, d in enumerate(parts)])


def digit_sums() -> list[Column]:
    """The aggregates of a group by bin."""
    return [F.sum(f"d{i}").alias(f"d{i}") for i in range(DIGITS)] + [F.sum("n").alias("n")]


# SQL of the steps from an array of ``(bin, d0 .. d3)`` to a double; {0} is the column.
_PLACED = "if(size({0}) > 0, flatten(transform({0}, x -> array(" + ", ".join(
    f"struct(x.bin + {i} AS p, x.d{i} AS d)" for i in range(DIGITS)
) + "))), NULL)"
_BY_PLACE = (
    f"transform(sequence(array_min(transform({{0}}, x -> x.p)), array_max(transform({{0}}, x -> x.p)) + {DIGITS}),"
    " p -> struct(p, aggregate(filter({0}, x -> x.p = p), 0L, (s, x) -> s + x.d) AS d))"
)
# Every digit from the lowest up between 0 and the base, the highest first.
_CARRIED = (
    "aggregate({0}, struct(0L AS carry, cast(array() AS array<struct<p:int,d:bigint>>) AS held), (a, x) -> struct("
    f"shiftright(a.carry + x.d, {BITS}) AS carry, concat(array(struct(x.p AS p, pmod(a.carry + x.d, {_BASE}L) AS d)), a.held) AS held))"
)
_POWER = f"pow(2D, floor(x.p * {BITS} / 2)) * pow(2D, x.p * {BITS} - floor(x.p * {BITS} / 2))"
_VALUE = f"aggregate(filter({{0}}.held, x -> x.d != 0), 0D, (s, x) -> s + x.d * {_POWER})"
_NEGATED = "transform({0}, x -> struct(x.p, -x.d AS d))"


def with_totals(groups: DataFrame, bins: list[str]) -> DataFrame:
    """The rows with a double in place of each array of ``(bin, d0 .. d3)``: what it adds up to, null if it is empty."""
    others = [F.col(c) for c in groups.columns if c not in bins]

    def each(frame: DataFrame, *values: tuple[str, str]) -> DataFrame:
        return frame.select(*others, *[F.expr(sql.format(b)).alias(b + end) for b in bins for sql, end in values])

    placed = each(groups, (_PLACED, ""))
    summed = each(placed, (_BY_PLACE, ""))
    up = each(summed, ("{0}", ""), (_CARRIED, "_up"))
    down = _VALUE.format("(" + _CARRIED.format(_NEGATED) + ")")
    return each(up, (f"if({{0}}_up.carry < 0, -({down}), {_VALUE.replace('{0}', '{0}_up')})", ""))


def exact_totals(rows: DataFrame, keys: list[str], num: Column, times: Column | None = None) -> DataFrame:
    """``(keys, n, total)``: how many numbers each group has, and their exact sum as a double."""
    names = [f"_k{i}" for i in range(len(keys))]
    weight = (F.lit(1) if times is None else times).alias("_times")
    plain = rows.select(*[F.col(k).alias(a) for k, a in zip(keys, names)], num.alias("_num"), weight).where("_num is not null")
    binned = with_digits(plain, "_num", "_times").groupBy(*names, "bin").agg(*digit_sums())
    groups = binned.groupBy(*names).agg(F.sum("n").alias("n"), F.collect_list(F.struct(*PARTS)).alias("total"))
    return with_totals(groups, ["total"]).select(*[F.col(a).alias(k) for k, a in zip(keys, names)], "n", "total")
