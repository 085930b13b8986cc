"""Column inference, overview and profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablewash.functions.dates import SHAPES, from_ordinal
from tablewash.operators.frequency import Frequencies
from tablewash.operators.quantile import coarse_histogram, quantiles_of
from tablewash.operators.sums import exact_totals

TOP_VALUES = 10


def infer_types(freq: Frequencies) -> DataFrame:
    return freq.stats.select("column", "inferred_type")


def column_overview(freq: Frequencies) -> DataFrame:
    """Per column: position, name, type, blanks, and the table's row count."""
    return freq.stats.select("pos", "column", "inferred_type", "missing_count", "total_rows")


def common_profile(freq: Frequencies) -> DataFrame:
    percent = F.round(F.col("missing_count") * 100.0 / F.col("total_rows"), 1)
    return freq.stats.select(
        "pos",
        "column",
        "inferred_type",
        "total_rows",
        "missing_count",
        F.when(F.col("total_rows") > 0, percent).otherwise(F.lit(0.0)).alias("missing_pct"),
        "distinct_count",
    )


def _first(values: DataFrame, n: int, *order) -> DataFrame:
    """First n values of every column; Spark limits groups before the shuffle."""
    place = F.row_number().over(Window.partitionBy("column").orderBy(*order))
    return values.withColumn("place", place).where(F.col("place") <= n)


def sample_values(freq: Frequencies, sample_size: int = 5) -> DataFrame:
    """First distinct non-blank values in order of appearance."""
    return _first(freq.present, sample_size or 5, F.col("first_rid")).select("column", "place", "value")


def top_values(freq: Frequencies) -> DataFrame:
    """Most frequent values of text and boolean columns, ties by appearance."""
    ranked = _first(freq.of_type("string", "boolean"), TOP_VALUES, F.desc("cnt"), F.col("first_rid"))
    return ranked.select("column", "place", "value", F.col("cnt").alias("count"))


def number_profile(freq: Frequencies) -> DataFrame:
    """Extremes, mean, quartiles and sum of the number columns, all exact."""
    placed, hist = coarse_histogram(freq.numbers)
    extremes = hist.groupBy("column").agg(F.min("lo").alias("min"), F.max("hi").alias("max"))
    totals = exact_totals(freq.numbers, ["column"], F.col("num"), F.col("cnt"))
    marks = quantiles_of(placed, hist, [0.25, 0.5, 0.75])
    quantiles = marks.groupBy("column").agg(
        *[
            F.max(F.when(F.col("p") == p, F.col("value"))).alias(name)
            for p, name in ((0.25, "p25"), (0.5, "median"), (0.75, "p75"))
        ]
    )
    present = (F.col("total_rows") - F.col("missing_count")).alias("present")
    total = F.col("total")
    return (
        freq.stats.where("inferred_type = 'number'")
        .select("pos", "column", present)
        .join(F.broadcast(extremes), "column")
        .join(F.broadcast(totals), "column")
        .join(F.broadcast(quantiles), "column")
        .select(
            "pos",
            "column",
            "n",
            "min",
            "max",
            F.round(total / F.col("n"), 4).alias("mean"),
            "median",
            "p25",
            "p75",
            F.round(total, 4).alias("sum"),
            (F.col("present") - F.col("n")).alias("unparseable_count"),
        )
    )


def date_profile(freq: Frequencies) -> DataFrame:
    present = F.col("total_rows") - F.col("missing_count")
    return freq.stats.where("inferred_type = 'date'").select(
        "pos",
        "column",
        from_ordinal(F.col("first_day")).alias("min"),
        from_ordinal(F.col("last_day")).alias("max"),
        (present - F.col("n_date")).alias("unparseable_count"),
    )


def date_formats(freq: Frequencies) -> DataFrame:
    """``(column, format, count)`` of the formats a date column shows."""
    pairs = F.array(
        *[F.struct(F.lit(s).alias("format"), F.col(f"shape_{i}").alias("count")) for i, s in enumerate(SHAPES)]
    )
    return (
        freq.stats.where("inferred_type = 'date'")
        .select("column", F.inline(F.filter(pairs, lambda x: x["count"] > 0)))
    )


def profile_columns(freq: Frequencies, sample_size: int = 5) -> DataFrame:
    """Everything about every column, one row each, in column order."""

    def gathered(rows: DataFrame, item, name: str) -> DataFrame:
        # As many rows as asked for, or TOP_VALUES, per column.
        ordered = F.array_sort(F.collect_list(F.struct("place", item.alias("item"))))
        return rows.groupBy("column").agg(F.transform(ordered, lambda x: x["item"]).alias(name))

    def packed(rows: DataFrame, name: str) -> DataFrame:
        fields = [c for c in rows.columns if c not in ("pos", "column")]
        return rows.select("column", F.struct(*fields).alias(name))

    formats = date_formats(freq).groupBy("column").agg(
        F.map_from_entries(F.collect_list(F.struct("format", "count"))).alias("formats_present")
    )
    dates = date_profile(freq).join(F.broadcast(formats), "column", "left")
    parts = [
        gathered(sample_values(freq, sample_size), F.col("value"), "sample_values"),
        packed(number_profile(freq), "number_stats"),
        packed(dates, "date_stats"),
        gathered(top_values(freq), F.struct("value", "count"), "top_values"),
    ]
    out = common_profile(freq)
    for part in parts:
        out = out.join(F.broadcast(part), "column", "left")
    return out.orderBy("pos").drop("pos")
