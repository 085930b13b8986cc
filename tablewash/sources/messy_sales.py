"""``messy_sales``: orders and customers with the usual defects planted.

The defects follow from the order key, so every scale has them in the same
shares. ``rid`` is the row order and not a data column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewash.functions.dates import MONTHS


def messy_sales(spark: SparkSession, folder: str) -> DataFrame:
    orders = spark.read.parquet(f"{folder}/orders.parquet")
    customer = spark.read.parquet(f"{folder}/customer.parquet").select("c_custkey", "c_mktsegment")
    key = F.col("o_orderkey")
    copies = F.when(key % 97 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    base = (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .select(
            key.alias("o"),
            "o_orderdate",
            F.col("c_mktsegment").alias("seg"),
            F.col("o_orderpriority").alias("prio"),
            F.floor("o_totalprice").cast("bigint").cast("string").alias("w"),
            F.explode(copies).alias("copy"),
        )
    )
    o, w, seg = F.col("o"), F.col("w"), F.col("seg")
    y, m, d = F.year("o_orderdate"), F.month("o_orderdate"), F.dayofmonth("o_orderdate")
    mm, dd = F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0")
    names = F.array(*[F.lit(x.capitalize()) for x in MONTHS])

    def spread(modulus: int, *cases):
        """Pick a case by ``o % modulus``; the last one takes the rest."""
        out = None
        for i, case in enumerate(cases[:-1]):
            out = F.when(o % modulus == i, case) if out is None else out.when(o % modulus == i, case)
        return out.otherwise(cases[-1])

    date = spread(
        4,
        F.concat_ws("-", y, mm, dd),
        F.concat_ws("/", mm, dd, y),
        F.concat_ws(".", dd, mm, y),
        F.concat_ws(" ", d, F.get(names, m - 1), y),
    )
    segment = spread(
        7,
        F.concat(F.lower(seg), F.lit(" ")),
        seg,
        F.concat(F.lit(" "), seg),
        F.concat(F.substring(seg, 1, 1), F.lower(F.substring(seg, 2, 1000))),
        seg,
    )
    priority = (
        F.when(o % 11 == 0, "N/A")
        .when(o % 13 == 0, F.lit(None))
        .when(o % 23 == 0, " null")
        .otherwise(F.col("prio"))
    )
    thousands = F.length(w) - 3
    amount = spread(
        5,
        F.concat(F.lit("$"), F.substring(w, F.lit(1), thousands), F.lit(","), F.substring(w, thousands + 1, F.lit(3))),
        F.concat(F.lit("("), w, F.lit(")")),
        F.when(o % 17 == 0, "-").otherwise(w),
        F.concat(F.lit(" "), w),
        F.when(o % 499 == 0, F.concat(w, F.lit("000"))).otherwise(w),
    )
    last_digit = (o % 10).cast("string")
    return base.select(
        (o * 2 + F.col("copy")).alias("rid"),
        F.concat(F.lit("ORD-"), o).alias("order_id"),
        F.when(o % 101 == 0, "soon").otherwise(date).alias("order_date"),
        segment.alias("segment"),
        priority.alias("priority"),
        amount.alias("amount"),
        F.when(o % 19 != 0, (o % 50 + 1).cast("string")).alias("quantity"),
        F.when(o % 2 == 0, F.concat(last_digit, F.lit("%")))
        .otherwise(F.concat(F.lit("0.0"), last_digit))
        .alias("discount"),
        F.when(o % 3 == 0, "yes").otherwise("no").alias("priority_flag"),
    )
