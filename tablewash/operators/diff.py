"""Before/after comparisons, as frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewash.operators.table import RID, cell_text, col, data_columns
from tablewash.operators.transforms import Step

EXAMPLES = 20


def _column_changes(before: list[str], after: list[str]) -> list[Column]:
    def names(values: list[str]) -> Column:
        return F.array(*[F.lit(v) for v in values]).cast("array<string>")

    return [
        names([c for c in after if c not in before]).alias("columns_added"),
        names([c for c in before if c not in after]).alias("columns_removed"),
    ]


def _rewritten(step: Step) -> tuple[DataFrame, list[str]]:
    """Frame with ``_a{i}``, the new text of each rewritten column.

    Cells compare by their text: 39545 as text and as number are the same.
    """
    cells = {**step.cells, **{c: v for c, v in step.adds.items() if c in step.before.columns}}
    keep = F.lit(True) if step.keep is None else F.coalesce(step.keep, F.lit(False))
    lost = F.lit(False) if step.unparseable is None else step.unparseable
    old = [cell_text(step.before, c).alias(f"_b{i}") for i, c in enumerate(cells)]
    new = [v.alias(f"_v{i}") for i, v in enumerate(cells.values())]
    # New cells first, their text next: a text form reads its cell repeatedly.
    both = step.frame.select(RID, keep.alias("_kept"), lost.alias("_lost"), *old, *new)
    texts = [cell_text(both, f"_v{i}").alias(f"_a{i}") for i in range(len(cells))]
    kept = [c for c in both.columns if not c.startswith("_v")]
    return both.select(*kept, *texts), list(cells)


def diff_summary(step: Step) -> DataFrame:
    """One row: rows changed and removed, cells changed, values lost."""
    columns = _column_changes(data_columns(step.before), data_columns(step.result))
    none = F.lit(0).cast("bigint")
    if step.merged_by is not None:
        groups = step.before.groupBy(*step.merged_by).agg(F.count(F.lit(1)).alias("copies"))
        removed = F.coalesce(F.sum(F.col("copies") - 1), none)
        return groups.agg(
            none.alias("rows_changed"),
            removed.alias("rows_removed"),
            none.alias("cells_changed"),
            none.alias("unparseable"),
        ).select("*", *columns)
    if step.replaced_by is not None:
        # A new order changes no cell.
        names = ("rows_changed", "rows_removed", "cells_changed", "unparseable")
        return step.before.sparkSession.range(1).select(*[none.alias(n) for n in names], *columns)
    frame, cells = _rewritten(step)
    changed = [(~F.col(f"_b{i}").eqNullSafe(F.col(f"_a{i}"))).cast("bigint") for i in range(len(cells))]
    n_changed = sum(changed, F.lit(0).cast("bigint"))
    kept = F.col("_kept")

    def total(c: Column) -> Column:
        return F.coalesce(F.sum(c), none)

    return (
        frame.select("_kept", "_lost", n_changed.alias("_n"))
        .agg(
            total((kept & (F.col("_n") > 0)).cast("bigint")).alias("rows_changed"),
            total((~kept).cast("bigint")).alias("rows_removed"),
            total(F.when(kept, F.col("_n"))).alias("cells_changed"),
            total(F.col("_lost").cast("bigint")).alias("unparseable"),
        )
        .select("*", *columns)
    )


def diff_examples(step: Step, limit: int = EXAMPLES) -> DataFrame:
    """First changed cells by row and column: ``(row, column, before, after)``."""
    schema_only = step.before.select(col(RID).alias("row")).limit(0)
    if step.replaced_by is not None:
        blank = F.lit(None).cast("string")
        return schema_only.select("row", blank.alias("column"), blank.alias("before"), blank.alias("after"))
    frame, cells = _rewritten(step)
    order = data_columns(step.before)
    entries = [
        F.struct(
            F.lit(order.index(c)).alias("pos"),
            F.lit(c).alias("column"),
            F.col(f"_b{i}").alias("before"),
            F.col(f"_a{i}").alias("after"),
        )
        for i, c in enumerate(cells)
    ]
    empty = "array<struct<pos:int,column:string,before:string,after:string>>"
    every = F.array(*entries) if entries else F.array().cast(empty)
    changed = F.filter(every, lambda x: ~x["before"].eqNullSafe(x["after"]))
    return (
        frame.where("_kept")
        .select(col(RID).alias("row"), F.inline(changed))
        .orderBy("row", "pos")
        .limit(limit)
        .select("row", "column", "before", "after")
    )


def diff_frames(before: DataFrame, after: DataFrame) -> DataFrame:
    """Summary for any two versions of a table, joined on the row id."""
    shared = [c for c in data_columns(before) if c in after.columns]

    def side(df: DataFrame, mark: str) -> DataFrame:
        texts = [cell_text(df, c).alias(f"_{mark}{i}") for i, c in enumerate(shared)]
        return df.select(RID, F.lit(True).alias(f"_in_{mark}"), *texts)

    joined = side(before, "b").join(side(after, "a"), RID, "full_outer")
    both = F.col("_in_b").isNotNull() & F.col("_in_a").isNotNull()
    changed = [(~F.col(f"_b{i}").eqNullSafe(F.col(f"_a{i}"))).cast("bigint") for i in range(len(shared))]
    n_changed = F.when(both, sum(changed, F.lit(0).cast("bigint"))).otherwise(F.lit(0))
    none = F.lit(0).cast("bigint")
    return joined.agg(
        F.coalesce(F.sum((n_changed > 0).cast("bigint")), none).alias("rows_changed"),
        F.coalesce(F.sum(F.col("_in_a").isNull().cast("bigint")), none).alias("rows_removed"),
        F.coalesce(F.sum(n_changed), none).alias("cells_changed"),
    ).select("*", *_column_changes(data_columns(before), data_columns(after)))
