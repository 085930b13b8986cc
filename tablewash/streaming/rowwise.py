"""Replaying the row-wise steps of a recipe on a stream."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewash.operators.table import RID
from tablewash.operators.transforms import apply_op

# Steps that look at one row at a time. The others need the whole table.
ROWWISE = (
    "trim_whitespace", "normalize_case", "parse_numbers", "parse_dates", "map_values", "rename_column",
    "drop_column", "drop_rows_where", "keep_rows_where", "split_column", "derive_column", "coerce_type",
)


def is_rowwise(spec: dict[str, Any]) -> bool:
    params = spec.get("params") or {}
    if spec["op"] == "fill_missing":
        return params.get("strategy") == "constant"
    if spec["op"] == "map_values":
        return isinstance(params.get("mapping"), dict)
    return spec["op"] in ROWWISE


def apply_rowwise(stream: DataFrame, specs: list[dict[str, Any]]) -> DataFrame:
    """Fold row-wise steps over a streaming frame, statelessly."""
    for spec in specs:
        if not is_rowwise(spec):
            raise ValueError(f'"{spec["op"]}" needs the whole table and cannot run on a stream.')
    # A stream has no row order; the hidden id is a placeholder.
    source = stream.select(F.lit(0).cast("bigint").alias(RID), "*")
    return reduce(lambda df, s: apply_op(df, s["op"], s.get("params")), specs, source).drop(RID)
