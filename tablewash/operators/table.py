"""Names, row order and column checks shared by all operators."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewash.functions.numbers import number_of
from tablewash.functions.text import text_of

# Hidden row-order column: unique BIGINT, ascending in row order.
RID = "_rid"


def col(name: str) -> Column:
    """Column by its literal name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(df: DataFrame, name: str) -> str:
    """The name, with underscores added until the frame has no such column in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def data_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != RID]


def column_type(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def cell_text(df: DataFrame, name: str) -> Column:
    return text_of(col(name), column_type(df, name))


def cell_number(df: DataFrame, name: str) -> Column:
    return number_of(col(name), column_type(df, name))


def is_text(df: DataFrame, name: str) -> bool:
    return isinstance(column_type(df, name), T.StringType)


def require_columns(df: DataFrame, names: Iterable[str]) -> None:
    """Fail before any plan is built, naming what would have been valid."""
    valid = data_columns(df)
    for name in names:
        if name not in valid:
            raise ValueError(f'Column "{name}" does not exist. Available columns: {", ".join(valid)}')


def with_order(df: DataFrame, order_by: str | None = None) -> DataFrame:
    """Give a frame its row order.

    ``order_by`` names a unique integral column and leaves the data columns.
    Without it the order is that of the scan, which is only the order of the
    source for a single file (see ``sources.delimited`` for several).
    """
    if order_by is not None:
        if order_by not in df.columns:
            raise ValueError(f'Column "{order_by}" does not exist. Available columns: {", ".join(df.columns)}')
        rest = [col(c) for c in df.columns if c not in (order_by, RID)]
        return df.select(col(order_by).cast("bigint").alias(RID), *rest)
    if RID in df.columns:
        return df
    return df.select(F.monotonically_increasing_id().alias(RID), *[col(c) for c in df.columns])


def column_list(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column: ``pos``, ``column``. Sized by the schema."""
    schema = "pos int, column string"
    return df.sparkSession.createDataFrame(list(enumerate(columns)), schema)
