"""The fifteen transforms. Each is a pure function of a frame and parameters.

A transform returns a ``Step``: what becomes of each row and cell, still
lazy. ``Step.result`` is the new table; ``diff`` reads the same step, so most
before/after comparisons are one projection over one scan and no join.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewash.functions.booleans import coerce_boolean
from tablewash.functions.compare import holds, literal_text
from tablewash.functions.dates import coerce_date
from tablewash.functions.numbers import coerce_number
from tablewash.functions.text import is_blank, num_text, strip
from tablewash.operators.fill import with_value_above
from tablewash.operators.frequency import Frequencies, settled
from tablewash.operators.issues import VARIANTS_MAPPING, category_mapping, row_keys, stored_mapping
from tablewash.operators.quantile import exact_quantiles
from tablewash.operators.membership import is_long, marked_in
from tablewash.operators.query import condition, in_order
from tablewash.operators.sums import exact_totals
from tablewash.operators.table import RID, cell_number, cell_text, col, data_columns, fresh, is_text, require_columns
from tablewash.plans.artifacts import facts_of, is_reference, load_reference

# A mapping handed over as parameters is broadcast up to this many characters.
_MAP_BROADCAST_CHARS = 32_000_000
_NULL_BITS = 62


@dataclass
class Step:
    """What one transform does to a table."""

    op: str
    params: dict[str, Any]
    summary: str
    before: DataFrame
    # Holds every column of ``before`` and any helper columns.
    frame: DataFrame
    cells: dict[str, Column] = field(default_factory=dict)
    adds: dict[str, Column] = field(default_factory=dict)
    renames: dict[str, str] = field(default_factory=dict)
    drops: list[str] = field(default_factory=list)
    keep: Column | None = None
    # Whether a row holds a non-blank cell that the new type cannot hold.
    unparseable: Column | None = None
    # Set where rows are merged or reordered instead of rewritten in place.
    replaced_by: DataFrame | None = None
    merged_by: list[Column] | None = None

    @property
    def result(self) -> DataFrame:
        if self.replaced_by is not None:
            return self.replaced_by
        frame = self.frame if self.keep is None else self.frame.where(self.keep)
        kept = []
        for c in data_columns(self.before):
            if c in self.adds:
                kept.append(self.adds[c].alias(c))
            elif c not in self.drops:
                kept.append(self.cells.get(c, col(c)).alias(self.renames.get(c, c)))
        new = [v.alias(c) for c, v in self.adds.items() if c not in self.before.columns]
        return frame.select(col(RID), *kept, *new)


def _step(op: str, params: dict, df: DataFrame, summary: str, **what) -> Step:
    what.setdefault("frame", df)
    return Step(op=op, params=params, summary=summary, before=df, **what)


def _required(params: dict, *names: str) -> list[Any]:
    for name in names:
        if params.get(name) is None:
            raise ValueError(f'Parameter "{name}" is required.')
    return [params[n] for n in names]


def _one_of(name: str, value: Any, valid: tuple[str, ...]) -> Any:
    if value not in valid:
        raise ValueError(f'Unknown {name} "{value}". Use {", ".join(valid)}.')
    return value


def trim_whitespace(df: DataFrame, params: dict) -> Step:
    """Trim one column or all; what is empty then becomes null."""
    column = params.get("column")
    if column:
        require_columns(df, [column])
    chosen = [c for c in ([column] if column else data_columns(df)) if is_text(df, c)]
    cells = {c: F.nullif(strip(col(c)), F.lit("")) for c in chosen}
    where = f'"{column}"' if column else "all columns"
    return _step("trim_whitespace", params, df, f"Trim whitespace in {where}", cells=cells)


def normalize_case(df: DataFrame, params: dict) -> Step:
    column, mode = _required(params, "column", "mode")
    require_columns(df, [column])
    fold = {"lower": F.lower, "upper": F.upper, "title": F.initcap}[
        _one_of("mode", mode, ("lower", "upper", "title"))
    ]
    cells = {column: fold(col(column))} if is_text(df, column) else {}
    return _step("normalize_case", params, df, f'Change "{column}" to {mode} case', cells=cells)


def _retyped(op: str, df: DataFrame, params: dict, parsed: Column, kept_as: Callable, summary: str) -> Step:
    """A cell the target type cannot hold becomes null and is counted, or,
    with ``on_unparseable='keep'``, stays as text in a text column."""
    column = params["column"]
    mode = _one_of("on_unparseable", params.get("on_unparseable", "null"), ("null", "keep"))
    helper = fresh(df, "_parsed")
    text, new = cell_text(df, column), col(helper)
    # A column of its own, so that its several readers share one parse.
    frame = df.select("*", parsed.alias(helper))
    lost = ~is_blank(text) & new.isNull()
    if mode == "keep":
        new = F.coalesce(kept_as(new), text)
    return _step(op, params, df, summary, frame=frame, cells={column: new}, unparseable=lost)


def parse_numbers(df: DataFrame, params: dict) -> Step:
    (column,) = _required(params, "column")
    require_columns(df, [column])
    number = cell_number(df, column)
    return _retyped("parse_numbers", df, params, number, num_text, f'Parse "{column}" as numbers')


def parse_dates(df: DataFrame, params: dict) -> Step:
    (column,) = _required(params, "column")
    require_columns(df, [column])
    iso = coerce_date(cell_text(df, column), bool(params.get("day_first", False)))
    return _retyped("parse_dates", df, params, iso, lambda x: x, f'Parse "{column}" as dates (yyyy-mm-dd)')


def _mode(df: DataFrame, column: str) -> Column:
    """Most frequent non-blank text, ties by first row, as a scalar subquery."""
    text = cell_text(df, column)
    counts = (
        df.select(text.alias("value"), col(RID))
        .where(~is_blank(F.col("value")))
        .groupBy("value")
        .agg(F.count(F.lit(1)).alias("cnt"), F.min(RID).alias("first_rid"))
    )
    return counts.orderBy(F.desc("cnt"), "first_rid").limit(1).select("value").scalar()


def median_of(numbers: DataFrame) -> DataFrame:
    """One row at most, from the numbers of one column."""
    grouped = numbers.groupBy("num").agg(F.count(F.lit(1)).alias("cnt"))
    counts = settled(grouped, ["num"], F.col("cnt") > 0).where("num is not null")
    one_column = counts.select(F.when(F.col("cnt") > 0, "").alias("column"), "num", "cnt")
    return exact_quantiles(one_column, [0.5]).select("value")


def mean_of(numbers: DataFrame) -> DataFrame:
    """One row at most: the mean to 4 decimals of the numbers of one column, from their exact sum."""
    return exact_totals(numbers, [], F.col("num")).select(F.round(F.col("total") / F.col("n"), 4).alias("value"))


_STRATEGIES = ("constant", "mean", "median", "mode", "forward")


def fill_missing(df: DataFrame, params: dict) -> Step:
    column, strategy = _required(params, "column", "strategy")
    require_columns(df, [column])
    _one_of("strategy", strategy, _STRATEGIES)
    text, numeric = cell_text(df, column), not is_text(df, column)
    blank, frame, as_is = is_blank(text), df, col(column)
    if strategy == "constant":
        (value,) = _required(params, "value")
        fill = literal_text(value)
        if numeric:
            if isinstance(value, (int, float)) and not isinstance(value, bool):
                fill, as_is = F.lit(float(value)), col(column).cast("double")
            else:
                as_is = text
    elif strategy in ("mean", "median"):
        numbers = df.select(cell_number(df, column).alias("num"))
        one = mean_of(numbers) if strategy == "mean" else median_of(numbers)
        fill = one.select("value" if numeric else num_text(F.col("value"))).scalar()
        as_is = col(column).cast("double") if numeric else as_is
    elif strategy == "mode":
        fill, as_is = _mode(df, column), text
        if numeric:
            fill, as_is = coerce_number(fill), col(column).cast("double")
    else:
        helper = fresh(df, "_above")
        frame = with_value_above(df, F.when(~blank, col(column)), helper)
        fill = col(helper)
    # A blank that nothing fills keeps its text.
    cells = {column: F.when(blank, F.coalesce(fill, as_is)).otherwise(as_is)}
    return _step("fill_missing", params, df, f'Fill blanks in "{column}" ({strategy})', frame=frame, cells=cells)


def _plain_text(value: Any) -> str | None:
    """Text of a parameter that is not a number."""
    if value is None or (isinstance(value, (int, float)) and not isinstance(value, bool)):
        return None
    return ("true" if value else "false") if isinstance(value, bool) else str(value)


def unique_variants(mapping: DataFrame) -> DataFrame:
    """A variant listed twice takes the smaller text, null first."""
    return mapping.groupBy("variant").agg(F.min(F.struct("canonical")).alias("c")).select("variant", "c.canonical")


def frames_of(df: DataFrame, op: str, params: dict) -> dict:
    """The parameters with a mapping that detection stored as the frame it names."""
    if op == "map_values" and params.get("mapping") == VARIANTS_MAPPING and params.get("table"):
        found = stored_mapping(df.sparkSession.read.parquet(params["table"]), params["column"])
        return {k: found if k == "mapping" else v for k, v in params.items() if k != "table"}
    return params


def map_values(df: DataFrame, params: dict) -> Step:
    """Replace exact texts. The mapping is a dict, a frame ``(variant,
    canonical)``, a reference to a stored one, or the name of the one detection
    finds, with the ``table`` it was stored in; without one it is found anew."""
    column, mapping = _required(params, "column", "mapping")
    require_columns(df, [column])
    text = cell_text(df, column)
    if is_reference(mapping):
        lookup = unique_variants(load_reference(df.sparkSession, mapping))
        # Its size is known: below the bound no row of the table is shuffled.
        if facts_of(mapping)["chars"] <= _MAP_BROADCAST_CHARS:
            lookup = F.broadcast(lookup)
    elif isinstance(mapping, dict):
        # Numbers become text by the rules for cells, whatever the mapping's size.
        rows = [
            (str(k), float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else None, _plain_text(v))
            for k, v in mapping.items()
        ]
        given = df.sparkSession.createDataFrame(rows, "variant string, number double, plain string")
        lookup = given.select("variant", F.coalesce(num_text(F.col("number")), "plain").alias("canonical"))
        if sum(len(k) + len(v or "") for k, _, v in rows) <= _MAP_BROADCAST_CHARS:
            lookup = F.broadcast(lookup)
        params = {**params, "mapping": dict(mapping)}
    elif isinstance(mapping, DataFrame):
        lookup = unique_variants(mapping)
        params = {**params, "mapping": "table"}
    elif mapping == VARIANTS_MAPPING and params.get("table"):
        # What detection stored, whatever has become of the column since.
        lookup = stored_mapping(df.sparkSession.read.parquet(params["table"]), column)
    elif mapping == VARIANTS_MAPPING:
        values = Frequencies(df, [column]).present
        lookup = category_mapping(values).select("variant", "canonical")
    else:
        raise ValueError('Parameter "mapping" must be an object of from: to.')
    # Without a hint Spark broadcasts the lookup if its measured size allows.
    variant, found = fresh(df, "_variant"), fresh(df, "_mapped")
    lookup = lookup.select(F.col("variant").alias(variant), F.struct("canonical").alias(found))
    frame = df.join(lookup, text == col(variant), "left")
    mapped = F.when(col(found).isNotNull(), col(found)["canonical"]).otherwise(text)
    return _step("map_values", params, df, f'Map values of "{column}"', frame=frame, cells={column: mapped})


def rename_column(df: DataFrame, params: dict) -> Step:
    column, to = _required(params, "column", "to")
    require_columns(df, [column])
    if to != column and to in df.columns:
        raise ValueError(f'Column "{to}" already exists.')
    return _step("rename_column", params, df, f'Rename "{column}" to "{to}"', renames={column: to})


def drop_column(df: DataFrame, params: dict) -> Step:
    columns = list(params.get("columns") or _required(params, "column"))
    require_columns(df, columns)
    return _step("drop_column", params, df, f"Drop {', '.join(columns)}", drops=columns)


def _rows_where(df: DataFrame, params: dict) -> tuple[DataFrame, Column, str]:
    column = _required(params, "column")[0]
    operator, value = params.get("operator") or "eq", params.get("value", "")
    if is_reference(value):
        value = load_reference(df.sparkSession, value)
    if operator == "in" and is_long(value):
        frame, met = marked_in(df, column, value)
        size = "a table" if isinstance(value, DataFrame) else f"{len(value)} values"
        return frame, met, f"{column} in {size}"
    return df, condition(df, column, operator, params.get("value")), f"{column} {operator} {value}".strip()


def drop_rows_where(df: DataFrame, params: dict) -> Step:
    frame, met, words = _rows_where(df, params)
    return _step("drop_rows_where", params, df, f"Drop rows where {words}", frame=frame, keep=~holds(met))


def keep_rows_where(df: DataFrame, params: dict) -> Step:
    frame, met, words = _rows_where(df, params)
    return _step("keep_rows_where", params, df, f"Keep rows where {words}", frame=frame, keep=met)


def deduplicate(df: DataFrame, params: dict) -> Step:
    """Keep the first of equal rows, on all columns or some."""
    every = data_columns(df)
    columns = list(params.get("columns") or every)
    require_columns(df, columns)
    keys = row_keys(df, columns)
    result = _first_whole_rows(df, every) if set(columns) == set(every) else _first_rows(df, keys, every)
    on = "all columns" if columns == every else ", ".join(columns)
    return _step("deduplicate", params, df, f"Remove duplicate rows on {on}", replaced_by=result, merged_by=keys)


def _first_whole_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """The key is the row, so integers are all there is to aggregate.

    Keys equate null with ``''``; bit masks remember which one came first.
    """
    keys = row_keys(df, columns)
    texts = [i for i, c in enumerate(columns) if is_text(df, c)]
    chunks = [texts[i : i + _NULL_BITS] for i in range(0, len(texts), _NULL_BITS)]
    masks = [
        sum(
            (F.when(col(columns[i]).isNull(), F.lit(1 << bit)).otherwise(F.lit(0)) for bit, i in enumerate(chunk)),
            F.lit(0).cast("bigint"),
        )
        for chunk in chunks
    ]
    first = [F.min_by(mask, col(RID)).alias(f"_n{j}") for j, mask in enumerate(masks)]
    groups = df.groupBy(*keys).agg(F.min(RID).alias(RID), *first)
    was_null = {
        i: F.col(f"_n{j}").bitwiseAND(F.lit(1 << bit)) != 0
        for j, chunk in enumerate(chunks)
        for bit, i in enumerate(chunk)
    }

    def cell(i: int) -> Column:
        key = F.col(f"_k{i}")
        return F.when(~was_null[i], key) if i in was_null else key

    return groups.select(RID, *[cell(i).alias(c) for i, c in enumerate(columns)])


def _first_rows(df: DataFrame, keys: list[Column], columns: list[str]) -> DataFrame:
    """One best row per task and key crosses the shuffle."""
    row = F.min_by(F.struct(*[col(c).alias(f"_c{i}") for i, c in enumerate(columns)]), RID)
    groups = df.groupBy(*keys).agg(F.min(RID).alias(RID), row.alias("_row"))
    return groups.select(RID, *[F.col(f"_row._c{i}").alias(c) for i, c in enumerate(columns)])


def split_column(df: DataFrame, params: dict) -> Step:
    """Split on literal text; the last target keeps the remainder."""
    column, delimiter, into = _required(params, "column", "delimiter", "into")
    require_columns(df, [column])
    if not into or not delimiter:
        raise ValueError('Parameters "delimiter" and "into" must not be empty.')
    quoted = "\\Q" + delimiter.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    parts = F.split(cell_text(df, column), quoted, len(into))
    adds = {name: F.get(parts, F.lit(i)) for i, name in enumerate(into)}
    return _step("split_column", params, df, f'Split "{column}" into {", ".join(into)}', adds=adds)


_OPERATIONS = ("add", "subtract", "multiply", "divide", "concat")


def derive_column(df: DataFrame, params: dict) -> Step:
    name, sources, operation = _required(params, "name", "from", "operation")
    require_columns(df, sources)
    _one_of("operation", operation, _OPERATIONS)
    if operation == "concat":
        separator = params.get("separator")
        new = F.concat_ws(" " if separator is None else separator, *[cell_text(df, c) for c in sources])
    else:
        fold: dict[str, Callable[[Column, Column], Column]] = {
            "add": lambda a, b: a + b,
            "subtract": lambda a, b: a - b,
            "multiply": lambda a, b: a * b,
            "divide": F.try_divide,
        }
        numbers = [cell_number(df, c) for c in sources]
        new = numbers[0]
        for number in numbers[1:]:
            new = fold[operation](new, number)
    return _step("derive_column", params, df, f'Derive "{name}" ({operation})', adds={name: new})


_TYPES = ("number", "string", "date", "boolean")


def coerce_type(df: DataFrame, params: dict) -> Step:
    column, kind = _required(params, "column", "type")
    require_columns(df, [column])
    _one_of("type", kind, _TYPES)
    text = cell_text(df, column)
    if kind == "string":
        return _step("coerce_type", params, df, f'Coerce "{column}" to string', cells={column: text})
    parsed = {
        "number": lambda: cell_number(df, column),
        "date": lambda: coerce_date(text).try_cast("date"),
        "boolean": lambda: coerce_boolean(text),
    }[kind]()
    kept_as = num_text if kind == "number" else lambda x: x.cast("string")
    return _retyped("coerce_type", df, params, parsed, kept_as, f'Coerce "{column}" to {kind}')


def sort_rows(df: DataFrame, params: dict) -> Step:
    """Sort; the new order becomes the row order.

    Range partitioned, so ids rise from task to task. Save or checkpoint the
    result before using it more than once: ids depend on the task layout.
    """
    _required(params, "column")
    ordered = in_order(df, params).select(
        F.monotonically_increasing_id().alias(RID), *[col(c) for c in data_columns(df)]
    )
    words = f'"{params["column"]}" {params.get("direction") or "asc"}'
    return _step("sort_rows", params, df, f"Sort rows by {words}", replaced_by=ordered)


OPS: dict[str, Callable[[DataFrame, dict], Step]] = {
    f.__name__: f
    for f in (
        trim_whitespace,
        normalize_case,
        parse_numbers,
        parse_dates,
        fill_missing,
        map_values,
        rename_column,
        drop_column,
        drop_rows_where,
        keep_rows_where,
        deduplicate,
        split_column,
        derive_column,
        coerce_type,
        sort_rows,
    )
}


def plan_step(df: DataFrame, op: str, params: dict | str | None = None) -> Step:
    """Validate an operation and describe what it does to a table."""
    if op not in OPS:
        raise ValueError(f'Unknown operation "{op}". Available: {", ".join(OPS)}.')
    if isinstance(params, str):
        params = json.loads(params)
    return OPS[op](df, dict(params or {}))


def apply_op(df: DataFrame, op: str, params: dict | str | None = None) -> DataFrame:
    return plan_step(df, op, params).result
