"""Value frequencies: the one grouping that profiling and detection share.

``vf(column, value, cnt, first_rid)`` costs one shuffle for all columns. Map-side
aggregation shrinks hot values before it, so a value that fills a third of
the table travels once per task. Cell functions then run per distinct value.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewash.functions.booleans import boolean_like
from tablewash.functions.dates import SHAPES, coerce_date, date_ordinal, date_shape
from tablewash.functions.numbers import CURRENCY_SIGNS, coerce_number, formatted_number
from tablewash.functions.text import is_blank, norm_key, strip
from tablewash.operators.table import RID, cell_text, col, column_list, data_columns, require_columns


def settled(grouped: DataFrame, keys: list[str], always: Column) -> DataFrame:
    """Tie grouping keys to the aggregates by a condition that always holds.

    Spark would push each reader's filters on the keys below the grouping, run
    the cell functions per row and shuffle once per reader. Tied to the
    aggregates, the filters stay above and all readers reuse one exchange.
    """
    tied = [F.when(always, F.col(c)).alias(c) if c in keys else F.col(c) for c in grouped.columns]
    return grouped.where(always).select(*tied)


_VALUES = ("column", "value", "cnt", "first_rid")


def value_facts(vf: DataFrame) -> DataFrame:
    """What the cell functions say about every distinct value, once."""
    value = F.col("value")
    # The long chain of date layouts runs for few values. Inside a lambda it stays out of the generated
    # method, which with it is too large for the JVM to compile: every value then takes three times as long.
    day = F.get(F.transform(F.array(value), lambda x: date_ordinal(coerce_date(x))), F.lit(0))
    # Nothing parses a blank, so the parsers need no "if present" around them.
    return vf.select(
        *_VALUES,
        (~is_blank(value)).alias("present"),
        (value != strip(value)).alias("padded"),
        day.alias("day"),
        date_shape(strip(value)).alias("shape"),
        coerce_number(value).alias("num"),
        formatted_number(strip(value)).alias("laid_out"),
        boolean_like(value).alias("truth"),
        value.rlike(f"[{CURRENCY_SIGNS},%()]").alias("marked"),
        F.xxhash64(norm_key(value)).alias("key_hash"),
    )


def not_alone() -> Column:
    """Whether a value may stand in two rows; null and ``''`` count as one value."""
    return (F.col("cnt") > 1) | (F.coalesce("value", F.lit("")) == "")


class Frequencies:
    """Lazy frames derived from one table version; nothing runs until asked."""

    def __init__(
        self,
        df: DataFrame,
        columns: list[str] | None = None,
        kinds: dict[str, str] | None = None,
        facts: DataFrame | None = None,
        stats: DataFrame | None = None,
    ):
        """``kinds`` are inferred types the caller already holds for this table.

        With them, typed operators read just the columns of their type.
        ``facts`` are the values of these columns as a summary store holds them;
        then the table itself is not read. ``stats`` are what it holds per column.
        """
        self.columns = list(columns) if columns else data_columns(df)
        self.kinds = kinds
        require_columns(df, self.columns)
        self.df = df
        self._stats = stats
        self.kept = facts is not None
        # Where a store keeps the values of each column, and in how many rows one stands that may stand in another.
        self.tables: dict[str, str] = {}
        self.not_alone: dict[str, int] = {}
        self.total_rows: int | None = None
        if facts is not None:
            self.facts, self.vf = facts, facts.select(*_VALUES)
            return
        # Not unpivot: its output repeats the attribute of the row id, which
        # keeps Spark from seeing that copies of this plan are the same.
        pairs = [x for c in self.columns for x in (F.lit(c), cell_text(df, c))]
        cells = df.select(RID, F.stack(F.lit(len(self.columns)), *pairs).alias("column", "value"))
        grouped = cells.groupBy("column", "value").agg(
            F.count(F.lit(1)).alias("cnt"), F.min(RID).alias("first_rid")
        )
        self.vf = settled(grouped, ["column", "value"], (F.col("cnt") > 0) & F.col("first_rid").isNotNull())
        self.facts = value_facts(self.vf)

    @property
    def present(self) -> DataFrame:
        return self.facts.where("present").select(*_VALUES)

    def of_type(self, *wanted: str) -> DataFrame:
        """Non-blank values of the columns of some inferred types."""
        return self.typed(*wanted).select(*_VALUES)

    def typed(self, *wanted: str) -> DataFrame:
        """The same with their facts."""
        if self.kinds is not None:
            chosen = [c for c in self.columns if self.kinds[c] in wanted]
            if not chosen:
                return self.facts.where("present").limit(0)
            if self.kept:
                return self.facts.where(F.col("present") & F.col("column").isin(*chosen))
            return Frequencies(self.df, chosen).facts.where("present")
        # The counts settle all but "boolean?", which is boolean or string.
        by_counts = "boolean?" in wanted or not {"string", "boolean"} & set(wanted)
        settled, name = (self._counted, "leading") if by_counts else (self.stats, "inferred_type")
        chosen = settled.where(F.col(name).isin(*wanted)).select("column")
        # One row per column of the schema, hence the broadcast.
        return self.facts.where("present").join(F.broadcast(chosen), "column")

    @property
    def stats(self) -> DataFrame:
        """One row per column: counts, inferred type, date facts.

        Sums and integer extremes only, so it stays a hash aggregation.
        """
        if self._stats is None:
            self._stats = self.with_types(self._counted)
        return self._stats

    @cached_property
    def _counted(self) -> DataFrame:
        return self.counts()

    def counts(self) -> DataFrame:
        cnt, facts = F.col("cnt"), self.facts

        def rows(condition):
            return F.coalesce(F.sum(F.when(condition, cnt)), F.lit(0))

        present = F.col("present")
        shapes = [rows(F.col("shape") == s).alias(f"shape_{i}") for i, s in enumerate(SHAPES)]
        first_seen = [
            F.min(F.when(F.col("shape") == s, F.col("first_rid"))).alias(f"shape_{i}_rid")
            for i, s in enumerate(SHAPES)
        ]
        counts = facts.groupBy("column").agg(
            F.sum("cnt").alias("total_rows"),
            rows(~present).alias("missing_count"),
            F.sum(F.when(present, 1).otherwise(0)).alias("distinct_count"),
            rows(F.col("day").isNotNull()).alias("n_date"),
            rows(F.col("num").isNotNull() & F.col("laid_out")).alias("n_number"),
            rows(F.col("num").isNotNull()).alias("n_parsed"),
            rows(present & F.col("truth")).alias("n_boolean"),
            rows(present & F.col("padded")).alias("n_padded"),
            rows(present & F.col("marked")).alias("n_formatted"),
            rows(not_alone()).alias("n_not_alone"),
            F.min("day").alias("first_day"),
            F.max("day").alias("last_day"),
            *shapes,
            *first_seen,
        )
        n = (F.col("total_rows") - F.col("missing_count")).cast("double")

        def share(name: str) -> Column:
            return F.col(name) / n

        leading = (
            F.when(n == 0, "empty")
            .when(share("n_date") >= 0.8, "date")
            .when(share("n_number") >= 0.8, "number")
            .when((share("n_boolean") >= 0.95) & (F.col("distinct_count") <= 3), "boolean")
            .when(share("n_boolean") >= 0.95, "boolean?")
            .otherwise("string")
        )
        return counts.select("*", leading.alias("leading"))

    def with_types(self, counts: DataFrame) -> DataFrame:
        # More than three spellings may still be three words in other cases.
        # Only such columns count them; usually there is none.
        unsure = counts.where(F.col("leading") == "boolean?").select("column")
        words = (
            self.present.join(F.broadcast(unsure), "column")
            .groupBy("column")
            .agg(F.count_distinct(F.lower("value")).alias("words"))
        )
        every = column_list(self.df, self.columns)
        kind = (
            F.when(F.col("leading") == "boolean?", F.when(F.col("words") <= 3, "boolean").otherwise("string"))
            .otherwise(F.coalesce("leading", F.lit("empty")))
        )
        zero_filled = ["total_rows", "missing_count", "distinct_count", "n_not_alone"]
        return (
            every.join(F.broadcast(counts), "column", "left")
            .join(F.broadcast(words), "column", "left")
            .select("*", kind.alias("inferred_type"))
            .drop("leading", "words")
            .fillna(0, zero_filled)
        )

    @cached_property
    def numbers(self) -> DataFrame:
        """``(column, num, cnt)``: distinct numbers of the number columns."""
        parsed = self.typed("number").select("column", "num", "cnt")
        grouped = parsed.groupBy("column", "num").agg(F.sum("cnt").alias("cnt"))
        return settled(grouped, ["column", "num"], F.col("cnt") > 0).where("num is not null")
