"""A loaded table with its recipe: the entry point of the library."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewash.operators import aggregate as agg
from tablewash.operators import issues as iss
from tablewash.operators import profile as prof
from tablewash.operators.frequency import Frequencies
from tablewash.operators.keyed_pages import KeyedPage, page_after
from tablewash.operators.query import Page, query_rows
from tablewash.operators.table import data_columns, require_columns, with_order
from tablewash.plans.autofix import suggested_fixes
from tablewash.plans.recipe import Proposal, Recipe
from tablewash.plans.summary import SummaryStore
from tablewash.sources.delimited import export_summary, read_delimited, write_delimited


class Dataset:
    """Reads are free; changes are proposals that someone approves."""

    def __init__(self, name: str, source: DataFrame):
        if not data_columns(source):
            raise ValueError("No columns found. Load a CSV or TSV with a header row.")
        self.name = name
        self.recipe = Recipe(source)
        # The summary of the source and of the table after each step.
        self._stores = [SummaryStore(source)]

    @classmethod
    def load(cls, df: DataFrame, name: str = "table", order_by: str | None = None) -> Dataset:
        return cls(name, with_order(df, order_by))

    @classmethod
    def read(cls, spark: SparkSession, path: str, name: str | None = None, **options) -> Dataset:
        return cls(name or path.rstrip("/").rsplit("/", 1)[-1], read_delimited(spark, path, **options))

    @property
    def table(self) -> DataFrame:
        return self.recipe.current

    # ---- reads

    @property
    def summary(self) -> SummaryStore:
        """The stored values of the table as it is now; nothing is scanned before something asks for a column."""
        if self._stores[-1].df is not self.table:
            self._stores.append(SummaryStore(self.table))
        return self._stores[-1]

    def frequencies(self, columns: list[str] | None = None) -> Frequencies:
        """Values and their facts, scanned once per table version and column."""
        return self.summary.frequencies(columns)

    def overview(self) -> DataFrame:
        columns = prof.column_overview(self.frequencies())
        pending = sum(p.status == "pending" for p in self.recipe.proposals)
        return columns.select(
            F.lit(self.name).alias("name"),
            F.col("total_rows").alias("row_count"),
            F.lit(len(data_columns(self.table))).alias("column_count"),
            "pos",
            "column",
            "inferred_type",
            "missing_count",
            F.lit(len(self.recipe.steps)).alias("transforms_applied"),
            F.lit(pending).alias("pending_proposals"),
        ).orderBy("pos")

    def profile(self, column: str | None = None, sample_size: int = 5) -> DataFrame:
        """One column, reading nothing else of the table, or all of them."""
        return prof.profile_columns(self.frequencies([column] if column else None), sample_size)

    def issues(self, severity: str = "all", column: str | None = None) -> DataFrame:
        if column is not None:
            require_columns(self.table, [column])
        return iss.detect_issues(self.frequencies(), severity, column)

    def query(self, **arguments: Any) -> Page:
        return query_rows(self.table, **arguments)

    def page_after(self, after: str | None = None, **arguments: Any) -> KeyedPage:
        """The page after a cursor, at the cost of a first page however far down it is."""
        return page_after(self.table, after, **arguments)

    def aggregate(self, **arguments: Any) -> DataFrame:
        return agg.aggregate(self.table, **arguments)

    def group_total(self, group_by: list[str]) -> DataFrame:
        return agg.group_total(self.table, group_by)

    def chart(self, group_by: str, metric: dict, **arguments: Any) -> DataFrame:
        return agg.chart_series(self.table, group_by, metric, **arguments)

    # ---- changes

    def propose(self, op: str, params: dict | str | None = None, rationale: str | None = None) -> Proposal:
        return self.recipe.propose(op, params, rationale)

    def approve(self, proposal_id: str) -> Proposal:
        before = self.summary
        p = self.recipe.approve(proposal_id)
        if p.status == "approved":
            self._stores.append(before.after(p.step, self.table))
        return p

    def reject(self, proposal_id: str, note: str | None = None) -> Proposal:
        return self.recipe.reject(proposal_id, note)

    def undo(self):
        step = self.recipe.undo()
        self._return_to(self.table)
        return step

    def reset(self) -> None:
        self.recipe.reset()
        self._return_to(self.table)

    def _return_to(self, table: DataFrame) -> None:
        """Go back to the store of an earlier version; what no version uses any more is deleted."""
        known = next((s for s in self._stores if s.df is table), None) or SummaryStore(table)
        left = self._stores[: self._stores.index(known)] + [known] if known in self._stores else [known]
        used = set().union(*(s.folders() for s in left))
        for store in self._stores:
            if store not in left:
                store.remove(used)
        self._stores = left

    def close(self) -> None:
        """Delete the stored summaries; fixes that name a stored mapping need them until then."""
        for store in self._stores:
            store.remove()
        self._stores = [SummaryStore(self.table)]

    def apply_fixes(self, kinds: list[str] | None = None) -> list[Proposal]:
        """Apply the suggested fixes of the issues present now."""
        fixes = suggested_fixes(self.issues(), kinds)
        return [self._apply(f["op"], f["params"], "suggested fix") for f in fixes]

    def _apply(self, op: str, params: dict, rationale: str) -> Proposal:
        """Propose and approve in one go; what fails raises."""
        p = self.approve(self.propose(op, params, rationale).id)
        if p.status == "failed":
            raise ValueError(p.error)
        return p

    # ---- sink

    def export_name(self, filename: str | None = None) -> str:
        return filename or re.sub(r"\.[^.]+$", "", self.name) + "_clean.csv"

    def export(self, folder: str, filename: str | None = None) -> DataFrame:
        """Write the table as CSV parts and describe them."""
        name = self.export_name(filename)
        write_delimited(self.table, f"{folder.rstrip('/')}/{name}")
        return export_summary(self.table, name)
