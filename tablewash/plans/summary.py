"""The summary store: values and their facts, kept per column of a table version.

Overview, profiles and issues read these small tables instead of the data, and
cell functions have run once per distinct value. A step that rewrites some
columns in place leaves the parts of the others valid.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from tablewash.operators.frequency import Frequencies
from tablewash.operators.table import data_columns
from tablewash.operators.transforms import Step
from tablewash.plans.lineage import delete_path, ensure_checkpoint_dir


@dataclass(frozen=True)
class _Part:
    """Where the values of a column lie, one folder holds the columns of one scan, and what they count up to."""

    folder: str
    number: int
    stats: Row


def changed_columns(step: Step) -> set[str] | None:
    """Columns of the result that a step made or rewrote; None if it touches the rows themselves."""
    if step.keep is not None or step.replaced_by is not None or step.merged_by is not None:
        return None
    return set(step.cells) | set(step.adds)


class SummaryStore:
    """Parts of the columns of one table version."""

    def __init__(self, df: DataFrame, parts: dict[str, _Part] | None = None):
        self.df = df
        self.parts = dict(parts or {})

    def after(self, step: Step, result: DataFrame) -> SummaryStore:
        """The store of the table after a step, with the parts that the step left as they were."""
        changed = changed_columns(step)
        if changed is None:
            return SummaryStore(result)
        names = {c: step.renames.get(c, c) for c in self.parts if c not in step.drops}
        left = set(data_columns(result))
        return SummaryStore(result, {n: self.parts[c] for c, n in names.items() if c not in changed and n in left})

    def build(self, columns: list[str] | None = None) -> list[str]:
        """Scan the table once for the columns that have no part yet; returns these."""
        missing = [c for c in (columns or data_columns(self.df)) if c not in self.parts]
        if missing:
            spark = self.df.sparkSession
            folder = f"{ensure_checkpoint_dir(spark)}/summary-{uuid.uuid4().hex}"
            numbers = {c: i for i, c in enumerate(missing)}
            number = F.element_at(F.create_map(*[F.lit(x) for c, i in numbers.items() for x in (c, i)]), F.col("column"))
            facts = Frequencies(self.df, missing).facts
            facts.select(number.alias("part"), "*").drop("column").write.partitionBy("part").parquet(folder)
            stats = self._stats(self._read({folder: {i: c for c, i in numbers.items()}}, missing), missing)
            self.parts |= {c: _Part(folder, i, stats[c]) for c, i in numbers.items()}
        return missing

    def _stats(self, facts: DataFrame, columns: list[str]) -> dict[str, Row]:
        """What the stored values of each column count up to, and its type: one row per column, read once."""
        found = Frequencies(self.df, columns, facts=facts)
        counts = found.counts()
        held = self.df.sparkSession.createDataFrame(counts.collect(), counts.schema)
        return {r["column"]: r for r in found.with_types(held).collect()}

    def _read(self, by_folder: dict[str, dict[int, str]], columns: list[str]) -> DataFrame:
        """The stored facts of the columns that have these numbers in these folders."""
        kinds = Frequencies(self.df, columns).facts.schema
        schema = StructType([f for f in kinds if f.name != "column"]).add("part", IntegerType())
        read = []
        for folder, held in by_folder.items():
            name = F.element_at(F.create_map(*[x for i, c in held.items() for x in (F.lit(i), F.lit(c))]), F.col("part"))
            rows = self.df.sparkSession.read.schema(schema).parquet(folder).where(F.col("part").isin(*held))
            read.append(rows.select(name.alias("column"), *[c for c in rows.columns if c != "part"]))
        return reduce(DataFrame.unionByName, read)

    def frequencies(self, columns: list[str] | None = None) -> Frequencies:
        """Frequencies of some columns or all, read from the store, which is built as far as needed."""
        columns = columns or data_columns(self.df)
        self.build(columns)
        by_folder: dict[str, dict[int, str]] = {}
        for c in columns:
            by_folder.setdefault(self.parts[c].folder, {})[self.parts[c].number] = c
        facts = self._read(by_folder, columns)
        # One row per column, so that readers scan the columns of their type only.
        rows = [self.parts[c].stats.asDict() | {"pos": i, "column": c} for i, c in enumerate(columns)]
        schema = Frequencies(self.df, columns, facts=facts).stats.schema
        stats = self.df.sparkSession.createDataFrame([tuple(r[n] for n in schema.names) for r in rows], schema)
        kinds = {r["column"]: r["inferred_type"] for r in rows}
        found = Frequencies(self.df, columns, kinds, facts, stats)
        found.total_rows = max(r["total_rows"] for r in rows)
        found.not_alone = {r["column"]: r["n_not_alone"] for r in rows}
        found.tables = {c: f"{self.parts[c].folder}/part={self.parts[c].number}" for c in columns}
        return found

    def folders(self) -> set[str]:
        return {p.folder for p in self.parts.values()}

    def remove(self, kept: set[str] = frozenset()) -> None:
        """Delete the folders that no kept store uses."""
        for folder in self.folders() - kept:
            delete_path(self.df.sparkSession, folder)
        self.parts = {c: p for c, p in self.parts.items() if p.folder in kept}
