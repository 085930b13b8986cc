"""Tables that recipes own, stored under the digest of their rows.

A step given a frame (a mapping, a list of values) keeps a reference to a
stored copy, so its parameters are JSON and replay needs no frame. The digest
names the rows in any order, equal tables are stored once, and rows and
characters are known before the table is read.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tablewash.operators.table import col
from tablewash.plans.lineage import child_names, delete_path, ensure_checkpoint_dir

# Parameters hold {_MARK: {...}} in place of a frame.
_MARK = "$artifact"


def is_reference(value: Any) -> bool:
    return isinstance(value, dict) and set(value) == {_MARK} and isinstance(value[_MARK], dict)


def facts_of(value: dict) -> dict[str, Any]:
    """``digest``, ``folder``, ``rows`` and ``chars`` of a reference."""
    return value[_MARK]


def load_reference(spark: SparkSession, value: dict) -> DataFrame:
    facts = facts_of(value)
    return spark.read.parquet(f"{facts['folder']}/{facts['digest']}")


def table_facts(df: DataFrame) -> dict[str, Any]:
    """``digest``, ``rows`` and ``chars`` in one aggregation.

    Each row's SHA-256, as four numbers of 64 bits, goes into four sums: their
    hash with names, types and row count names the multiset of rows.
    """
    names = sorted(df.columns)
    kinds = dict(df.dtypes)
    row = F.to_json(F.struct(*[col(c).alias(f"c{i}") for i, c in enumerate(names)]))
    hashed = df.select(F.length(row).alias("chars"), F.sha2(row, 256).alias("hash"))
    parts = [F.conv(F.substring("hash", 16 * i + 1, 16), 16, 10).cast("decimal(20,0)") for i in range(4)]
    sums = [F.coalesce(F.sum(p), F.lit(0)).cast("string").alias(f"s{i}") for i, p in enumerate(parts)]
    found = hashed.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("chars"), F.lit(0)).alias("chars"), *sums)
    kind = json.dumps([(c, kinds[c]) for c in names])
    named = F.sha2(F.concat_ws("|", F.lit(kind), F.col("rows").cast("string"), *[f"s{i}" for i in range(4)]), 256)
    return found.select(named.alias("digest"), "rows", "chars").first().asDict()


class ArtifactStore:
    """A folder of stored tables; by default in the shared folder of the session."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark = spark
        self.folder = (folder or f"{ensure_checkpoint_dir(spark)}/artifacts").rstrip("/")

    def put(self, df: DataFrame) -> dict:
        """Store a table unless its rows are there already; returns the reference."""
        facts = table_facts(df)
        path = f"{self.folder}/{facts['digest']}"
        if not self._holds(path, facts):
            df.write.mode("overwrite").parquet(path)
            if not self._holds(path, facts):
                raise ValueError("The table gave other rows when it was read again; store it first.")
        return {_MARK: {**facts, "folder": self.folder}}

    def _holds(self, path: str, facts: dict) -> bool:
        """Whether the whole table lies there; what a lost driver left half written does not count."""
        try:
            return table_facts(self.spark.read.parquet(path)) == facts
        except AnalysisException as failure:
            if failure.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                return False
            raise

    def own(self, params: dict[str, Any]) -> dict[str, Any]:
        """Parameters with every frame replaced by a reference."""
        return {k: self.put(v) if isinstance(v, DataFrame) else v for k, v in params.items()}

    def collect(self, recipes: Iterable[str | list[dict]]) -> list[str]:
        """Delete the stored tables that none of these recipes names; returns their digests."""
        named = set()
        for recipe in recipes:
            for spec in json.loads(recipe) if isinstance(recipe, str) else recipe:
                named |= {facts_of(v)["digest"] for v in (spec.get("params") or {}).values() if is_reference(v)}
        gone = sorted(set(child_names(self.spark, self.folder)) - named)
        for digest in gone:
            delete_path(self.spark, f"{self.folder}/{digest}")
        return gone
