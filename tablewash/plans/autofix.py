"""From detected issues to a recipe of their suggested fixes."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame

from tablewash.operators.issues import KINDS


def suggested_fixes(issues: DataFrame, kinds: list[str] | None = None) -> list[dict[str, Any]]:
    """Fixes of the chosen kinds in issue order.

    Detection yields at most one row per kind and column, and spells out only
    small mappings, so this reads a bounded list.
    """
    for kind in kinds or []:
        if kind not in KINDS:
            raise ValueError(f'Unknown issue kind "{kind}". Use {", ".join(KINDS)}.')
    chosen = issues if not kinds else issues.where(issues["kind"].isin(*kinds))
    rows = chosen.orderBy("position").select("suggested_fix.op", "suggested_fix.params").collect()
    return [{"op": r["op"], "params": json.loads(r["params"])} for r in rows]
