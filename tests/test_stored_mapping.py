"""The mapping of a fix is the one that detection found, whatever its size."""

import json

import pytest

from tablewash.operators import issues as iss
from tablewash.operators.frequency import Frequencies
from tablewash.operators.table import RID
from tablewash.operators.transforms import apply_op


@pytest.mark.parametrize("inline", [3, 900])
def test_a_step_before_the_fix_does_not_change_its_mapping(spark, monkeypatch, inline):
    monkeypatch.setattr(iss, "INLINE_MAPPING", inline)
    rows = [(0, "Lyon"), (1, "lyon"), (2, "LYON"), (3, "lYon"), (4, "Lyons"), (5, "Nice"), (6, "nice")]
    df = spark.createDataFrame(rows, f"{RID} bigint, x string")
    (issue,) = iss.inconsistent_categories(Frequencies(df)).collect()
    assert '"Lyon", "lyon", "LYON", "lYon"' in issue["detail"]
    # With the canonical spelling gone, a mapping found anew would be another.
    later = apply_op(df, "drop_rows_where", {"column": "x", "operator": "in", "value": ["Nice"]}).where(f"{RID} <> 0")
    fixed = apply_op(later, "map_values", json.loads(issue["params"]))
    assert sorted(tuple(r) for r in fixed.select(RID, "x").collect())[:3] == [(1, "Lyon"), (2, "Lyon"), (3, "Lyon")]
