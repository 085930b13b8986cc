"""Queries that return every row or group with its place, against their SQL."""

import duckdb
import pytest
from conftest import TESTDATA

from workload.oracle import ORACLES
from workload.queries import ALL, sales


@pytest.mark.parametrize("name", ["t_sort_rows_all", "q_sort_num_all", "q_sort_text_all", "a_first_seen_all"])
def test_every_row_in_its_place(spark, name):
    db = duckdb.connect()
    for table in ("orders", "customer"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{TESTDATA}/{table}.parquet'")
    found = ALL[name](spark, TESTDATA)
    wanted = db.execute(ORACLES[name])
    assert found.columns == [c[0] for c in wanted.description]
    rows = sorted(map(tuple, found.collect()))
    assert rows == sorted(wanted.fetchall())
    if name != "a_first_seen_all":
        assert len(rows) == sales(spark, TESTDATA).count() > 1000
