from __future__ import annotations

import duckdb
import pytest

from tests.test_oracle import TABLES, rows_of


@pytest.fixture(scope="session")
def same_as_sql(spark, sf):
    """Check a registered corpus query against its SQL."""
    from tideway.llm.queries import ORACLES, QUERIES

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")

    def check(name):
        got, want = QUERIES[name](spark, sf).toPandas(), con.execute(ORACLES[name]).df()
        assert rows_of(got) == rows_of(want.astype(object).where(want.notna(), None))

    return check
