"""Every core query against its SQL on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import oracle
import pytest

from skillweave import queries, stage_queries

QUERIES, SQL = queries.QUERIES | stage_queries.QUERIES, queries.SQL | stage_queries.SQL


@pytest.mark.skipif(not Path(oracle.SMALL).is_dir(), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(SQL))
def test_like_sql(spark, name):
    pytest.importorskip("duckdb")
    oracle.compare(spark, QUERIES[name], SQL[name])
