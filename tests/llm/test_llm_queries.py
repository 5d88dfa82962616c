"""Every query of a training-data operator against its SQL on the smallest tables; those without SQL run."""

from __future__ import annotations

from pathlib import Path

import oracle
import pytest

from skillweave.llm.queries import QUERIES, SQL


@pytest.mark.skipif(not Path(oracle.SMALL).is_dir(), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_like_sql(spark, name):
    pytest.importorskip("duckdb")
    if name in SQL:
        oracle.compare(spark, QUERIES[name], SQL[name])
    else:
        assert QUERIES[name](spark, oracle.SMALL).count() >= 0
