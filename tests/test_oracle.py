"""Every query of the engine against its SQL."""

from __future__ import annotations

import oracle
import pytest

from geoloom import plans


@pytest.fixture(scope="module")
def con():
    return oracle.connect()


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, con, name):
    df = plans.QUERIES[name](spark, oracle.DATA)
    if name in plans.ORACLE_SQL:
        assert oracle.differ(df, con, plans.ORACLE_SQL[name]) is None
    else:
        assert df.columns and df.count() > 0  # what SQL can't state is held against brute force in test_units
