"""Every registered query of the library against its DuckDB SQL."""

import pytest

from quern.plans.catalog import ORACLES, QUERIES
from tests.compare import compare, connect


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    if name in ORACLES:
        compare(df, con, ORACLES[name])
    else:
        assert df.count() > 0 and len(df.columns) == len(set(df.columns))


def test_nearly_every_query_has_sql():
    assert {n for n in QUERIES if n not in ORACLES} == {"probe_logreg"}
