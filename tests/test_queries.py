"""Every registered query at the smallest scale: against its SQL where there is some, else for rows."""

import os

import pytest
from check_queries import connect, difference

from vicinity.plans import catalog

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
# Scales this small leave some reports empty.
MAY_BE_EMPTY = {"imbalance_clusters", "transit_gap", "match_aliases", "match_reverse_audit", "match_missing_lot", "match_alias_report", "match_same_lot"}


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, FOLDER)
    if name in catalog.ORACLES:
        assert difference(df, duck, catalog.ORACLES[name]) is None
    elif name in MAY_BE_EMPTY:
        df.count()
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 10
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
