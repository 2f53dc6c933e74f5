"""Every registered query of the library against its SQL at the smallest scale."""

import pytest

from ladderflow.plans import catalog
from tests import parity

catalog.load()
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def con():
    return parity.duck(SF)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    if name in catalog.ORACLE:
        assert parity.differences(spark, con, catalog.QUERIES[name], catalog.ORACLE[name], SF) == ""
    else:
        assert catalog.QUERIES[name](spark, SF).collect() is not None


def test_every_query_names_its_operators():
    assert all(catalog.IDS[n] for n in catalog.QUERIES)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
