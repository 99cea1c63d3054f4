"""Every registered query runs; those with SQL agree with it."""

from __future__ import annotations

import pytest

from quillmesh import catalog
from tests.oracle import compare, connection


@pytest.fixture(scope="module")
def con(sf_dir):
    return connection(sf_dir)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(name, spark, sf_dir, con):
    df = catalog.QUERIES[name](spark, sf_dir)
    if name in catalog.ORACLE:
        compare(df, con, catalog.ORACLE[name])
    else:
        assert df.count() > 0  # what its rows must be is asserted where its operator is tested


def test_oracles_belong_to_queries():
    assert not set(catalog.ORACLE) - set(catalog.QUERIES)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(catalog.QUERIES) <= set(entry.queries())
