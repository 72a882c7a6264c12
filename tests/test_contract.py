"""Every registered query against its SQL twin on the smallest tables."""

import pytest

import catalog
import check_oracle

catalog.load_all()
NAMES = sorted(catalog.QUERIES)


@pytest.fixture(scope="module")
def connection(sf_dir):
    return check_oracle.connect(sf_dir)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, sf_dir, connection, name):
    difference, rows = check_oracle.compare(spark, connection, catalog.QUERIES[name], catalog.ORACLES.get(name), sf_dir)
    assert difference == ""
    assert rows > 0


def test_entry(spark):
    import __spark_entry__ as contract

    df = contract.entry(spark)
    assert df.columns == ["flow_id", "classification", "confidence", "attack_type"]
    assert df.count() > 0
    assert set(contract.oracle_sql()) <= set(contract.queries())
