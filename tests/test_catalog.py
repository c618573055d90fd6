"""Every registered record query against its SQL, and those without SQL for rows."""

import pytest

from folioframe.plans import catalog
from tests import oracle

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, sf_dir, con, name):
    oracle.compare(QUERIES[name](spark, sf_dir), con, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf_dir, name):
    """Their rows are held against plain Python in test_without_sql, test_extraction_brute and test_error_rates_all; here they are all made."""
    df = QUERIES[name](spark, sf_dir)
    assert df.columns and len(df.collect()) > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["document_id", "n_fields", "to_review", "mean_confidence"]
