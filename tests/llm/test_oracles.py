import pytest

from folioframe.llm import queries
from tests import oracle


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, sf_dir, name):
    assert oracle.compare(queries.queries()[name](spark, sf_dir), oracle.connect(sf_dir), queries.oracle_sql()[name]) > 0
