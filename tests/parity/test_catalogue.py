import pytest

from gridloom import catalogue
from tests.compare import connect, same

SF = "/root/testdata/sf0.001"
SQL = catalogue.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, con, name):
    same(catalogue.queries()[name](spark, SF), con, SQL[name])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["i", "j", "v"]
    assert set(SQL) <= set(__spark_entry__.queries())
