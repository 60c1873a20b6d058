import pytest

from gridloom.llm import queries
from tests.compare import connect, same

SF = "/root/testdata/sf0.001"
SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    same(queries.queries()[name](spark, SF), connect(SF), SQL[name])


def test_all_ten_are_there():
    assert [n.split("_")[0] for n in queries.queries()] == [f"op{i}" for i in range(1, 11)]
