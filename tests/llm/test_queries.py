import pytest

import __spark_entry__
from barloom.llm import queries
from tests.compare import assert_same


def test_all_are_registered():
    names = list(__spark_entry__.queries())
    assert "pipeline" in names and [sum(name.startswith(f"op{n}_") for name in names) for n in range(1, 14)] == [1] * 13


@pytest.mark.parametrize("name", queries.oracle_sql())
def test_query_against_its_sql(spark, sql_dir, sql_duck, name):
    assert_same(queries.queries()[name](spark, sql_dir), sql_duck.execute(queries.oracle_sql()[name]))
