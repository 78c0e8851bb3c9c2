import pytest

import tests.oracle as oracle
from strandline.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, name):
    got = QUERIES[name](spark, data).toArrow()
    if name in SQL:
        expected = oracle.sql_rows(SQL[name], data)
        assert sorted(got.column_names) == sorted(expected.column_names)
        assert oracle.rows(got) == oracle.rows(expected)
    else:
        assert got.num_rows > 0
