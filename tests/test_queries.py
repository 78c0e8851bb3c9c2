import __spark_entry__
import pytest

import tests.oracle as oracle

QUERIES = {n: q for n, q in __spark_entry__.queries().items() if not q.__module__.startswith("strandline.llm")}
SQL = __spark_entry__.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_its_sql(spark, data, name):
    got = QUERIES[name](spark, data).toArrow()
    if name in SQL:
        expected = oracle.sql_rows(SQL[name], data)
        assert sorted(got.column_names) == sorted(expected.column_names)
        assert oracle.rows(got) == oracle.rows(expected)
    else:
        assert got.num_rows > 0


def test_entry(spark, data):
    assert __spark_entry__.entry(spark).count() > 0
