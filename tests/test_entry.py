import __spark_entry__ as entry


def test_registered_queries_have_sql():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) >= 50
