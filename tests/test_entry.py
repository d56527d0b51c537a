import __spark_entry__ as e


def test_sql_names_are_queries():
    assert set(e.oracle_sql()) <= set(e.queries())
