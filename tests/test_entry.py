import __spark_entry__


def test_queries_and_sql_have_matching_names():
    names = set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= names
