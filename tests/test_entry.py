import __spark_entry__ as entry_point


def test_entry_has_rows(spark):
    assert entry_point.entry(spark).count() > 0


def test_oracles_belong_to_queries():
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())
