import __spark_entry__ as entry


def test_entry_has_rows_and_names(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert "ndcg10_exp" in df.columns


def test_oracles_are_of_known_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
