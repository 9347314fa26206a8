import __spark_entry__ as entry


def test_flagship_and_names(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "style_margin" in df.columns
    assert set(entry.oracle_sql()) <= set(entry.queries())
