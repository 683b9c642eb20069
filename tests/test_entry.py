"""The driver's contract."""

import __spark_entry__


def test_names_agree():
    queries, oracles = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 100


def test_flagship(spark):
    got = __spark_entry__.entry(spark)
    assert got.count() > 0 and {"server_id", "digest", "aas", "rank"} <= set(got.columns)
