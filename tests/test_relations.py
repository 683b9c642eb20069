"""The telemetry relations take whole tables."""

import pytest

from fleetlens.sources.adapters import relation


@pytest.mark.parametrize(("name", "table", "key"), [("processes", "orders", "pid"), ("transactions", "orders", "pid"), ("metadata_locks", "orders", "pid"), ("status_texts", "orders", "snapshot")])
def test_every_order(spark, data, name, table, key):
    ids = spark.read.parquet(f"{data}/{table}.parquet").selectExpr(f"o_orderkey as {key}")
    assert ids.exceptAll(relation(spark, data, name).select(key)).count() == 0


def test_every_customer_that_waits(spark, tmp_path):
    spark.range(2000).withColumnRenamed("id", "c_custkey").write.parquet(f"{tmp_path}/customer.parquet")
    assert relation(spark, str(tmp_path), "lock_waits").count() == 1996  # the first two of each thousand wait for none
