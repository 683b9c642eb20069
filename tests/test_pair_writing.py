"""Pairs are dealt out over a fixed number of partitions, and in an order in which written files stay small."""

import os

from fleetlens.operators import issues, pairs
from fleetlens.queries import QUERIES


def test_a_constant_key_column_deals_nothing_out_again(spark, data):
    """The test tables have one schema; with it as a column of the key the planner shuffled once more, to few partitions."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = QUERIES["mdl_blocker_pairs"](spark, data).rdd.getNumPartitions()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got >= 8 * int(spark.conf.get("spark.sql.shuffle.partitions")) / 2


def test_written_pairs_repeat(spark, tmp_path):
    """1,200 statements and 4,800 DDL statements of one database: 5,760,000 pairs, under a third of a byte each."""
    wait = issues.METADATA_WAIT
    procs = spark.range(6000).selectExpr("CAST(1 AS BIGINT) AS server_id", "TIMESTAMP '2024-01-01' AS snapshot_ts", "id * 7 AS pid", "'u' AS user_name", "'h' AS host", "'d' AS db", "'Query' AS command", "id % 60 AS time_s", f"'{wait}' AS state", "CASE WHEN id % 5 = 0 THEN 'SELECT 1' ELSE 'ALTER TABLE t' END AS info")
    found = issues.dml_ddl_pairs(procs).select("server_id", "snapshot_ts", "blocked_pid", "ddl_pid")
    found.write.parquet(str(tmp_path / "pairs"))
    assert spark.read.parquet(str(tmp_path / "pairs")).distinct().count() == 1200 * 4800
    assert sum(f.stat().st_size for f in os.scandir(tmp_path / "pairs")) < 1200 * 4800 / 3
