"""Telemetry relations derived from the driver's tables, in SQL that Spark and DuckDB read alike.

Each relation is one named query; `relation` runs it on Spark and `ctes` gives the same text for an oracle."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

DIGEST_TEXTS = {
    "click": "SELECT * FROM shop.clicks WHERE id = ?",
    "view": "SELECT * FROM views WHERE u = ?",
    "error": "/* app */ UPDATE errors SET n = ?",
    "purchase": "INSERT INTO shop.purchases VALUES (?)",
    "signup": "SELECT @@version",
}
_TEXT = "CASE digest " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in DIGEST_TEXTS.items()) + " END"
_EVENTS = ("wait/io/file/sql/binlog", "wait/io/table/sql/handler", "wait/lock/table/sql/handler", "wait/synch/mutex/innodb/trx", "wait/synch/cond/sql/x", "wait/io/socket/sql/client", "idle", "wait/synch/rwlock/a", "stage/sql/x")
_EVENT = "CASE k " + " ".join(f"WHEN {i} THEN '{e}'" for i, e in enumerate(_EVENTS)) + " END"
_LOCKS = ("SHARED_READ", "SHARED_WRITE", "SHARED_UPGRADABLE", "SHARED_NO_WRITE", "SHARED_NO_READ_WRITE", "EXCLUSIVE", "SHARED_HIGH_PRIO", "SHARED_WRITE_LOW_PRIO", "INTENTION_EXCLUSIVE", "MYSTERY")
_LOCK = "CASE o_orderkey % 10 " + " ".join(f"WHEN {i} THEN '{e}'" for i, e in enumerate(_LOCKS)) + " END"
_W = "OVER (PARTITION BY server_id, {key}, b ORDER BY poll_ts)"
_BLOCK = "month(poll_ts) * 10 + CAST(floor((day(poll_ts) - 1) / 10) AS BIGINT) AS b"


def _running(column: str, key: str) -> str:
    return f"CAST(sum({column}) {_W.format(key=key)} AS DECIMAL(20,0))"


_VARS = ("Uptime", "Threads_running", "Threads_connected", "Innodb_buffer_pool_pages_dirty", "Innodb_buffer_pool_pages_total", "Innodb_buffer_pool_read_requests", "Innodb_buffer_pool_reads", "Aborted_clients")
_METRICS = ("CPUUtilization", "DatabaseConnections", "FreeableMemory", "ReadIOPS", "WriteIOPS", "ReadLatency", "WriteLatency", "DiskQueueDepth", "AuroraReplicaLag", "BufferCacheHitRatio", "Deadlocks", "VolumeBytesUsed")

RELATIONS: dict[str, str] = {
    "digest_cells": "SELECT user_id % 4 AS server_id, event_type AS digest, date_trunc('hour', ts) AS poll_ts, count(*) AS c, sum(CAST(round(value * 100) AS BIGINT)) * 10000000 AS t, sum(CAST(floor(value) AS BIGINT)) AS r, sum(CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END) AS x FROM events GROUP BY 1, 2, 3",
    "digest_blocks": f"SELECT *, {_BLOCK} FROM digest_cells",
    "digest_polls": f"""SELECT server_id, poll_ts, 'shop' AS schema_name, digest, {_TEXT} AS digest_text, {_running('c', 'digest')} AS count_star, {_running('t', 'digest')} AS sum_timer_wait, {_running('x', 'digest')} AS sum_lock_time,
        {_running('r', 'digest')} AS sum_rows_examined, {_running('c', 'digest')} AS sum_rows_sent, {_running('x', 'digest')} AS sum_no_index_used, {_running('x', 'digest')} AS sum_created_tmp_disk_tables, {_running('x', 'digest')} AS sum_sort_merge_passes FROM digest_blocks""",
    "polls": "SELECT DISTINCT server_id, 'digest' AS collector, poll_ts, c % 11 <> 0 OR x > 0 AS ok FROM (SELECT server_id, poll_ts, min(c) AS c, max(x) AS x FROM digest_cells GROUP BY 1, 2)",
    "good_polls": "SELECT DISTINCT server_id, poll_ts FROM digest_cells",
    "wait_cells": f"SELECT server_id, {_EVENT} AS event_name, poll_ts, count(*) AS c, sum(v) AS t FROM (SELECT user_id % 4 AS server_id, CAST(floor(user_id / 4) AS BIGINT) % 9 AS k, date_trunc('hour', ts) AS poll_ts, CAST(round(value * 100) AS BIGINT) * 10000000 AS v FROM events) GROUP BY 1, 2, 3",
    "wait_blocks": f"SELECT *, {_BLOCK} FROM wait_cells",
    "wait_polls": f"SELECT server_id, poll_ts, event_name, {_running('c', 'event_name')} AS count_star, {_running('t', 'event_name')} AS sum_timer_wait FROM wait_blocks",
    "session_ticks": """SELECT user_id % 4 AS server_id, date_trunc('hour', ts) AS tick_ts, event_id AS processlist_id, 'shop' AS schema_name, event_type AS digest,
        CASE event_id % 3 WHEN 0 THEN '/* service=''checkout'',v=1 */ SELECT 1 FROM shop.carts' WHEN 1 THEN 'SELECT 2 FROM carts' ELSE '' END AS sql_text, event_id % 5 <> 0 AS executing,
        CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'idle' WHEN 2 THEN 'wait/io/file/x' ELSE 'wait/lock/table/x' END AS current_wait, CASE event_id % 2 WHEN 0 THEN 'worker' ELSE '' END AS program_name,
        CASE WHEN user_id % 10 = 0 THEN '' ELSE 'u' || CAST(user_id % 10 AS VARCHAR(10)) END AS user_name, '10.0.0.' || CAST(user_id % 7 AS VARCHAR(10)) AS host FROM events""",
    "latencies": "SELECT user_id % 4 AS server_id, event_type AS digest, date_trunc('hour', ts) AS hour, CAST(round(value * 100) AS BIGINT) * (1 + event_id % 997) AS latency_ns FROM events",
    "processes": """SELECT o_custkey % 4 AS server_id, date_trunc('year', o_orderdate) AS snapshot_ts, o_orderkey AS pid, CASE o_custkey % 9 WHEN 0 THEN 'system user' WHEN 1 THEN 'Event_Scheduler' ELSE 'app' || CAST(o_custkey % 5 AS VARCHAR(10)) END AS user_name,
        '10.0.0.' || CAST(o_custkey % 7 AS VARCHAR(10)) || ':' || CAST(o_orderkey AS VARCHAR(20)) AS host, o_orderstatus AS db, CASE o_custkey % 13 WHEN 0 THEN 'Binlog Dump' ELSE 'Query' END AS command, o_orderkey % 60 AS time_s,
        CASE WHEN o_orderkey % 6 = 0 THEN 'Waiting for table metadata lock' WHEN o_orderkey % 6 = 1 THEN 'Waiting for master to send event' ELSE 'executing' END AS state,
        CASE WHEN o_orderkey % 8 = 7 THEN '' WHEN (o_orderkey + o_custkey) % 5 = 0 THEN 'ALTER TABLE shop.t' || CAST(o_orderkey % 3 AS VARCHAR(10)) || ' ADD COLUMN x INT' ELSE 'SELECT * FROM t' || CAST(o_orderkey % 4 AS VARCHAR(10)) END AS info
        FROM orders""",
    "transactions": """SELECT o_custkey % 4 AS server_id, date_trunc('year', o_orderdate) AS snapshot_ts, o_orderkey AS pid, 'app' || CAST(o_custkey % 5 AS VARCHAR(10)) AS user_name, '10.0.0.' || CAST(o_custkey % 7 AS VARCHAR(10)) AS host, o_orderstatus AS db,
        'Query' AS command, o_orderkey % 60 AS time_s, 'executing' AS state, 'UPDATE shop.t' || CAST(o_orderkey % 3 AS VARCHAR(10)) || ' SET a = 1' AS query, CASE WHEN o_orderkey % 2 = 0 THEN 'UPDATE shop . t SET a = ?' ELSE '' END AS digest_text,
        CAST(o_orderkey AS VARCHAR(20)) AS trx_id, 'RUNNING' AS trx_state, o_orderkey % 600 AS age_s FROM orders""",
    # a snapshot has a binary tree of 999 sessions that wait, or a ring of up to 25; the first session of a tree waits for none
    "lock_waits": """SELECT s % 4 AS server_id, CAST('2024-01-01' AS TIMESTAMP) + INTERVAL '1' SECOND * s AS snapshot_ts, k AS waiting_pid, s * 1000 + CAST(floor((k % 1000) / 2) AS BIGINT) AS blocking_pid, (k * 37) % 20000 AS wait_ms, 'shop.t' || CAST(k % 3 AS VARCHAR(10)) AS lock_table, 'UPDATE t' AS waiting_query, 'DELETE t' AS blocking_query,
        'w' || CAST(k % 5 AS VARCHAR(10)) AS waiting_user, 'h1' AS waiting_host, 'b' || CAST(k % 5 AS VARCHAR(10)) AS blocking_user, 'h2' AS blocking_host FROM (SELECT c_custkey AS k, CAST(floor(c_custkey / 1000) AS BIGINT) AS s FROM customer) AS c WHERE k % 1000 >= 2""",
    "lock_rings": "SELECT s % 4 AS server_id, CAST('2024-01-01' AS TIMESTAMP) + INTERVAL '1' SECOND * s AS snapshot_ts, k AS waiting_pid, s * 25 + (3 * (k % 25) + 1) % 25 AS blocking_pid FROM (SELECT s_suppkey AS k, CAST(floor(s_suppkey / 25) AS BIGINT) AS s FROM supplier) AS c",
    "metadata_locks": f"""SELECT o_custkey % 4 AS server_id, date_trunc('year', o_orderdate) AS snapshot_ts, o_orderkey AS pid, o_orderkey + 100000 AS thread_id, 'app' AS user_name, 'h' AS host, {_LOCK} AS lock_type,
        CASE o_custkey % 5 WHEN 0 THEN 'PENDING' WHEN 4 THEN 'VICTIM' ELSE 'GRANTED' END AS lock_status, 'TABLE' AS object_type, 'shop' AS object_schema, o_orderpriority AS object_name, o_orderkey % 97 AS time_s FROM orders""",
    "plans": """SELECT p_type AS digest, p_partkey AS ts, '{"query_block":{"select_id":1,"cost_info":{"query_cost":"' || CAST(p_size AS VARCHAR(10)) || '"},"ordering_operation":{"using_filesort":' || CASE WHEN p_partkey % 4 = 0 THEN 'true' ELSE 'false' END || ',"nested_loop":[{"table":{"table_name":"' || p_brand || '","access_type":"'
        || CASE WHEN p_partkey % 3 = 0 THEN 'ALL' ELSE 'ref' END || '","rows_examined_per_scan":' || CAST(p_size * 100 AS VARCHAR(10)) || ',"rows_produced_per_join":' || CAST(p_partkey % 50 AS VARCHAR(10)) || '}},{"table":{"table_name":"dim","access_type":"eq_ref","rows_examined_per_scan":"1","rows_produced_per_join":1}}]}}}' AS plan_json FROM part""",
    "status_vars": "SELECT server_id, poll_ts, CASE k " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(_VARS)) + " END AS variable_name, CAST(max(v) AS VARCHAR(20)) AS value FROM (SELECT user_id % 4 AS server_id, date_trunc('day', ts) AS poll_ts, event_id % 8 AS k, CAST(floor(value) AS BIGINT) AS v FROM events) GROUP BY 1, 2, 3",
    "replica_rows": "SELECT s_suppkey % 4 AS server_id, s_suppkey AS poll_s, CASE WHEN s_suppkey % 5 = 0 THEN NULL WHEN s_suppkey % 2 = 0 THEN 'Yes' ELSE 'No' END AS new_io, CASE WHEN s_suppkey % 5 = 0 THEN 'YES' ELSE '' END AS old_io, CASE WHEN s_suppkey % 3 = 0 THEN 'No' ELSE 'yes' END AS new_sql, CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE CAST(s_suppkey % 45 AS VARCHAR(10)) END AS lag FROM supplier",
    "cloud_metrics": "SELECT 'db-' || CAST(user_id % 4 AS VARCHAR(10)) AS instance, user_id % 2 = 0 AS is_aurora, CASE event_id % 12 " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(_METRICS)) + " END AS metric_name, ts, event_id, value FROM events",
    "status_texts": """SELECT o_custkey % 4 AS server_id, o_orderkey AS snapshot, 'TRANSACTIONS' || chr(10) || '------------' || chr(10) || 'Trx id counter ' || CAST(o_orderkey * 10 AS VARCHAR(20)) || chr(10) || 'History list length ' || CAST(o_custkey AS VARCHAR(20)) || chr(10)
        || '---TRANSACTION 1, ACTIVE 5 sec' || chr(10) || CASE WHEN o_orderkey % 2 = 0 THEN '---TRANSACTION 2, ACTIVE 9 sec' || chr(10) || 'LOCK WAIT 2 lock struct(s)' || chr(10) ELSE '' END || '--------' || chr(10) || 'FILE I/O' || chr(10) AS status_text FROM orders""",
    "servers": """SELECT n_nationkey AS server_id, CASE n_nationkey % 4 WHEN 0 THEN '5.7.44' WHEN 1 THEN '8.0.45-aurora' WHEN 2 THEN '10.6.1-MariaDB' ELSE '8.4' END AS version,
        CASE WHEN n_nationkey % 2 = 0 THEN 'db' || CAST(n_nationkey AS VARCHAR(10)) || '.abc.us-east-1.rds.amazonaws.com' ELSE '10.0.0.' || CAST(n_nationkey AS VARCHAR(10)) END AS host, n_nationkey % 3 = 0 AS has_rds_kill FROM nation""",
    "setup_consumers": "SELECT n_nationkey AS server_id, name, CASE WHEN (n_nationkey + length(name)) % 3 = 0 THEN 'NO' ELSE 'YES' END AS enabled FROM nation CROSS JOIN (SELECT 'global_instrumentation' AS name UNION ALL SELECT 'statements_digest' UNION ALL SELECT 'events_waits_current' UNION ALL SELECT 'events_statements_history_long') AS names",
    "sql_texts": """SELECT p_partkey AS id, CASE p_partkey % 16
        WHEN 0 THEN 'SELECT * FROM shop.t' || CAST(p_size AS VARCHAR(10)) || ' FOR UPDATE' WHEN 1 THEN '/* service=''' || p_type || ''', v=2 */ select a from `db`.`x` ' WHEN 2 THEN '-- note' || chr(10) || 'UPDATE t' || CAST(p_size AS VARCHAR(10)) || ' SET a=1'
        WHEN 3 THEN '# c' || chr(10) || '/* d */  INSERT INTO log VALUES (1)' WHEN 4 THEN 'DELETE FROM a . b' WHEN 5 THEN 'alter table shop.x add y int' WHEN 6 THEN '' WHEN 7 THEN '/* open' WHEN 8 THEN 'BEGIN' WHEN 9 THEN 'SET x = 1' WHEN 10 THEN 'SHOW TABLES'
        WHEN 11 THEN 'SELECT @@version' WHEN 12 THEN 'WITH q AS (SELECT 1) SELECT 2 ...' WHEN 13 THEN 'CALL proc_' || p_brand || '()' WHEN 14 THEN '/*a=1,service=''x%20y'',a=2*/ SELECT 1' ELSE 'DROP TABLE shop.' || p_type END AS sql_text,
        CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN '/* h */ SELECT ? FROM d' ELSE p_name END AS digest_text FROM part""",
}


def _needs(name: str, seen: list[str]) -> list[str]:
    for other in RELATIONS:
        if other != name and other not in seen and re.search(rf"\bFROM {other}\b", RELATIONS[name]):
            _needs(other, seen)
    if name not in seen:
        seen.append(name)
    return seen


def _with(names: tuple[str, ...]) -> str:
    order: list[str] = []
    for n in names:
        _needs(n, order)
    return ", ".join(f"{n} AS ({RELATIONS[n]})" for n in order)


def ctes(*names: str) -> str:
    """The WITH clause's inside for the named relations, for DuckDB."""
    return _with(names)


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A telemetry relation derived from the tables in ``sf_dir``."""
    text = f"WITH {_with((name,))} SELECT * FROM {name}"
    used = [t for t in BASE if re.search(rf"\bFROM {t}\b", text)]
    frames = {}
    for t in used:
        df = spark.read.parquet(f"{sf_dir}/{t}.parquet")
        frames[t] = df.select(*(F.col(c).cast("timestamp").alias(c) if k == "timestamp_ntz" else F.col(c) for c, k in df.dtypes))
        text = re.sub(rf"\bFROM {t}\b", f"FROM {{{t}}}", text)
    text = re.sub(r"\{(?!(?:%s)\})" % "|".join(used), "{{", text)
    text = re.sub(r"(?<!\{)(?<!%s)\}" % ")(?<!".join("{" + t for t in used), "}}", text)
    return spark.sql(text, **frames)
