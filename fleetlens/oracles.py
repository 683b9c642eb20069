"""DuckDB SQL that the registered telemetry queries equal, over the same derived relations."""

from __future__ import annotations

from fleetlens.functions.text import NAMED_BY
from fleetlens.operators.mdl import BLOCKS
from fleetlens.sources.adapters import ctes

ORACLES: dict[str, str] = {}

_COUNTERS = {"count_star": "exec_delta", "sum_timer_wait": "timer_delta", "sum_rows_examined": "rows_examined_delta", "sum_rows_sent": "rows_sent_delta", "sum_lock_time": "lock_delta", "sum_no_index_used": "no_index_delta", "sum_created_tmp_disk_tables": "tmp_disk_delta", "sum_sort_merge_passes": "sort_merge_delta"}
_CLASS = "CASE WHEN {e} LIKE 'wait/io/socket/%' THEN 'Network' WHEN {e} LIKE 'wait/io/file/%' OR {e} LIKE 'wait/io/table/%' THEN 'IO' WHEN {e} LIKE 'wait/lock/%' THEN 'Lock' WHEN {e} LIKE 'wait/synch/mutex/%' OR {e} LIKE 'wait/synch/rwlock/%' OR {e} LIKE 'wait/synch/cond/%' OR {e} LIKE 'wait/synch/sxlock/%' THEN 'Sync' ELSE 'Other' END"
_S = "CAST(epoch({c}) AS BIGINT)"


def _s(c: str) -> str:
    return _S.format(c=c)


_LAGS = ", ".join(f"lag({c}) OVER k AS p_{c}" for c in _COUNTERS)
_DIFFS = ", ".join(f"CAST(greatest({c} - p_{c}, 0) AS BIGINT) AS {d}" for c, d in _COUNTERS.items())

_AFTER = " OR ".join(f"upper(k[i]) LIKE '%{w}'" for w in NAMED_BY)


def _named(rows: str, sql: str) -> str:
    """``rows`` with t1 and t2, the names behind the first word of NAMED_BY in column ``sql``: its words and marks one by one."""
    return rf"""SELECT * EXCLUDE (k, h, f), coalesce(f[1], '') AS t1, CASE WHEN f[2] = '.' AND regexp_matches(f[3], '^\w') THEN f[3] ELSE '' END AS t2 FROM (
        SELECT *, list_filter(k[h + 2:h + 9], lambda x: x <> '`' AND NOT regexp_matches(x, '^\s')) AS f FROM (
        SELECT *, list_filter(range(1, len(k) + 1), lambda i: ({_AFTER}) AND regexp_matches(k[i + 1], '^\s') AND (regexp_matches(k[i + 2], '^\w') OR (k[i + 2] = '`' AND regexp_matches(k[i + 3], '^\w'))))[1] AS h FROM (
        SELECT *, regexp_extract_all({sql}, '\w+|\s+|[^\w\s]') AS k FROM ({rows}))))"""


# derived relations: name -> (relations it needs, derived ones it needs, SQL)
DERIVED = {
    "plog": ((), "SELECT server_id, poll_ts, lag(poll_ts) OVER (PARTITION BY server_id ORDER BY poll_ts) AS prev FROM good_polls", ("good_polls",)),
    "dlag": ((), f"SELECT *, lag(poll_ts) OVER k AS seen, {_LAGS} FROM digest_polls WINDOW k AS (PARTITION BY server_id, schema_name, digest ORDER BY poll_ts)", ("digest_polls",)),
    "dout": (("plog", "dlag"), f"""SELECT d.server_id, schema_name, digest, d.poll_ts, digest_text, CASE WHEN seen IS NULL OR prev IS NULL OR seen <> prev THEN 'seed' WHEN count_star < p_count_star OR sum_timer_wait < p_sum_timer_wait OR sum_rows_examined < p_sum_rows_examined
        OR sum_rows_sent < p_sum_rows_sent OR sum_lock_time < p_sum_lock_time THEN 'reset' WHEN count_star > p_count_star OR sum_timer_wait > p_sum_timer_wait THEN 'emit' ELSE 'idle' END AS outcome, CAST((epoch(d.poll_ts) - epoch(prev)) * 1000000000 AS BIGINT) AS interval_ns, {_DIFFS}
        FROM dlag d JOIN plog p ON d.server_id = p.server_id AND d.poll_ts = p.poll_ts""", ()),
    "dd": (("dout",), "SELECT * FROM dout WHERE outcome = 'emit'", ()),
    "wlog": ((), "SELECT server_id, poll_ts, lag(poll_ts) OVER (PARTITION BY server_id ORDER BY poll_ts) AS prev FROM good_polls", ("good_polls",)),
    "wlag": ((), "SELECT *, lag(poll_ts) OVER k AS seen, lag(count_star) OVER k AS pc, lag(sum_timer_wait) OVER k AS pt FROM wait_polls WINDOW k AS (PARTITION BY server_id, event_name ORDER BY poll_ts)", ("wait_polls",)),
    "wout": (("wlog", "wlag"), f"""SELECT w.server_id, w.poll_ts, event_name, {_CLASS.format(e='event_name')} AS class, CASE WHEN seen IS NULL THEN 'seed' WHEN count_star < pc OR sum_timer_wait < pt THEN 'reset' ELSE 'delta' END AS outcome,
        CAST((epoch(w.poll_ts) - epoch(prev)) * 1000000000 AS BIGINT) AS interval_ns, seen < prev AS spans_gap, CAST(count_star - pc AS BIGINT) AS count_delta, CAST(sum_timer_wait - pt AS BIGINT) AS timer_delta_ps FROM wlag w JOIN wlog l ON w.server_id = l.server_id AND w.poll_ts = l.poll_ts""", ()),
    "wd": (("wout",), "SELECT server_id, poll_ts, class, max(interval_ns) AS interval_ns, CAST(sum(count_delta) AS BIGINT) AS count_delta, CAST(sum(timer_delta_ps) AS BIGINT) AS timer_delta_ps, bool_or(spans_gap) AS spans_gap FROM wout WHERE outcome = 'delta' GROUP BY ALL HAVING sum(count_delta) <> 0 OR sum(timer_delta_ps) <> 0", ()),
    "ss": ((), "SELECT server_id, tick_ts AS ts, processlist_id, digest, schema_name, CASE WHEN processlist_id % 3 = 0 THEN 'checkout' WHEN program_name <> '' THEN program_name ELSE 'unknown' END AS app_tag, user_name, host, current_wait AS event_name, executing FROM session_ticks WHERE executing", ("session_ticks",)),
    "cpu": ((), "SELECT server_id, tick_ts AS ts, count(*) FILTER (executing AND current_wait IN ('', 'idle')) AS cpu_observations, CAST(1 AS BIGINT) AS cpu_ticks FROM session_ticks GROUP BY 1, 2", ("session_ticks",)),
    "hv": ((), "SELECT server_id, poll_ts, " + ", ".join(f"coalesce(max(TRY_CAST(value AS BIGINT)) FILTER (variable_name = '{k}'), 0) AS {v}" for k, v in {"Uptime": "uptime_s", "Threads_running": "threads_running", "Threads_connected": "threads_connected", "Innodb_buffer_pool_pages_dirty": "bp_pages_dirty", "Innodb_buffer_pool_pages_total": "bp_pages_total", "Innodb_buffer_pool_read_requests": "bp_read_requests", "Innodb_buffer_pool_reads": "bp_reads", "Aborted_clients": "aborted_clients"}.items()) + " FROM status_vars GROUP BY ALL", ("status_vars",)),
    "st": (("dd",), "SELECT server_id, schema_name, digest, max(digest_text) AS digest_text, CAST(sum(exec_delta) AS BIGINT) AS calls, CAST(sum(timer_delta) AS BIGINT) AS timer_ps, CAST(sum(rows_examined_delta) AS BIGINT) AS rows_examined, CAST(sum(rows_sent_delta) AS BIGINT) AS rows_sent, sum(no_index_delta) > 0 AS no_idx, sum(interval_ns) / 1e9 AS seconds FROM dd GROUP BY 1, 2, 3 HAVING sum(exec_delta) > 0", ()),
    "sl": (("st",), "SELECT server_id, schema_name, digest, digest_text, calls, (timer_ps // calls) // 1000 AS avg_latency_ns, round(timer_ps / 1e12 / seconds, 6) AS aas, round(calls / seconds, 6) AS calls_per_s, round(rows_examined / calls, 6) AS rows_per_call, rows_examined, rows_sent, no_idx FROM st", ()),
    "pw": ((), "SELECT *, upper(trim(info)) LIKE 'ALTER %' AS ddl FROM processes", ("processes",)),
    "chains": ((), """SELECT server_id, snapshot_ts, path, depth, longest FROM (WITH RECURSIVE p(server_id, snapshot_ts, path, node, longest) AS (SELECT DISTINCT server_id, snapshot_ts, [blocking_pid], blocking_pid, CAST(0 AS BIGINT) FROM lock_waits WHERE blocking_pid NOT IN (SELECT waiting_pid FROM lock_waits) UNION ALL
        SELECT p.server_id, p.snapshot_ts, list_append(p.path, e.waiting_pid), e.waiting_pid, greatest(p.longest, e.wait_ms) FROM p JOIN lock_waits e ON e.blocking_pid = p.node) SELECT server_id, snapshot_ts, path, node, longest, len(path) AS depth FROM p)""", ("lock_waits",)),
    "leaves": (("chains",), "SELECT server_id, snapshot_ts, path, depth, longest, CASE WHEN depth >= 4 OR longest > 10000 THEN 2 ELSE 1 END AS severity FROM chains WHERE path[-1] NOT IN (SELECT blocking_pid FROM lock_waits)", ()),
    "rings": ((), """SELECT server_id, snapshot_ts, start, path FROM (WITH RECURSIVE c(server_id, snapshot_ts, start, node, path, closed) AS (SELECT server_id, snapshot_ts, blocking_pid, waiting_pid, [blocking_pid], blocking_pid = waiting_pid FROM lock_rings UNION ALL
        SELECT c.server_id, c.snapshot_ts, c.start, e.waiting_pid, list_append(c.path, e.blocking_pid), e.waiting_pid = c.start FROM c JOIN lock_rings e ON e.blocking_pid = c.node WHERE NOT closed AND NOT list_contains(c.path, e.blocking_pid)) SELECT * FROM c WHERE closed AND start = list_min(path))""", ("lock_rings",)),
    "queue": ((), "SELECT server_id, snapshot_ts, object_schema, object_name, pid, thread_id, lock_type, time_s, CAST(row_number() OVER (PARTITION BY server_id, snapshot_ts, object_schema, object_name ORDER BY time_s DESC, thread_id) AS INTEGER) AS position, count(*) OVER (PARTITION BY server_id, snapshot_ts, object_schema, object_name) AS depth FROM metadata_locks WHERE lock_status = 'PENDING'", ("metadata_locks",)),
    "clean": ((), r"SELECT id, sql_text, digest_text, CASE WHEN c LIKE '/*%' OR c LIKE '--%' OR c LIKE '#%' THEN '' ELSE c END AS c FROM (SELECT *, regexp_replace(sql_text, '^(?:\s+|/\*[\s\S]*?\*/|--[^\n]*\n|#[^\n]*\n)+', '') AS c FROM sql_texts)", ("sql_texts",)),
    "tab": (("clean",), f"SELECT *, upper(trim(c)) AS u FROM ({_named('SELECT * FROM clean', 'c')})", ()),
    "num": ((), "SELECT id, id * 7919 AS ms FROM sql_texts", ("sql_texts",)),
}


def _collect(name: str, raw: list[str], out: list[str]) -> None:
    before, _, relations = DERIVED[name]
    raw += [r for r in relations if r not in raw]
    for b in before:
        _collect(b, raw, out)
    if name not in out:
        out.append(name)


def oracle(name: str, body: str, *needs: str) -> None:
    raw: list[str] = []
    derived: list[str] = []
    for n in needs:
        if n in DERIVED:
            _collect(n, raw, derived)
        elif n not in raw:
            raw.append(n)
    ORACLES[name] = "WITH " + ", ".join([ctes(*raw), *(f"{d} AS ({DERIVED[d][1]})" for d in derived)]) + "\n" + body


_KEYS = "server_id, schema_name, digest"
oracle("digest_scan", f"SELECT server_id, {_s('poll_ts')} AS poll_ts, schema_name, digest, coalesce(digest_text, '') AS digest_text, {', '.join(f'CAST({c} AS BIGINT) AS {c}' for c in _COUNTERS)} FROM digest_polls WHERE digest IS NOT NULL", "digest_polls")
oracle("wait_scan", f"SELECT server_id, {_s('poll_ts')} AS poll_ts, event_name, CAST(count_star AS BIGINT) AS count_star, CAST(sum_timer_wait AS BIGINT) AS sum_timer_wait FROM wait_polls WHERE count_star > 0", "wait_polls")
oracle("session_ticks", f"""SELECT server_id, {_s('tick_ts')} AS tick_ts, processlist_id, CASE WHEN processlist_id % 6 <> 0 THEN schema_name ELSE '' END AS schema_name, CASE WHEN processlist_id % 6 <> 0 THEN digest ELSE '' END AS digest, CASE WHEN processlist_id % 6 <> 0 THEN sql_text ELSE '' END AS sql_text,
    executing AND processlist_id % 6 <> 0 AS executing, CASE WHEN processlist_id % 2 = 0 THEN 'wait/io/file/late' WHEN current_wait = 'idle' THEN '' ELSE current_wait END AS current_wait, program_name, user_name, host FROM session_ticks WHERE processlist_id % 17 <> 0 AND processlist_id % 13 <> 0""", "session_ticks")
oracle("recent_example", "SELECT server_id, digest, arg_max(sql_text, processlist_id) AS sql_text, arg_max(schema_name, processlist_id) AS schema_name FROM session_ticks WHERE sql_text <> '' GROUP BY 1, 2", "session_ticks")
oracle("transactions", f"""SELECT server_id, {_s('snapshot_ts')} AS snapshot_ts, pid, user_name, host, db, command, state, time_s, query, CASE WHEN pid % 7 <> 0 THEN digest_text ELSE '' END AS digest_text, trx_id, trx_state,
    {_s('snapshot_ts')} - CASE WHEN pid % 5 <> 0 THEN age_s ELSE 0 END AS trx_started, CASE WHEN pid % 5 <> 0 THEN age_s ELSE 0 END AS age_s FROM transactions WHERE pid % 3 <> 0""", "transactions")
oracle("processes", f"SELECT server_id, {_s('snapshot_ts')} AS snapshot_ts, pid, user_name, host, db, command, state, info, time_s FROM processes", "processes")
oracle("metadata_locks", f"SELECT server_id, {_s('snapshot_ts')} AS snapshot_ts, thread_id, pid, user_name, host, lock_type, lock_status, object_type, object_schema, object_name, time_s, CASE WHEN pid % 4 <> 0 THEN pid END AS owner_pid, CASE lock_status WHEN 'GRANTED' THEN 1 WHEN 'PENDING' THEN 2 ELSE 0 END AS state_order FROM metadata_locks", "metadata_locks")
oracle("health_vitals", f"SELECT * REPLACE ({_s('poll_ts')} AS poll_ts) FROM hv", "hv")
_ROLE = "server_id, poll_s, CASE WHEN poll_s % 6 <> 0 THEN 'replica' ELSE 'standalone' END AS role, coalesce(lower(coalesce(nullif(new_io, ''), nullif(old_io, ''))) = 'yes' AND poll_s % 6 <> 0, false) AS io_running, coalesce(lower(new_sql) = 'yes' AND poll_s % 6 <> 0, false) AS sql_running, CASE WHEN poll_s % 6 <> 0 THEN coalesce(TRY_CAST(lag AS BIGINT), -1) ELSE -1 END AS lag_s, '' AS last_error, '' AS gtid_retrieved"
oracle("replica_status", f"SELECT {_ROLE} FROM replica_rows", "replica_rows")
oracle("replication_health", f"SELECT *, CASE WHEN lag_s > 30 THEN 2 WHEN lag_s > 5 OR NOT io_running OR NOT sql_running THEN 1 ELSE 0 END AS severity, lag_s >= 0 AS lag_known FROM (SELECT {_ROLE} FROM replica_rows) WHERE role = 'replica'", "replica_rows")
_GTIDS = """SELECT server_id, poll_s, u, unnest(range(lo, hi + 1)) AS x FROM (SELECT server_id, poll_s, unnest([{u: 'aa', lo: 1, hi: poll_s + 20}, {u: 'aa', lo: poll_s + 30, hi: poll_s + 40}, {u: 'bb', lo: 1, hi: 5}], recursive := true) FROM replica_rows)
    EXCEPT SELECT server_id, poll_s, u, unnest(range(lo, hi + 1)) FROM (SELECT server_id, poll_s, unnest([{u: 'aa', lo: 1, hi: poll_s}, {u: 'aa', lo: poll_s + 5, hi: poll_s + 12}, {u: 'bb', lo: CASE WHEN poll_s % 3 = 0 THEN 1 ELSE 2 END, hi: CASE WHEN poll_s % 3 = 0 THEN 9 ELSE 2 END}, {u: 'bb', lo: 4, hi: 4}, {u: 'aa', lo: poll_s + 1, hi: CASE WHEN poll_s % 5 = 0 THEN poll_s + 50 ELSE poll_s END}], recursive := true) FROM replica_rows)"""
_GTID_RUNS = f"SELECT server_id, poll_s, u, min(x) AS lo, max(x) AS hi FROM (SELECT *, x - row_number() OVER (PARTITION BY server_id, poll_s, u ORDER BY x) AS g FROM ({_GTIDS})) GROUP BY server_id, poll_s, u, g"
oracle("gtid_gap", f"""SELECT r.server_id, r.poll_s, CAST(coalesce(n, 0) AS BIGINT) AS missing, coalesce(gap, '') AS gap FROM replica_rows r LEFT JOIN (SELECT server_id, poll_s, sum(n) AS n, string_agg(u || ':' || t, ',' ORDER BY u) AS gap FROM (
    SELECT server_id, poll_s, u, sum(hi - lo + 1) AS n, string_agg(CASE WHEN lo = hi THEN CAST(lo AS VARCHAR) ELSE lo || '-' || hi END, ':' ORDER BY lo) AS t FROM ({_GTID_RUNS}) GROUP BY 1, 2, 3) GROUP BY 1, 2) m ON m.server_id = r.server_id AND m.poll_s = r.poll_s""", "replica_rows")
oracle("innodb_status_metrics", "SELECT server_id, snapshot, CAST(regexp_extract(status_text, 'History list length (\\d+)', 1) AS BIGINT) AS history_length, CASE WHEN snapshot % 2 = 0 THEN 2 ELSE 1 END AS active, CASE WHEN snapshot % 2 = 0 THEN 1 ELSE 0 END AS lock_waits, snapshot * 10 AS trx_id_counter FROM status_texts", "status_texts")
oracle("deadlock_participants", """SELECT server_id, snapshot, '2024-01-02 03:04:05' AS deadlock_ts, CAST(n AS INTEGER) AS n, CAST(snapshot + n AS VARCHAR) AS trx_id, snapshot % 1000 + n AS thread_id, 'localhost' AS host, 'root' AS user_name, 'shop.t' AS table_name, 'PRIMARY' AS index_name, 'X' AS lock_mode,
    'UPDATE t SET a = ' || CAST(snapshot + n AS VARCHAR) AS query FROM status_texts CROSS JOIN range(1, 3) r(n)""", "status_texts")
oracle("server_info", "SELECT server_id, version, CASE WHEN version = '5.7.44' THEN 50744 WHEN version LIKE '8.0.45%' THEN 80045 WHEN version LIKE '10.6.1%' THEN 100601 ELSE 0 END AS version_number, version LIKE '%MariaDB%' AS is_mariadb, version LIKE '%aurora%' AS is_aurora, has_rds_kill AND version NOT LIKE '%MariaDB%' AS is_rds FROM servers", "servers")
oracle("capability_audit", """SELECT server_id, digest, waits, history_long, connect_attributes, mdl, concat_ws('; ', CASE WHEN NOT global_on THEN 'no statement digests: consumer global_instrumentation is off' WHEN NOT digest THEN 'no statement digests: consumer statements_digest is off' END,
    CASE WHEN NOT waits THEN 'no wait events: consumer global_instrumentation is off' END, CASE WHEN NOT history_long THEN 'no recent examples: consumer events_statements_history_long is off' END,
    CASE WHEN NOT connect_attributes THEN 'no connection attributes: applications are told by comments only' END, CASE WHEN NOT mdl THEN 'no metadata locks: instrument wait/lock/metadata/sql/mdl is off' END) AS warnings FROM (
    SELECT server_id, bool_or(name = 'global_instrumentation' AND enabled = 'YES') AS global_on, bool_or(name = 'statements_digest' AND enabled = 'YES') AND bool_or(name = 'global_instrumentation' AND enabled = 'YES') AS digest, bool_or(name IN ('events_waits_current', 'global_instrumentation') AND enabled = 'YES') AS waits,
    bool_or(name = 'events_statements_history_long' AND enabled = 'YES') AS history_long, server_id % 4 <> 0 AS connect_attributes, server_id % 3 = 0 OR server_id % 2 = 0 AS mdl FROM setup_consumers GROUP BY 1)""", "setup_consumers")
_M = {"CPUUtilization": ("cpu_percent", 1), "DatabaseConnections": ("connections", 1), "FreeableMemory": ("free_memory_bytes", 1), "ReadIOPS": ("read_iops", 1), "WriteIOPS": ("write_iops", 1), "ReadLatency": ("read_latency_ns", 10**9), "WriteLatency": ("write_latency_ns", 10**9), "DiskQueueDepth": ("queue_depth", 1), "AuroraReplicaLag": ("replica_lag_ns", 10**6), "BufferCacheHitRatio": ("cache_hit_percent", 1), "Deadlocks": ("deadlocks_per_s", 1), "VolumeBytesUsed": ("volume_bytes", 1)}
oracle("cloud_metrics_latest", "SELECT instance, is_aurora, " + ", ".join(f"round(greatest(coalesce(max(v) FILTER (metric_name = '{k}'), 0), 0) * {f}, 4) AS {n}" for k, (n, f) in _M.items()) + " FROM (SELECT instance, is_aurora, metric_name, arg_max(value, (ts, value)) AS v FROM cloud_metrics WHERE ts > TIMESTAMP '2024-01-30 23:59:59' - INTERVAL 30 DAY AND ts <= TIMESTAMP '2024-01-30 23:59:59' AND (is_aurora OR metric_name NOT IN ('AuroraReplicaLag', 'BufferCacheHitRatio', 'Deadlocks', 'VolumeBytesUsed')) GROUP BY 1, 2, 3) GROUP BY 1, 2", "cloud_metrics")
oracle("rds_target", "SELECT server_id, host, CASE WHEN server_id % 2 = 0 THEN split_part(host, '.', 1) ELSE '' END AS instance, CASE WHEN server_id % 2 = 0 THEN 'us-east-1' ELSE '' END AS region, server_id % 2 = 0 AS ok, CASE WHEN server_id % 2 = 0 THEN '' ELSE 'host is not an RDS endpoint' END AS reason FROM servers", "servers")

oracle("digest_deltas", f"SELECT {_KEYS}, {_s('poll_ts')} AS poll_ts, digest_text, interval_ns, {', '.join(_COUNTERS.values())} FROM dd", "dd")
ORACLES["digest_deltas_by_day"] = ORACLES["digest_deltas"]
oracle("digest_poll_audit", f"SELECT server_id, {_s('poll_ts')} AS poll_ts, count(*) AS seen, count(*) FILTER (outcome = 'emit') AS emitted, count(*) FILTER (outcome = 'reset') AS resets, count(*) FILTER (outcome = 'seed') AS seeded FROM dout GROUP BY 1, 2", "dout")
oracle("wait_deltas", f"SELECT server_id, {_s('poll_ts')} AS poll_ts, class, interval_ns, count_delta, timer_delta_ps, spans_gap FROM wd", "wd")
oracle("wait_poll_audit", f"""SELECT server_id, {_s('g.poll_ts')} AS poll_ts, count(event_name) AS seen, count(*) FILTER (outcome = 'seed') AS seeded, count(*) FILTER (outcome = 'reset') AS resets, (SELECT count(*) FROM wd WHERE wd.server_id = g.server_id AND wd.poll_ts = g.poll_ts) AS emitted
    FROM good_polls g LEFT JOIN wout USING (server_id, poll_ts) GROUP BY server_id, g.poll_ts""", "wd", "good_polls")
oracle("aborted_clients_delta", f"SELECT server_id, {_s('poll_ts')} AS poll_ts, aborted_clients, greatest(aborted_clients - lag(aborted_clients, 1, 0) OVER (PARTITION BY server_id ORDER BY hv.poll_ts), 0) AS aborted_delta FROM hv", "hv")
oracle("cpu_samples", f"SELECT server_id, {_s('ts')} AS ts, cpu_observations, cpu_ticks FROM cpu", "cpu")
oracle("executing_sessions", f"SELECT server_id, {_s('ts')} AS ts, processlist_id, digest, schema_name, app_tag, user_name, host, event_name, executing FROM ss", "ss")
oracle("session_samples", f"SELECT server_id, {_s('ts')} AS ts, processlist_id, app_tag, user_name, host, event_name FROM ss", "ss")
oracle("cpu_eligible", f"SELECT server_id, {_s('tick_ts')} AS tick_ts, processlist_id FROM session_ticks WHERE current_wait IN ('', 'idle')", "session_ticks")
oracle("retained_samples", f"SELECT {_KEYS}, {_s('poll_ts')} AS poll_ts, exec_delta FROM (SELECT *, row_number() OVER (PARTITION BY {_KEYS} ORDER BY poll_ts DESC) AS r FROM dd WHERE poll_ts <= TIMESTAMP '2024-01-30 23:59:59' AND poll_ts >= TIMESTAMP '2024-01-20 23:59:59') d WHERE r <= 50", "dd")
oracle("latest_sample", f"SELECT {_KEYS}, CAST(epoch(max(poll_ts)) AS BIGINT) AS poll_ts, arg_max(exec_delta, dd.poll_ts) AS exec_delta, arg_max(timer_delta, dd.poll_ts) AS timer_delta FROM dd GROUP BY {_KEYS}", "dd")
oracle("tracked_digests", f"""SELECT {_KEYS}, load, first_seen, place <= 3 AS kept, CAST(sum(CASE WHEN place > 3 THEN 1 ELSE 0 END) OVER (PARTITION BY server_id) AS BIGINT) AS evicted FROM (SELECT *, row_number() OVER (PARTITION BY server_id ORDER BY load DESC, schema_name, digest) AS place
    FROM (SELECT {_KEYS}, CAST(sum(timer_delta) AS BIGINT) AS load, CAST(epoch(min(poll_ts)) AS BIGINT) AS first_seen FROM dd GROUP BY {_KEYS}))""", "dd")
oracle("poll_error_counts", "SELECT server_id, collector, count(*) AS polls, count(*) FILTER (NOT ok) AS failed FROM polls GROUP BY 1, 2", "polls")

for _name, _by in (("top_sql", "aas"), ("top_sql_by_calls", "calls"), ("top_sql_by_latency", "avg_latency_ns"), ("top_sql_by_rows", "rows_examined")):
    oracle(_name, f"SELECT *, CAST(row_number() OVER (PARTITION BY server_id ORDER BY {_by} DESC, schema_name, digest) AS INTEGER) AS rank FROM sl QUALIFY rank <= 20", "sl")
oracle("top_sql_by_app", "SELECT *, CAST(row_number() OVER (PARTITION BY server_id ORDER BY aas DESC, schema_name, digest) AS INTEGER) AS rank FROM sl WHERE (server_id, digest) IN (SELECT (server_id, digest) FROM ss WHERE app_tag = 'checkout') QUALIFY rank <= 20", "sl", "ss")
oracle("rows_examined_per_sent", "SELECT server_id, digest, CASE WHEN rows_sent <> 0 THEN round(rows_examined / rows_sent, 6) END AS ratio FROM sl", "sl")
oracle("top_sql_report", "SELECT server_id, CAST(row_number() OVER (PARTITION BY server_id ORDER BY aas DESC, schema_name, digest) AS INTEGER) AS rank, digest, calls, aas, avg_latency_ns // 1000000 AS avg_latency_ms FROM sl QUALIFY rank <= 20", "sl")
for _g in ("user_name", "host", "schema_name"):
    oracle("load_by_" + _g.removesuffix("_name"), f"SELECT server_id, CASE WHEN {_g} = '' THEN '(unknown)' ELSE {_g} END AS name, count(*) AS observations, any_value(ticks) AS ticks, round(count(*) / any_value(ticks), 6) AS aas FROM ss JOIN (SELECT server_id, count(DISTINCT ts) AS ticks FROM ss GROUP BY 1) USING (server_id) GROUP BY 1, 2", "ss")
_CLASSES = "(VALUES ('CPU', 0), ('IO', 1), ('Lock', 2), ('Sync', 3), ('Network', 4), ('Other', 5)) c(class, ordinal)"
_LOAD = f"SELECT s.server_id, c.class, c.ordinal, coalesce(a.aas, 0) AS raw, sum(coalesce(a.aas, 0)) OVER (PARTITION BY s.server_id) AS whole FROM (SELECT DISTINCT server_id FROM good_polls) s CROSS JOIN {_CLASSES} LEFT JOIN (SELECT server_id, class, sum(timer_delta_ps) / 1e12 / (sum(interval_ns) / 1e9) AS aas FROM wd GROUP BY 1, 2 UNION ALL SELECT server_id, 'CPU', sum(cpu_observations) / sum(cpu_ticks) FROM cpu GROUP BY 1) a ON a.server_id = s.server_id AND a.class = c.class"
oracle("load_by_class", f"SELECT server_id, class, ordinal, round(raw, 6) AS aas, round(whole, 6) AS total FROM ({_LOAD})", "wd", "cpu", "good_polls")
_WITHIN = "{x}.server_id = p.server_id AND {x}.{ts} BETWEEN p.poll_ts - INTERVAL 6 HOUR AND p.poll_ts"
oracle("top_sql_of_days", """SELECT server_id, schema_name, digest, digest_text, calls, (timer_ps // calls) // 1000 AS avg_latency_ns, round(timer_ps / 1e12 / seconds, 6) AS aas, round(calls / seconds, 6) AS calls_per_s, round(rows_examined / calls, 6) AS rows_per_call, rows_examined, rows_sent, no_idx,
    CAST(row_number() OVER (PARTITION BY server_id ORDER BY round(timer_ps / 1e12 / seconds, 6) DESC, schema_name, digest) AS INTEGER) AS rank FROM (
    SELECT server_id, schema_name, digest, max(digest_text) AS digest_text, CAST(sum(exec_delta) AS BIGINT) AS calls, CAST(sum(timer_delta) AS BIGINT) AS timer_ps, CAST(sum(rows_examined_delta) AS BIGINT) AS rows_examined, CAST(sum(rows_sent_delta) AS BIGINT) AS rows_sent, sum(no_index_delta) > 0 AS no_idx, sum(interval_ns) / 1e9 AS seconds
    FROM dd WHERE poll_ts >= TIMESTAMP '2024-01-10' AND poll_ts < TIMESTAMP '2024-01-13' GROUP BY 1, 2, 3 HAVING sum(exec_delta) > 0)""", "dd")
oracle("top_sql_as_of", f"""SELECT server_id, {_s('poll_ts')} AS poll_ts, CAST(row_number() OVER (PARTITION BY server_id, w.poll_ts ORDER BY aas DESC, schema_name, digest) AS INTEGER) AS rank, digest, calls, avg_latency_ns, aas, rows_examined, no_idx FROM (
    SELECT p.server_id, p.poll_ts, schema_name, digest, CAST(sum(exec_delta) AS BIGINT) AS calls, CAST((sum(timer_delta) // sum(exec_delta)) // 1000 AS BIGINT) AS avg_latency_ns, round(sum(timer_delta) / 1e12 / (sum(interval_ns) / 1e9), 6) AS aas, CAST(sum(rows_examined_delta) AS BIGINT) AS rows_examined, sum(no_index_delta) > 0 AS no_idx
    FROM good_polls p JOIN dd ON {_WITHIN.format(x='dd', ts='poll_ts')} GROUP BY 1, 2, 3, 4 HAVING sum(exec_delta) > 0) w QUALIFY rank <= 3""", "dd", "good_polls")
oracle("load_by_user_as_of", f"""SELECT server_id, {_s('poll_ts')} AS poll_ts, name, observations, ticks, round(observations / ticks, 6) AS aas FROM (SELECT p.server_id, p.poll_ts, CASE WHEN user_name = '' THEN '(unknown)' ELSE user_name END AS name, count(*) AS observations FROM good_polls p JOIN ss ON {_WITHIN.format(x='ss', ts='ts')} GROUP BY 1, 2, 3)
    JOIN (SELECT p.server_id, p.poll_ts, count(DISTINCT ts) AS ticks FROM good_polls p JOIN ss ON {_WITHIN.format(x='ss', ts='ts')} GROUP BY 1, 2) USING (server_id, poll_ts)""", "ss", "good_polls")
_CLASS_AS_OF = f"""SELECT server_id, {_s('poll_ts')} AS poll_ts, class, ordinal, round(raw, 6) AS aas, round(sum(raw) OVER (PARTITION BY server_id, z.poll_ts), 6) AS total FROM (
    SELECT *, coalesce(CASE WHEN class = 'CPU' THEN sum(top) OVER w / nullif(sum(bottom) OVER w, 0) ELSE CAST(sum(top) OVER w AS BIGINT) / 1e12 / (nullif(CAST(sum(bottom) OVER w AS BIGINT), 0) / 1e9) END, 0) AS raw FROM (SELECT g.server_id, g.poll_ts, c.class, c.ordinal, CASE WHEN c.class = 'CPU' THEN u.cpu_observations ELSE d.timer_delta_ps END AS top, CASE WHEN c.class = 'CPU' THEN u.cpu_ticks ELSE d.interval_ns END AS bottom
        FROM good_polls g CROSS JOIN {_CLASSES} LEFT JOIN wd d ON d.server_id = g.server_id AND d.poll_ts = g.poll_ts AND d.class = c.class LEFT JOIN cpu u ON u.server_id = g.server_id AND u.ts = g.poll_ts)
    WINDOW w AS (PARTITION BY server_id, class ORDER BY poll_ts RANGE BETWEEN INTERVAL 6 HOUR PRECEDING AND CURRENT ROW)) z"""
oracle("load_by_class_as_of", _CLASS_AS_OF, "wd", "cpu", "good_polls")
# the sample of each rank itself, and the middle of its bucket
_RANKED = "SELECT server_id, digest, latency_ns AS v, row_number() OVER (PARTITION BY server_id, digest ORDER BY latency_ns) AS r, count(*) OVER (PARTITION BY server_id, digest) AS n FROM latencies WHERE latency_ns >= 0"
oracle("latency_percentiles", f"""SELECT server_id, digest, share, n, CAST((v // w) * w * 2 + w - 1 AS DOUBLE) / 2 AS value FROM (
    SELECT server_id, digest, share, n, v, CASE WHEN v < 64 THEN 1 ELSE CAST(1 AS BIGINT) << (length(bin(v)) - 6) END AS w FROM ({_RANKED}), (VALUES (CAST(0.5 AS DOUBLE)), (CAST(0.95 AS DOUBLE)), (CAST(0.99 AS DOUBLE))) AS s(share) WHERE r = greatest(CAST(ceil(share * n) AS BIGINT), 1))""", "latencies")
oracle("unindexed_conditions", """SELECT digest, ts, 'query_block/ordering_operation/nested_loop/0001/table' AS path, 'dim' AS table_name, column_name, 'UNINDEXED_CONDITION' AS flag FROM (SELECT digest, ts, unnest(['a', 'c' || (ts % 4), 'd' || (ts % 3)]) AS column_name FROM plans)
    WHERE column_name NOT IN (SELECT ['c', 'd'][server_id % 2 + 1] || (server_id // 8) FROM servers WHERE server_id % 3 = 0)""", "plans", "servers")
oracle("load_trail", f"SELECT server_id, {_s('ts')} AS ts, aas, CAST(row_number() OVER (PARTITION BY server_id ORDER BY q.ts DESC) AS INTEGER) AS age FROM (SELECT server_id, ts, round(sum(aas), 6) AS aas FROM (SELECT server_id, poll_ts AS ts, timer_delta_ps / 1e12 / (interval_ns / 1e9) AS aas FROM wd UNION ALL SELECT server_id, ts, cpu_observations / cpu_ticks FROM cpu) GROUP BY 1, 2) q QUALIFY age <= 60", "wd", "cpu")
oracle("busiest_tables", """SELECT *, CAST(row_number() OVER (PARTITION BY server_id ORDER BY aas DESC, table_name) AS INTEGER) AS rank FROM (SELECT server_id, CASE digest WHEN 'click' THEN 'shop.clicks' WHEN 'view' THEN 'shop.views' WHEN 'error' THEN 'shop.errors' ELSE 'shop.purchases' END AS table_name, round(sum(aas), 5) AS aas, round(sum(calls_per_s), 5) AS calls_per_s
    FROM sl WHERE digest <> 'signup' GROUP BY 1, 2) QUALIFY rank <= 5""", "sl")
oracle("top_users_share", """SELECT *, round(observations / max(observations) OVER (PARTITION BY server_id), 6) AS share FROM (SELECT server_id, CASE WHEN user_name = '' THEN '(unknown)' ELSE user_name END AS name, count(*) AS observations, any_value(ticks) AS ticks, round(count(*) / any_value(ticks), 6) AS aas,
    CAST(row_number() OVER (PARTITION BY server_id ORDER BY count(*) DESC, CASE WHEN user_name = '' THEN '(unknown)' ELSE user_name END) AS INTEGER) AS rank FROM ss JOIN (SELECT server_id, count(DISTINCT ts) AS ticks FROM ss GROUP BY 1) USING (server_id) GROUP BY 1, 2 QUALIFY rank <= 5)""", "ss")
oracle("digest_app_samples", "SELECT server_id, digest, app_tag, count(*) AS observations, any_value(ticks) AS ticks FROM ss JOIN (SELECT server_id, count(DISTINCT ts) AS ticks FROM ss GROUP BY 1) USING (server_id) GROUP BY 1, 2, 3", "ss")
oracle("class_app_load", f"SELECT server_id, {_CLASS.format(e='event_name')} AS class, app_tag, count(*) AS observations FROM ss GROUP BY 1, 2, 3", "ss")

oracle("health_ratios", f"SELECT server_id, {_s('poll_ts')} AS poll_ts, round(CASE WHEN bp_read_requests = 0 THEN 0 WHEN bp_reads > bp_read_requests THEN 1 ELSE (bp_read_requests - bp_reads) / bp_read_requests END, 6) AS bp_hit, round(CASE WHEN threads_connected = 0 THEN 0 ELSE threads_running / threads_connected END, 6) AS running_ratio FROM hv", "hv")
oracle("verdict", f"""SELECT server_id, poll_ts, level, ['HEALTHY', 'WARN', 'PAGE'][level + 1] AS verdict, CASE WHEN level = 0 THEN NULL WHEN a = level THEN 'running_ratio' WHEN b = level THEN 'history_length' WHEN c = level THEN 'replica_lag' WHEN d = level THEN 'aborted_clients' WHEN e = level THEN 'cloud_cpu' ELSE 'issues' END AS driver FROM (
    SELECT *, greatest(a, b, c, d, e, f) AS level FROM (SELECT server_id, {_s('hv.poll_ts')} AS poll_ts, CASE WHEN threads_connected = 0 THEN 0 WHEN round(threads_running / threads_connected, 6) > 0.8 THEN 2 WHEN round(threads_running / threads_connected, 6) > 0.5 THEN 1 ELSE 0 END AS a,
    CASE WHEN uptime_s * 20000 > 5000000 THEN 2 WHEN uptime_s * 20000 > 1000000 THEN 1 ELSE 0 END AS b, CASE WHEN bp_reads % 3 = 0 THEN 0 WHEN bp_reads % 40 > 30 THEN 2 WHEN bp_reads % 40 > 5 THEN 1 ELSE 0 END AS c,
    CASE WHEN aborted_clients > lag(aborted_clients, 1, 0) OVER (PARTITION BY server_id ORDER BY hv.poll_ts) THEN 1 ELSE 0 END AS d, CASE WHEN bp_pages_total % 100 > 95 THEN 2 WHEN bp_pages_total % 100 > 80 THEN 1 ELSE 0 END AS e, CAST(bp_pages_dirty % 3 AS INTEGER) AS f FROM hv))""", "hv")

oracle("lock_chains", "SELECT server_id, CAST(epoch(snapshot_ts) AS BIGINT) AS snapshot_ts, path[1] AS root_blocker, array_to_string(path, '>') AS path, CAST(depth AS INTEGER) AS depth, longest AS max_wait_ms, severity FROM leaves", "leaves")
oracle("lock_tree", "SELECT server_id, CAST(epoch(snapshot_ts) AS BIGINT) AS snapshot_ts, path[-1] AS pid, CAST(depth - 1 AS INTEGER) AS depth, path[1] AS root, array_to_string(path, '>') AS path, coalesce((SELECT max(wait_ms) FROM lock_waits w WHERE w.waiting_pid = path[-1]), 0) AS wait_ms FROM chains", "chains")
oracle("lock_tree_report", """SELECT server_id, CAST(epoch(ts) AS BIGINT) AS snapshot_ts, pid, CAST(row_number() OVER (PARTITION BY server_id, ts ORDER BY root IS NULL, CASE WHEN root % 2 = 0 THEN root % 600 END DESC NULLS LAST, root, p, pid) AS INTEGER) AS place, depth, root, array_to_string(p, '>') AS path, wait_ms, CASE WHEN pid > 0 AND pid % 2 = 0 THEN pid % 600 END AS age_s,
    CASE WHEN pid < 0 THEN '' WHEN pid % 2 = 0 THEN 'UPDATE t' || pid WHEN pid % 5 <> 0 THEN 'q' || pid WHEN depth = 0 THEN 'DELETE t' ELSE 'UPDATE t' END AS query FROM (
    SELECT server_id, snapshot_ts AS ts, path[-1] AS pid, CAST(depth - 1 AS INTEGER) AS depth, path[1] AS root, path AS p, coalesce((SELECT max(wait_ms) FROM lock_waits w WHERE w.waiting_pid = path[-1]), 0) AS wait_ms FROM chains
    UNION ALL SELECT DISTINCT server_id, snapshot_ts, -pid, NULL, NULL, NULL, 0 FROM (SELECT server_id, snapshot_ts, waiting_pid AS pid FROM lock_waits UNION SELECT server_id, snapshot_ts, blocking_pid FROM lock_waits) WHERE pid % 50 = 0 AND pid <> 0)""", "chains")
oracle("lock_tree_top_waiters", "SELECT server_id, CAST(epoch(snapshot_ts) AS BIGINT) AS snapshot_ts, blocking_pid, waiting_pid, wait_ms, CAST(place AS INTEGER) AS place, greatest(n - 1, 0) AS more FROM (SELECT *, row_number() OVER (PARTITION BY blocking_pid ORDER BY wait_ms DESC, waiting_pid) AS place, count(*) OVER (PARTITION BY blocking_pid) AS n FROM lock_waits) WHERE place <= 1", "lock_waits")
oracle("lock_chain_totals", """SELECT server_id, CAST(epoch(snapshot_ts) AS BIGINT) AS snapshot_ts, path[1] AS root_blocker, path[len(path)] AS leaf, CAST(count(*) AS VARCHAR) AS chains, CAST(count(*) FILTER (severity = 2) AS VARCHAR) AS critical_chains,
    array_to_string(first(path ORDER BY depth DESC), '>') AS path, CAST(max(depth) AS INTEGER) AS depth, max(longest) AS max_wait_ms, max(severity) AS severity FROM leaves GROUP BY server_id, leaves.snapshot_ts, path[1], path[len(path)]""", "leaves")
oracle("lock_cycle_groups", "SELECT server_id, CAST(epoch(snapshot_ts) AS BIGINT) AS snapshot_ts, start, CAST(len(path) AS INTEGER) AS participants, CAST(len(path) AS INTEGER) AS edges, array_to_string(path, '>') AS path, 2 AS severity FROM rings", "rings")
oracle("lock_cycles", "SELECT server_id, CAST(epoch(snapshot_ts) AS BIGINT) AS snapshot_ts, start, array_to_string(path, '>') AS path, CAST(len(path) AS INTEGER) AS participants, 2 AS severity FROM rings", "rings")

_T = "server_id, snapshot_ts, object_schema, object_name"
_TS = f"server_id, {_s('snapshot_ts')} AS snapshot_ts, object_schema, object_name"
_KINDS = f"SELECT {_T}, string_agg(lock_type || '=' || n, ',' ORDER BY lock_type) AS types, string_agg(n || '×' || lock_type, ' ' ORDER BY n DESC, lock_type) AS buckets FROM (SELECT {_T}, lock_type, count(*) AS n FROM metadata_locks WHERE lock_status = 'PENDING' GROUP BY ALL) GROUP BY ALL"
_SUMS = f"SELECT {_T}, count(*) FILTER (lock_status = 'PENDING') AS pending, count(*) FILTER (lock_status = 'GRANTED') AS granted, coalesce(max(time_s) FILTER (lock_status = 'PENDING'), 0) AS oldest_wait_s FROM metadata_locks GROUP BY ALL"
oracle("mdl_tables", f"SELECT {_TS}, pending, granted, oldest_wait_s, coalesce(types, '') AS pending_types FROM ({_SUMS}) LEFT JOIN ({_KINDS}) USING ({_T})", "metadata_locks")
oracle("lock_type_buckets", f"SELECT {_TS}, coalesce(buckets, '—') AS buckets FROM ({_SUMS}) LEFT JOIN ({_KINDS}) USING ({_T})", "metadata_locks")
oracle("mdl_queue_position", f"SELECT * REPLACE ({_s('snapshot_ts')} AS snapshot_ts) FROM queue", "queue")
oracle("mdl_table_detail", f"""SELECT {_TS}, lock_status, pid, thread_id, lock_type, time_s, CAST(row_number() OVER (PARTITION BY {_T}, lock_status ORDER BY time_s DESC, thread_id) AS INTEGER) AS place
    FROM metadata_locks WHERE object_schema = 'shop' AND object_name = '1-URGENT' AND lock_status IN ('GRANTED', 'PENDING')""", "metadata_locks")
oracle("mdl_holders", f"SELECT {_TS}, pid, thread_id, lock_type, time_s, CAST(row_number() OVER (PARTITION BY server_id, m.snapshot_ts, object_schema, object_name ORDER BY time_s DESC, thread_id) AS INTEGER) AS place FROM metadata_locks m WHERE lock_status = 'GRANTED'", "metadata_locks")
_PAIRS = ", ".join(f"('{k}', '{h}')" for k, v in BLOCKS.items() for h in v.split())
_MET = f"""SELECT {_T}, w.pid AS waiting_pid, w.lock_type AS waiting_type, h.pid AS blocking_pid, h.lock_type AS holding_type FROM metadata_locks w JOIN metadata_locks h USING ({_T})
    WHERE w.lock_status = 'PENDING' AND h.lock_status = 'GRANTED' AND w.pid <> h.pid AND (w.lock_type = 'MYSTERY' OR (w.lock_type, h.lock_type) IN (VALUES {_PAIRS}))"""
_LONGEST = f"SELECT {_T}, lock_type AS holding_type, first(pid ORDER BY time_s DESC, thread_id) AS longest_pid FROM metadata_locks WHERE lock_status = 'GRANTED' GROUP BY ALL"
oracle("mdl_blockers", f"SELECT * REPLACE ({_s('snapshot_ts')} AS snapshot_ts) FROM ({_MET})", "metadata_locks")
oracle("mdl_blocker_counts", f"SELECT {_TS}, waiting_pid, waiting_type, holding_type, blockers, longest_pid FROM (SELECT {_T}, waiting_pid, waiting_type, holding_type, count(*) AS blockers FROM ({_MET}) GROUP BY ALL) JOIN ({_LONGEST}) USING ({_T}, holding_type)", "metadata_locks")
oracle("mdl_blocker_pairs", f"SELECT * REPLACE ({_s('snapshot_ts')} AS snapshot_ts) FROM ({_MET}) WHERE object_schema = 'shop' AND object_name = '1-URGENT'", "metadata_locks")

_DUR = "CASE WHEN {s} < 60 THEN {s} || 's' WHEN {s} < 3600 THEN ({s} // 60) || 'm' || ({s} % 60) || 's' ELSE ({s} // 3600) || 'h' || ({s} // 60 % 60) || 'm' END"
oracle("long_transactions", f"SELECT server_id, {_s('snapshot_ts')} AS snapshot_ts, CASE WHEN age_s >= 300 THEN 2 ELSE 1 END AS severity, 'Transaction running for ' || {_DUR.format(s='age_s')} AS title, CAST(pid AS VARCHAR) AS thread_id, CASE WHEN digest_text <> '' THEN digest_text ELSE query END AS query FROM transactions WHERE age_s >= 30", "transactions")
_DB = "SELECT p.server_id, p.snapshot_ts, p.pid, p.db, p.time_s, coalesce((SELECT string_agg(pid, ', ' ORDER BY pid) FROM (SELECT DISTINCT t.pid FROM transactions t WHERE t.server_id = p.server_id AND t.snapshot_ts = p.snapshot_ts AND t.db = p.db AND t.pid <> p.pid)), 'unknown') AS blockers FROM pw p WHERE ddl AND state = 'Waiting for table metadata lock'"
oracle("ddl_blocked", f"SELECT server_id, {_s('snapshot_ts')} AS snapshot_ts, pid, blockers, CASE WHEN time_s >= 10 THEN 2 ELSE 1 END AS severity FROM ({_DB})", "pw", "transactions")
oracle("ddl_blockers", f"SELECT server_id, {_s('snapshot_ts')} AS snapshot_ts, pid, db, blockers FROM ({_DB})", "pw", "transactions")
_DML = "SELECT a.*, b.pid AS ddl_pid, b.time_s AS ddl_s FROM pw a JOIN pw b ON a.server_id = b.server_id AND a.snapshot_ts = b.snapshot_ts AND a.db = b.db WHERE NOT a.ddl AND b.ddl AND a.db <> '' AND a.state = 'Waiting for table metadata lock'"
_DDLS = "SELECT server_id, snapshot_ts, db, count(*) AS ddls, first(pid ORDER BY time_s DESC, pid) AS ddl_pid FROM pw WHERE ddl GROUP BY ALL"
_DML_ROWS = f"SELECT a.*, d.ddls, d.ddl_pid FROM pw a JOIN ({_DDLS}) d USING (server_id, snapshot_ts, db) WHERE NOT a.ddl AND db <> '' AND a.state = 'Waiting for table metadata lock'"
oracle("dml_blocked_by_ddl", f"SELECT server_id, {_s('snapshot_ts')} AS snapshot_ts, db, pid AS blocked_pid, ddl_pid, CASE WHEN time_s >= 10 THEN 2 ELSE 1 END AS severity FROM ({_DML})", "pw")
oracle("dml_ddl_counts", f"SELECT server_id, {_s('snapshot_ts')} AS snapshot_ts, db, pid AS blocked_pid, ddls, ddl_pid, CASE WHEN time_s >= 10 THEN 2 ELSE 1 END AS severity FROM ({_DML_ROWS})", "pw")
oracle("dml_ddl_pairs", f"SELECT server_id, {_s('snapshot_ts')} AS snapshot_ts, pid AS blocked_pid, ddl_pid FROM ({_DML}) WHERE db = 'P'", "pw")
oracle("kill_eligibility", f"""SELECT server_id, snapshot_ts, pid, reason, reason IS NULL AS safe FROM (SELECT server_id, {_s('snapshot_ts')} AS snapshot_ts, pid, CASE WHEN pid IN (1, 2) THEN 'own connection' WHEN lower(user_name) IN ('system user', 'event_scheduler') THEN 'system user ''' || user_name || '''' WHEN command = 'Binlog Dump' THEN 'replication thread'
    WHEN state LIKE '%Waiting for master to send event%' THEN 'replication state ''' || state || '''' END AS reason FROM processes)""", "processes")
oracle("long_open_transactions", f"SELECT server_id, {_s('p.snapshot_ts')} AS snapshot_ts, CAST(row_number() OVER (PARTITION BY server_id, p.snapshot_ts ORDER BY time_s DESC, pid) AS INTEGER) AS rank, pid, user_name, time_s, CASE WHEN info = '' THEN '(idle in trx)' WHEN info LIKE 'ALTER%' THEN 'ALTER TABLE ' || regexp_extract(info, 'shop\\.(\\w+)', 1) ELSE 'SELECT ' || regexp_extract(info, 'FROM (\\w+)', 1) END AS label FROM processes p WHERE time_s >= 30 QUALIFY rank <= 5", "processes")

_SKEL = """SELECT digest, ts, CAST(ts % 4 = 0 AS VARCHAR) || '|' || (plan_json::JSON ->> '$.query_block.ordering_operation.nested_loop[0].table.table_name') || '|' || (ts % 3 = 0) AS k FROM plans"""
oracle("plan_nodes", """SELECT digest, ts, path, kind FROM plans CROSS JOIN (VALUES ('query_block', 'query_block'), ('query_block/ordering_operation', 'ordering_operation'), ('query_block/ordering_operation/nested_loop', 'nested_loop'), ('query_block/ordering_operation/nested_loop/0000', 'item'), ('query_block/ordering_operation/nested_loop/0001', 'item'),
    ('query_block/ordering_operation/nested_loop/0000/table', 'table'), ('query_block/ordering_operation/nested_loop/0001/table', 'table')) n(path, kind)""", "plans")
oracle("plan_red_flags", """WITH t AS (SELECT digest, ts, plan_json::JSON -> '$.query_block.ordering_operation.nested_loop[0].table' AS n FROM p0), v AS (SELECT digest, ts, n ->> 'table_name' AS table_name, CAST(n ->> 'rows_examined_per_scan' AS BIGINT) AS examined, CAST(n ->> 'rows_produced_per_join' AS BIGINT) AS produced, n ->> 'access_type' AS access FROM t)
    SELECT digest, ts, 'query_block/ordering_operation/nested_loop/0000/table' AS path, table_name, examined, produced, 'FULL_SCAN' AS flag FROM v WHERE access = 'ALL' AND examined >= 1000 UNION ALL SELECT digest, ts, 'query_block/ordering_operation/nested_loop/0000/table', table_name, examined, produced, 'BIG_SCAN_RATIO' FROM v WHERE produced > 0 AND examined >= 100 * produced
    UNION ALL SELECT digest, ts, 'query_block/ordering_operation', NULL, 0, 0, 'FILESORT' FROM p0 WHERE ts % 4 = 0""".replace("WITH t AS", "SELECT * FROM (WITH p0 AS (SELECT * FROM plans), t AS") + ")", "plans")

_UNSAFE = "CASE WHEN sql_text IS NULL THEN 'no example' END"
oracle("explain_candidates", f"SELECT d.server_id, d.digest, sql_text, schema_name, {_UNSAFE} AS skip_reason FROM (SELECT DISTINCT server_id, digest FROM digest_polls) d LEFT JOIN (SELECT server_id, digest, arg_max(sql_text, processlist_id) AS sql_text, arg_max(schema_name, processlist_id) AS schema_name FROM session_ticks WHERE sql_text <> '' GROUP BY 1, 2) e USING (server_id, digest)", "digest_polls", "session_ticks")

oracle("strip_sql_comments", "SELECT id, c AS stripped FROM clean", "clean")
oracle("table_from_sql", "SELECT id, CASE WHEN t2 <> '' THEN t1 || '.' || t2 ELSE t1 END AS table_name FROM tab", "tab")
oracle("explain_safe", "SELECT id, upper(regexp_extract(trim(c), '^[A-Za-z]*', 0)) IN ('SELECT', 'WITH') AS safe, upper(regexp_extract(trim(c), '^[A-Za-z]*', 0)) AS verb FROM clean", "clean")
oracle("is_ddl", "SELECT id, regexp_matches(upper(trim(sql_text)), '^(ALTER|CREATE|DROP|RENAME|TRUNCATE) ') AS ddl FROM sql_texts", "sql_texts")
oracle("untableable_bucket", """SELECT id, CASE WHEN u = '' THEN '(idle: no SQL captured)' WHEN regexp_matches(u, '^(BEGIN|COMMIT|ROLLBACK|SAVEPOINT|RELEASE SAVEPOINT|START TRANSACTION)') THEN '(transaction control: BEGIN / COMMIT)' WHEN regexp_matches(u, '^(SET |SHOW |USE |SELECT @@)') THEN '(session admin: SET / SELECT @@ / SHOW)'
    WHEN u LIKE '%...' THEN '(digest truncated by perf_schema)' ELSE '(no table reference in SQL)' END AS bucket FROM tab""", "tab")
_NAME = "CASE WHEN t2 <> '' THEN t2 ELSE t1 END"
_WITHT = "CASE WHEN {n} <> '' THEN '{v} ' || {n} ELSE '{v}' END"
oracle("query_label", "SELECT id, CASE WHEN id % 3 = 1 THEN 'SELECT ? FROM d' WHEN id % 3 = 2 AND digest_text <> '' THEN trim(digest_text) WHEN c = '' THEN '' WHEN u LIKE 'SELECT%' AND u LIKE '%FOR UPDATE%' THEN " + _WITHT.format(n=_NAME, v="SELECT FOR UPDATE") + " " + " ".join(f"WHEN u LIKE '{v}%' THEN " + _WITHT.format(n=_NAME, v=v) for v in ("SELECT", "UPDATE", "INSERT", "DELETE")) + " WHEN u LIKE 'ALTER%' THEN " + _WITHT.format(n=_NAME, v="ALTER TABLE") + " ELSE upper(regexp_extract(c, '^\\s*(\\S+)', 1)) END AS label FROM tab", "tab")
oracle("truncate_text", r"SELECT id, CASE WHEN length(sql_text) <= 20 THEN sql_text ELSE left(sql_text, 17) || '...' END AS cut, trim(regexp_replace(sql_text, '\s+', ' ', 'g')) AS flat FROM sql_texts", "sql_texts")
oracle("collapse_ws", r"SELECT id, trim(regexp_replace(sql_text, '\s+', ' ', 'g')) AS flat FROM sql_texts", "sql_texts")
oracle("app_tag", "SELECT id, CASE WHEN id % 16 = 1 THEN regexp_extract(sql_text, 'service=''([^'']*)''', 1) WHEN id % 16 = 14 THEN 'x y' WHEN digest_text <> '' THEN digest_text ELSE 'unknown' END AS app_tag FROM sql_texts", "sql_texts")
oracle("sql_comment_map", "SELECT id, CASE WHEN id % 16 = 1 THEN 'service=' || regexp_extract(sql_text, 'service=''([^'']*)''', 1) || '&v=2' WHEN id % 16 = 14 THEN 'a=2&service=x y' ELSE '' END AS pairs FROM sql_texts", "sql_texts")
oracle("human_duration", "SELECT id, CASE WHEN ms < 1000 THEN ms || 'ms' WHEN ms < 60000 THEN (ms // 1000) || 's' WHEN ms < 3600000 THEN (ms // 60000) || 'm' || CASE WHEN ms // 1000 % 60 = 0 THEN '' ELSE (ms // 1000 % 60) || 's' END ELSE (ms // 3600000) || 'h' || CASE WHEN ms // 60000 % 60 = 0 THEN '' ELSE (ms // 60000 % 60) || 'm' END END AS text FROM num", "num")
oracle("format_duration", f"SELECT id, {_DUR.format(s='ms')} AS text FROM num", "num")
oracle("parse_duration", "SELECT id, CASE WHEN ms < 3600 THEN ms ELSE ms // 60 * 60 END AS seconds, CAST(0 AS BIGINT) AS bad FROM num", "num")
oracle("human_uptime", "SELECT id, CASE WHEN ms < 60 THEN ms || 's' WHEN ms < 3600 THEN (ms // 60) || 'm' WHEN ms < 86400 THEN (ms // 3600) || 'h' || CASE WHEN ms // 60 % 60 = 0 THEN '' ELSE ' ' || (ms // 60 % 60) || 'm' END ELSE (ms // 86400) || 'd' || CASE WHEN ms // 3600 % 24 = 0 THEN '' ELSE ' ' || (ms // 3600 % 24) || 'h' END END AS text FROM num", "num")
oracle("format_latency", "SELECT id, CASE WHEN ns = 0 THEN '-' WHEN ns >= 1000000000 THEN printf('%.2fs', ns / 1e9) WHEN ns >= 1000000 THEN (ns // 1000000) || 'ms' WHEN ns >= 1000 THEN (ns // 1000) || 'µs' ELSE ns || 'ns' END AS text FROM (SELECT id, ms * ms AS ns FROM num)", "num")
oracle("ps_to_ns", "SELECT id, ms // 1000 AS ns FROM num", "num")
oracle("severity_label", "SELECT id, ['INFO', 'WARNING', 'CRITICAL'][id % 3 + 1] AS label FROM num", "num")
oracle("issue_kind", "SELECT id, ['long-trx', 'lock-chain', 'ddl', 'deadlock', 'other'][id % 5 + 1] AS kind FROM num", "num")
oracle("format_big_count", "SELECT id, CASE WHEN n >= 1000000000 THEN printf('%.1fB', round(n / 1e9, 1)) WHEN n >= 1000000 THEN printf('%.1fM', round(n / 1e6, 1)) WHEN n >= 1000 THEN printf('%.1fk', round(n / 1e3, 1)) ELSE CAST(n AS VARCHAR) END AS text FROM (SELECT id, ms * id AS n FROM num)", "num")
oracle("format_rate", "SELECT id, CASE WHEN id >= 1000 THEN printf('%.1fk', round(id / 1000, 1)) ELSE CAST(id AS VARCHAR) END AS text FROM num", "num")
oracle("wait_class", f"SELECT event_name, {_CLASS.format(e='event_name')} AS class, count(*) AS n FROM wait_polls GROUP BY 1, 2", "wait_polls")
oracle("strip_port", "SELECT pid, split_part(host, ':', 1) AS host FROM processes", "processes")
oracle("compact_version", "SELECT server_id, split_part(version, '-', 1) AS version FROM servers", "servers")

oracle("stream_digest_deltas", f"SELECT {_KEYS}, {_s('poll_ts')} AS poll_ts, interval_ns, exec_delta, timer_delta FROM dd", "dd")
oracle("stream_wait_load", f"SELECT server_id, {_s('poll_ts')} AS poll_ts, class, interval_ns, count_delta, timer_delta_ps FROM wd", "wd")
oracle("stream_cpu", f"SELECT server_id, {_s('ts')} AS ts, CAST(cpu_observations AS BIGINT) AS cpu_observations, cpu_ticks FROM cpu", "cpu")
oracle("stream_load_window", f"SELECT server_id, {_s('ts')} - 3600 * k AS window_start, count(*) AS observations FROM ss CROSS JOIN range(0, 6) r(k) GROUP BY 1, 2", "ss")

_IDS = "1700000000000 - coalesce((SELECT max(w.wait_ms) FROM lock_waits w WHERE w.waiting_pid = e.waiting_pid), 0)"
_SAID = "CASE WHEN {p}_pid % 7 <> 0 THEN {x} ELSE '' END"
oracle("lock_waits", f"""SELECT server_id, CAST(epoch(lock_waits.snapshot_ts) AS BIGINT) AS snapshot_ts, 't' || waiting_pid AS waiting_trx_id, waiting_pid, CASE WHEN waiting_pid % 2 = 0 THEN 'UPDATE t' || waiting_pid ELSE '' END AS waiting_query, 't' || blocking_pid AS blocking_trx_id, blocking_pid,
    CASE WHEN blocking_pid % 2 = 0 THEN 'UPDATE t' || blocking_pid ELSE {_SAID.format(p='blocking', x="'s' || blocking_pid || '/2'")} END AS blocking_query, CASE WHEN server_id % 2 = 0 THEN '`shop`.`t' || (blocking_pid % 3) || '`' ELSE 'shop.t' || (blocking_pid % 3) END AS lock_table,
    CASE WHEN blocking_pid % 4 <> 0 THEN 'PRIMARY' ELSE '' END AS lock_index, 'X' AS lock_type, {_SAID.format(p='waiting', x="'ds' || waiting_pid")} AS waiting_digest, {_SAID.format(p='blocking', x="'ds' || blocking_pid")} AS blocking_digest, CAST(epoch(lock_waits.snapshot_ts) AS BIGINT) - (wait_ms + 999) // 1000 AS wait_started,
    wait_ms, CASE WHEN waiting_pid % 5 <> 0 THEN 'u' || (waiting_pid % 4) ELSE '' END AS waiting_user, CASE WHEN waiting_pid % 5 <> 0 THEN 'h' ELSE '' END AS waiting_host,
    CASE WHEN blocking_pid % 5 <> 0 THEN 'u' || (blocking_pid % 4) ELSE '' END AS blocking_user, CASE WHEN blocking_pid % 5 <> 0 THEN 'h' ELSE '' END AS blocking_host FROM lock_waits""", "lock_waits")
oracle("chain_text", """SELECT l.server_id, CAST(epoch(l.snapshot_ts) AS BIGINT) AS snapshot_ts, array_to_string(path, '>') AS path, root_label || ' -> ' || list_aggregate(list_transform(path[2:], lambda x: 'PID:' || x || '(w' || (x % 5) || '@h1) shop.t' || (x % 3) || ' [UPDATE t]'), 'string_agg', ' -> ') AS chain_text, 'DELETE t' AS root_query,
    array_to_string(list_transform(path[2:], lambda x: 'UPDATE t'), ', ') AS blocked_queries, 'shop.t' || (path[2] % 3) AS lock_table
    FROM leaves l JOIN (SELECT blocking_pid, arg_max('PID:' || blocking_pid || '(' || blocking_user || '@h2) ' || lock_table || ' [DELETE t]', blocking_user || lock_table) AS root_label FROM lock_waits GROUP BY 1) r ON r.blocking_pid = l.path[1]""", "leaves")
oracle("load_report_as_of", f"SELECT server_id, poll_ts, string_agg(class || '=' || printf('%.6f', aas), ',' ORDER BY ordinal) AS classes, max(total) AS total, 21600 AS window_seconds FROM ({_CLASS_AS_OF}) GROUP BY server_id, poll_ts", "wd", "cpu", "good_polls")
oracle("load_report", f"SELECT server_id, round(whole, 6) AS total, string_agg(class || '=' || printf('%.4f', round(round(raw, 6), 4)), ',' ORDER BY ordinal) AS classes FROM ({_LOAD}) GROUP BY server_id, whole", "wd", "cpu", "good_polls")
_SNAPS = "SELECT server_id, snapshot_ts FROM processes UNION SELECT server_id, snapshot_ts FROM lock_waits UNION SELECT server_id, snapshot_ts FROM lock_rings"
_REPORTS = "SELECT server_id, snapshot_ts, CASE WHEN lo % 3 <> 0 THEN 't' || (lo // 1000) END AS deadlock_ts, [lo + CASE WHEN lo % 2 = 0 THEN 0 ELSE 1 END, hi + 1] AS participants FROM (SELECT server_id, snapshot_ts, min(pid) AS lo, max(pid) AS hi FROM processes GROUP BY 1, 2)"
_DEAD = f"SELECT * FROM (SELECT *, last_value(deadlock_ts IGNORE NULLS) OVER (PARTITION BY server_id ORDER BY snapshot_ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_ts, EXISTS (SELECT 1 FROM processes p WHERE p.server_id = r.server_id AND p.snapshot_ts = r.snapshot_ts AND list_contains(r.participants, p.pid)) AS alive FROM ({_REPORTS}) r) WHERE deadlock_ts IS NOT NULL AND (last_ts IS NULL OR last_ts <> deadlock_ts OR alive)"
oracle("deadlocks", f"SELECT server_id, {_s('snapshot_ts')} AS snapshot_ts, deadlock_ts, array_to_string(participants, '>') AS participants, 2 AS severity FROM ({_DEAD})", "processes")
oracle("stream_deadlocks", f"SELECT server_id, {_s('snapshot_ts')} AS snapshot_ts, deadlock_ts FROM (SELECT *, lag(deadlock_ts) OVER (PARTITION BY server_id ORDER BY snapshot_ts) AS before FROM ({_REPORTS}) WHERE deadlock_ts IS NOT NULL) WHERE before IS DISTINCT FROM deadlock_ts", "processes")
_ISSUES = f"""SELECT server_id, snapshot_ts, 0 AS ordinal, 'long_transaction' AS detector, CASE WHEN age_s >= 300 THEN 2 ELSE 1 END AS severity FROM transactions WHERE age_s >= 30
    UNION ALL SELECT server_id, snapshot_ts, 1, 'lock_chain', severity FROM leaves UNION ALL SELECT server_id, snapshot_ts, 1, 'lock_chain', 2 FROM rings
    UNION ALL SELECT server_id, snapshot_ts, 2, 'ddl_conflict', CASE WHEN time_s >= 10 THEN 2 ELSE 1 END FROM pw WHERE ddl AND state = 'Waiting for table metadata lock'
    UNION ALL SELECT server_id, snapshot_ts, 2, 'ddl_conflict', CASE WHEN time_s >= 10 THEN 2 ELSE 1 END FROM ({_DML_ROWS})
    UNION ALL SELECT server_id, snapshot_ts, 3, 'deadlock', 2 FROM ({_DEAD})"""
# one issue for each statement and DDL statement
_PAIR_ISSUES = _ISSUES.replace(f"FROM ({_DML_ROWS})", f"FROM ({_DML})")
oracle("all_issues", f"SELECT server_id, {_s('snapshot_ts')} AS snapshot_ts, ordinal, detector, severity, count(*) AS issues FROM ({_PAIR_ISSUES}) i GROUP BY server_id, i.snapshot_ts, ordinal, detector, severity", "pw", "transactions", "leaves", "rings")
oracle("max_severity", f"SELECT server_id, {_s('s.snapshot_ts')} AS snapshot_ts, coalesce((SELECT max(severity) FROM ({_ISSUES}) i WHERE i.server_id = s.server_id AND i.snapshot_ts = s.snapshot_ts), 0) AS severity FROM ({_SNAPS}) s", "pw", "transactions", "leaves", "rings")
_COUNT = "(SELECT count(*) FROM {t} x WHERE x.server_id = s.server_id AND x.snapshot_ts = s.snapshot_ts) AS {n}"
oracle("snapshot_counts", f"SELECT server_id, {_s('s.snapshot_ts')} AS snapshot_ts, {', '.join(_COUNT.format(t=t, n=t) for t in ('processes', 'transactions', 'metadata_locks', 'lock_waits'))}, {_COUNT.format(t='(' + _PAIR_ISSUES + ')', n='issues')}, {_COUNT.format(t='(' + _DEAD + ')', n='deadlocks')} FROM ({_SNAPS}) s", "pw", "transactions", "metadata_locks", "leaves", "rings")
oracle("stream_report_log", f"SELECT server_id, {_s('s.snapshot_ts')} AS snapshot_ts, coalesce((SELECT version FROM servers v WHERE v.server_id = s.server_id), '') AS server, {', '.join(_COUNT.format(t=t, n=t) for t in ('processes', 'transactions', 'lock_waits'))}, ['INFO', 'WARNING', 'CRITICAL'][coalesce((SELECT max(severity) FROM ({_ISSUES}) i WHERE i.server_id = s.server_id AND i.snapshot_ts = s.snapshot_ts), 0) + 1] AS max_severity, CAST({_COUNT.format(t='(' + _ISSUES + ')', n='issues').replace(' AS issues', '')} AS INTEGER) AS issues, CAST({_COUNT.format(t='(SELECT * FROM (' + _ISSUES + ') WHERE severity = 2)', n='critical').replace(' AS critical', '')} AS INTEGER) AS critical, CAST({_COUNT.format(t='(' + _ISSUES + ')', n='described').replace(' AS described', '')} AS INTEGER) AS described FROM ({_SNAPS}) s", "pw", "transactions", "leaves", "rings", "servers")
oracle("format_bytes", "SELECT id, CASE WHEN n >= 1073741824 THEN printf('%.1fGB', round(n / 1073741824, 1)) WHEN n >= 1048576 THEN printf('%.0fMB', round(n / 1048576)) WHEN n >= 1024 THEN printf('%.0fKB', round(n / 1024)) ELSE n || 'B' END AS text FROM (SELECT id, ms * id AS n FROM num)", "num")

_PLAN = """concat('query_block{select_id=1}', chr(10), 'query_block/ordering_operation{using_filesort=', CASE WHEN p_partkey % 4 = 0 THEN 'true' ELSE 'false' END, '}', chr(10), 'query_block/ordering_operation/nested_loop{}', chr(10), 'query_block/ordering_operation/nested_loop/0000{}', chr(10),
    'query_block/ordering_operation/nested_loop/0000/table{access_type="', CASE WHEN p_partkey % 3 = 0 THEN 'ALL' ELSE 'ref' END, '";table_name="', p_brand, '"}', chr(10), 'query_block/ordering_operation/nested_loop/0001{}', chr(10), 'query_block/ordering_operation/nested_loop/0001/table{access_type="eq_ref";table_name="dim"}')"""
ORACLES["plan_hash"] = f"SELECT p_type AS digest, p_partkey AS ts, sha256({_PLAN}) AS plan_hash FROM part"
ORACLES["plan_flips"] = ORACLES["stream_plan_flips"] = f"SELECT digest, ts, prior_hash, new_hash FROM (SELECT digest, ts, plan_hash AS new_hash, lag(plan_hash) OVER (PARTITION BY digest ORDER BY ts) AS prior_hash FROM ({ORACLES['plan_hash']})) WHERE prior_hash <> new_hash"

_FOUND = f"""SELECT server_id, snapshot_ts, 'long_transaction' AS detector, CASE WHEN age_s >= 300 THEN 2 ELSE 1 END AS severity, 1 AS n, pid, user_name AS u, CASE WHEN digest_text <> '' THEN digest_text ELSE query END AS q, NULL AS t, age_s FROM transactions WHERE age_s >= 30
    UNION ALL SELECT server_id, snapshot_ts, 'lock_chain', severity, 1, path[1], '', 'DELETE t', 'shop.t' || (path[2] % 3), 0 FROM leaves
    UNION ALL SELECT server_id, snapshot_ts, 'lock_chain', 2, 1, NULL, '', '', NULL, 0 FROM rings
    UNION ALL SELECT server_id, snapshot_ts, 'ddl_conflict', CASE WHEN time_s >= 10 THEN 2 ELSE 1 END, 1, pid, user_name, info, NULL, time_s FROM pw WHERE ddl AND state = 'Waiting for table metadata lock'
    UNION ALL SELECT server_id, snapshot_ts, 'ddl_conflict', CASE WHEN time_s >= 10 THEN 2 ELSE 1 END, 1, pid, user_name, info, NULL, time_s FROM ({_DML_ROWS})
    UNION ALL SELECT d.server_id, d.snapshot_ts, 'deadlock', 2, CAST(d.n AS INTEGER), d.pid, coalesce(p.user_name, ''), coalesce(p.info, ''), NULL, 0 FROM (SELECT server_id, snapshot_ts, n, participants[n] AS pid FROM ({_DEAD}) x, (VALUES (1), (2)) AS k(n)) d LEFT JOIN processes p ON p.server_id = d.server_id AND p.snapshot_ts = d.snapshot_ts AND p.pid = d.pid"""
_ROWS = f"""SELECT server_id, snapshot_ts, detector, severity, n, nullif(pid, 0) AS pid, u AS user_name, q AS query, CASE WHEN t IS NOT NULL THEN t WHEN t2 <> '' THEN t1 || '.' || t2 ELSE t1 END AS table_name, age_s FROM ({_named(_FOUND, 'q')})"""
_PAIR_ROWS = _ROWS.replace(f"FROM ({_DML_ROWS})", f"FROM ({_DML})")
_NEED = ("pw", "transactions", "leaves", "rings")
oracle("issue_rows", f"SELECT * REPLACE ({_s('r.snapshot_ts')} AS snapshot_ts) FROM ({_PAIR_ROWS}) r", *_NEED)
oracle("issues_by_table", f"SELECT server_id, {_s('r.snapshot_ts')} AS snapshot_ts, detector, pid, age_s FROM ({_ROWS}) r WHERE table_name = 'shop.t1'", *_NEED)
oracle("issues_per_table", f"SELECT server_id, {_s('r.snapshot_ts')} AS snapshot_ts, CASE WHEN table_name <> '' THEN table_name ELSE '(idle: no SQL captured)' END AS bucket, count(*) AS issues, count(*) FILTER (severity = 2) AS critical, count(*) FILTER (severity = 1) AS warning, count(*) FILTER (severity = 0) AS info, max(severity) AS max_severity, max(age_s) AS oldest_s, count(DISTINCT pid) AS pids FROM ({_PAIR_ROWS}) r GROUP BY server_id, r.snapshot_ts, bucket", *_NEED)
oracle("issues_by_bucket", f"SELECT server_id, {_s('r.snapshot_ts')} AS snapshot_ts, detector, pid, age_s FROM ({_ROWS}) r WHERE table_name = ''", *_NEED)
_A_LABEL = "['INFO', 'WARNING', 'CRITICAL'][{} + 1]"
_AGE = _DUR.format(s="age_s")
_SAID_Q = "CASE WHEN digest_text <> '' THEN digest_text ELSE query END"


def _json(**items: str) -> str:
    """JSON text of an object of texts; no value here has a character that JSON escapes."""
    return "concat('{', " + ", ',', ".join(f"""'"{k}":"', {v}, '"'""" for k, v in items.items()) + ", '}')"


_ROOT = "SELECT blocking_pid, arg_max('PID:' || blocking_pid || '(' || blocking_user || '@h2) ' || lock_table || ' [DELETE t]', blocking_user || lock_table) AS root_label FROM lock_waits GROUP BY 1"
_CHAINS = f"""SELECT l.server_id, l.snapshot_ts AS ts, severity, depth, path, root_label || ' -> ' || list_aggregate(list_transform(path[2:], lambda x: 'PID:' || x || '(w' || (x % 5) || '@h1) shop.t' || (x % 3) || ' [UPDATE t]'), 'string_agg', ' -> ') AS chain FROM leaves l JOIN ({_ROOT}) r ON r.blocking_pid = l.path[1]"""
_WAIT_LEVEL = "CASE WHEN time_s >= 10 THEN 2 ELSE 1 END"
_WHOLE = f"""SELECT server_id, snapshot_ts AS ts, 0 AS ordinal, 'long_transaction' AS detector, CASE WHEN age_s >= 300 THEN 2 ELSE 1 END AS level, 'Transaction running for ' || {_AGE} AS title, 'Transaction of ' || user_name || '@' || host || ' has run for ' || {_AGE} || ': ' || {_SAID_Q} AS description,
    {_json(thread_id='pid', database='db', user='user_name', host='host', query=_SAID_Q, duration=_AGE)} AS details FROM transactions WHERE age_s >= 30
    UNION ALL SELECT server_id, ts, 1, 'lock_chain', severity, 'Lock chain detected (depth ' || depth || ')', chain, {_json(chain_depth='depth', root_blocker='path[1]', chain='chain', root_query="'DELETE t'", blocked_queries="array_to_string(list_transform(path[2:], lambda x: 'UPDATE t'), ', ')", lock_table="'shop.t' || (path[2] % 3)")} FROM ({_CHAINS})
    UNION ALL SELECT server_id, snapshot_ts, 1, 'lock_chain', 2, 'Lock cycle detected (' || len(path) || ' participants)', 'Sessions wait for each other: ' || array_to_string(path, ' -> '), {_json(cycle_size='len(path)')} FROM rings
    UNION ALL SELECT server_id, ts, 2, 'ddl_conflict', {_WAIT_LEVEL}, 'DDL blocked by metadata lock: ' || info, 'DDL of ' || user_name || '@' || host || ' on ' || db || ' waits for a metadata lock for ' || time_s || ' s: ' || info || '. May be blocked by ' || blockers,
    {_json(ddl_pid='pid', user='user_name', host='host', database='db', query='info', wait_seconds='time_s', blockers='blockers')} FROM (SELECT d.server_id, d.snapshot_ts AS ts, d.pid, d.db, d.time_s, d.blockers, q.user_name, q.host, q.info FROM ({_DB}) d JOIN pw q ON q.server_id = d.server_id AND q.snapshot_ts = d.snapshot_ts AND q.pid = d.pid)
    UNION ALL SELECT server_id, snapshot_ts, 2, 'ddl_conflict', {_WAIT_LEVEL}, 'DML blocked by DDL', 'Statement of ' || user_name || '@' || host || ' waits for ' || time_s || ' s for DDL ' || ddl_pid || ': ' || info, {_json(blocked_pid='pid', ddl_pid='ddl_pid', user='user_name', host='host', query='info', wait_seconds='time_s')} FROM ({_DML})
    UNION ALL SELECT server_id, snapshot_ts, 3, 'deadlock', 2, 'Deadlock detected', 'Deadlock at ' || deadlock_ts || ': ' || array_to_string(participants, ' <-> '), {_json(timestamp='deadlock_ts', participants='len(participants)', trx1_thread_id='participants[1]', trx2_thread_id='participants[2]')} FROM ({_DEAD})"""
oracle("snapshot_report", f"""SELECT s.server_id, {_s('s.snapshot_ts')} AS snapshot_ts, server, processes, transactions, lock_waits, {_A_LABEL.format('coalesce(worst, 0)')} AS max_severity, ordinal, detector, {_A_LABEL.format('level')} AS severity, title, description, details
    FROM (SELECT server_id, s.snapshot_ts, coalesce((SELECT version FROM servers v WHERE v.server_id = s.server_id), '') AS server, {', '.join(_COUNT.format(t=t, n=t) for t in ('processes', 'transactions', 'lock_waits'))} FROM ({_SNAPS}) s) s
    LEFT JOIN (SELECT *, max(level) OVER (PARTITION BY server_id, ts) AS worst FROM ({_WHOLE})) i ON i.server_id = s.server_id AND i.ts = s.snapshot_ts""", "pw", "transactions", "leaves", "rings", "servers")

_SIGNALS = {
    "b": "SELECT server_id, CAST('2024-01-01' AS TIMESTAMP) + INTERVAL '1' MINUTE * snapshot AS ts, CAST(regexp_extract(status_text, 'History list length ([0-9]+)', 1) AS BIGINT) * 2000 AS value FROM status_texts",
    "c": "SELECT server_id, CAST('2024-01-01' AS TIMESTAMP) + INTERVAL '1' HOUR * poll_s AS ts, CASE WHEN poll_s % 6 <> 0 THEN CAST(lag AS BIGINT) END AS value FROM replica_rows",
    "e": "SELECT CAST(substring(instance, 4) AS BIGINT) AS server_id, ts, max(value) AS value FROM cloud_metrics WHERE metric_name = 'CPUUtilization' GROUP BY 1, 2",
    "f": f"SELECT server_id, snapshot_ts AS ts, coalesce((SELECT max(severity) FROM ({_ISSUES}) i WHERE i.server_id = s.server_id AND i.snapshot_ts = s.snapshot_ts), 0) AS value FROM ({_SNAPS}) s",
}
_LIMITS = {"a": ("rr", 0.5, 0.8), "b": ("b", 1_000_000, 5_000_000), "c": ("c", 5, 30), "e": ("e", 80, 95)}
_JOINS = " ".join(f"ASOF LEFT JOIN ({q}) {n} ON v.server_id = {n}.server_id AND v.poll_ts >= {n}.ts" for n, q in _SIGNALS.items())
_FRESH = ", ".join(f"CASE WHEN epoch(v.poll_ts) - epoch({n}.ts) <= 172800 THEN {n}.value END AS {n}" for n in _SIGNALS)
_LEVELS = ", ".join(f"CASE WHEN {c} > {page} THEN 2 WHEN {c} > {warn} THEN 1 ELSE 0 END AS l{n}" for n, (c, warn, page) in _LIMITS.items())
oracle("verdict_as_of", f"""SELECT server_id, poll_ts, level, ['HEALTHY', 'WARN', 'PAGE'][level + 1] AS verdict, CASE WHEN level = 0 THEN NULL WHEN la = level THEN 'running_ratio' WHEN lb = level THEN 'history_length' WHEN lc = level THEN 'replica_lag' WHEN ld = level THEN 'aborted_clients' WHEN le = level THEN 'cloud_cpu' ELSE 'issues' END AS driver
    FROM (SELECT *, greatest(la, lb, lc, ld, le, lf) AS level FROM (SELECT server_id, {_s('poll_ts')} AS poll_ts, {_LEVELS}, CASE WHEN d > 0 THEN 1 ELSE 0 END AS ld, CAST(coalesce(f, 0) AS INTEGER) AS lf FROM (SELECT v.server_id, v.poll_ts, v.rr, v.d, {_FRESH} FROM (
    SELECT server_id, poll_ts, CASE WHEN threads_connected = 0 THEN 0 ELSE round(threads_running / threads_connected, 6) END AS rr, aborted_clients - lag(aborted_clients, 1, 0) OVER (PARTITION BY server_id ORDER BY poll_ts) AS d FROM hv) v {_JOINS}) g))""", "hv", "status_texts", "replica_rows", "cloud_metrics", *_NEED)
