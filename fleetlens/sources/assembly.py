"""Relations assembled from landed system tables, for all servers and polls at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Metrics of a cloud host, with the unit factor to what is reported (seconds and ms become ns).
METRICS = {
    "CPUUtilization": ("cpu_percent", 1), "DatabaseConnections": ("connections", 1), "FreeableMemory": ("free_memory_bytes", 1), "ReadIOPS": ("read_iops", 1), "WriteIOPS": ("write_iops", 1), "ReadLatency": ("read_latency_ns", 10**9),
    "WriteLatency": ("write_latency_ns", 10**9), "DiskQueueDepth": ("queue_depth", 1), "AuroraReplicaLag": ("replica_lag_ns", 10**6), "BufferCacheHitRatio": ("cache_hit_percent", 1), "Deadlocks": ("deadlocks_per_s", 1), "VolumeBytesUsed": ("volume_bytes", 1),
}
MDL_INSTRUMENT = "wait/lock/metadata/sql/mdl"
AURORA_ONLY = ("AuroraReplicaLag", "BufferCacheHitRatio", "Deadlocks", "VolumeBytesUsed")


def digest_scan(rows: DataFrame) -> DataFrame:
    return rows.filter("digest is not null").withColumn("schema_name", F.coalesce("schema_name", F.lit(""))).withColumn("digest_text", F.coalesce("digest_text", F.lit("")))


def wait_scan(rows: DataFrame) -> DataFrame:
    return rows.filter("count_star > 0")


def session_ticks(threads: DataFrame, statements: DataFrame, waits: DataFrame, attributes: DataFrame) -> DataFrame:
    """Foreground threads with their current statement, latest wait that is not idle and program name (the least)."""
    key = ["server_id", "tick_ts", "thread_id"]
    latest = waits.filter("event_name <> 'idle'").groupBy(*key).agg(F.max_by("event_name", "event_id").alias("current_wait"))
    program = attributes.filter("attr_name = 'program_name'").groupBy("server_id", "tick_ts", "processlist_id").agg(F.min("attr_value").alias("program_name"))
    rows = threads.filter("type = 'FOREGROUND' and processlist_id is not null").join(statements, key, "left").join(latest, key, "left").join(program, ["server_id", "tick_ts", "processlist_id"], "left")
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    executing = F.col("event_id").isNotNull() & F.col("end_event_id").isNull()
    return rows.select("server_id", "tick_ts", "processlist_id", *(text(c) for c in ("schema_name", "digest", "sql_text")), executing.alias("executing"), *(text(c) for c in ("current_wait", "program_name", "user_name", "host")))


def transactions(processes: DataFrame, trx: DataFrame, threads: DataFrame, statements: DataFrame) -> DataFrame:
    """Processes with an open transaction, their current statement's digest text, and the age at the snapshot."""
    at = ["server_id", "snapshot_ts"]
    rows = processes.join(trx, [*at, "pid"]).join(threads.select(*at, "pid", "thread_id"), [*at, "pid"], "left").join(statements.select(*at, "thread_id", "digest_text"), [*at, "thread_id"], "left")
    started = F.coalesce("trx_started", "snapshot_ts")
    return rows.select(*at, "pid", *(F.coalesce(c, F.lit("")).alias(c) for c in ("user_name", "host", "db", "command", "state")), F.coalesce("time_s", F.lit(0)).alias("time_s"), F.coalesce("trx_query", F.lit("")).alias("query"), F.coalesce("digest_text", F.lit("")).alias("digest_text"), "trx_id", "trx_state", started.alias("trx_started"), (F.unix_seconds("snapshot_ts") - F.unix_seconds(started)).alias("age_s"))


def lock_tables(old_waits: DataFrame, old_locks: DataFrame, new_waits: DataFrame, new_locks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Waits and locks of servers of both dialects under one set of names.

    ``old_*`` are the tables of 5.7 (requesting_trx_id, blocking_trx_id, blocking_lock_id; lock_id, lock_table, lock_index,
    lock_mode), ``new_*`` those of 8.0 (requesting_engine_transaction_id, blocking_engine_transaction_id,
    blocking_engine_lock_id; engine_lock_id, object_schema, object_name, index_name, lock_mode). A server has one of them."""
    at = ["server_id", "snapshot_ts"]
    text = lambda c: F.coalesce(c, F.lit(""))
    waits = old_waits.select(*at, F.col("requesting_trx_id").alias("waiting_trx_id"), "blocking_trx_id", "blocking_lock_id").unionByName(
        new_waits.select(*at, F.col("requesting_engine_transaction_id").alias("waiting_trx_id"), F.col("blocking_engine_transaction_id").alias("blocking_trx_id"), F.col("blocking_engine_lock_id").alias("blocking_lock_id"))
    )
    locks = old_locks.select(*at, F.col("lock_id").alias("blocking_lock_id"), "lock_table", "lock_index", F.col("lock_mode").alias("lock_type")).unionByName(
        new_locks.select(*at, F.col("engine_lock_id").alias("blocking_lock_id"), F.concat(text("object_schema"), F.lit("."), text("object_name")).alias("lock_table"), F.col("index_name").alias("lock_index"), F.col("lock_mode").alias("lock_type"))
    )
    return waits, locks


def lock_waits(waits: DataFrame, locks: DataFrame, trx: DataFrame, processes: DataFrame, threads: DataFrame, statements: DataFrame) -> DataFrame:
    """Edges: waits with both transactions, the blocking lock, both processes and both sessions' current statements.

    ``waits`` and ``locks`` are those of `lock_tables`. A blocker that runs nothing shows the text of its thread's current
    statement. A thread has one statement here, the latest by event_id."""
    at = ["server_id", "snapshot_ts"]
    side = lambda p: trx.select(*at, F.col("trx_id").alias(f"{p}_trx_id"), F.col("pid").alias(f"{p}_pid"), F.col("trx_query").alias(f"{p}_query"), F.col("wait_started").alias(f"{p}_since"))
    who = lambda p: processes.select(*at, F.col("pid").alias(f"{p}_pid"), F.col("user_name").alias(f"{p}_user"), F.col("host").alias(f"{p}_host"))
    current = statements.groupBy(*at, "thread_id").agg(F.max_by(F.struct("sql_text", "digest_text"), "event_id").alias("s"))
    said = threads.select(*at, "pid", "thread_id").join(current, [*at, "thread_id"]).groupBy(*at, "pid").agg(F.max_by("s", "thread_id").alias("s"))
    says = lambda p: said.select(*at, F.col("pid").alias(f"{p}_pid"), F.col("s.sql_text").alias(f"{p}_text"), F.col("s.digest_text").alias(f"{p}_digest"))
    rows = waits.join(side("waiting"), [*at, "waiting_trx_id"]).join(side("blocking"), [*at, "blocking_trx_id"]).join(locks, [*at, "blocking_lock_id"])
    for p in ("waiting", "blocking"):
        rows = rows.join(who(p), [*at, f"{p}_pid"], "left").join(says(p), [*at, f"{p}_pid"], "left")
    wait = F.coalesce(F.expr("div(timestampdiff(MICROSECOND, waiting_since, snapshot_ts), 1000)"), F.lit(0))
    texts = ("waiting_query", "waiting_digest", "waiting_user", "waiting_host", "blocking_digest", "blocking_user", "blocking_host", "lock_table", "lock_index", "lock_type")
    return rows.select(*at, "waiting_trx_id", "waiting_pid", "blocking_trx_id", "blocking_pid", F.coalesce("blocking_query", "blocking_text", F.lit("")).alias("blocking_query"), *(F.coalesce(c, F.lit("")).alias(c) for c in texts), F.coalesce("waiting_since", "snapshot_ts").alias("wait_started"), wait.alias("wait_ms"))


def processes(rows: DataFrame) -> DataFrame:
    """The process list without nulls; a report sorts it by time_s downwards and pid."""
    return rows.select("server_id", "snapshot_ts", "pid", *(F.coalesce(c, F.lit("")).alias(c) for c in ("user_name", "host", "db", "command", "state", "info")), F.coalesce("time_s", F.lit(0)).alias("time_s"))


def metadata_locks(locks: DataFrame, threads: DataFrame) -> DataFrame:
    """TABLE-scope locks with the thread that owns them; a report sorts them by schema, name, state_order (unknown
    states, GRANTED, PENDING), time_s downwards and thread."""
    rows = locks.filter("object_type = 'TABLE'").join(threads.select("server_id", "snapshot_ts", "thread_id", F.col("pid").alias("owner_pid")), ["server_id", "snapshot_ts", "thread_id"], "left")
    return rows.withColumn("state_order", F.when(F.col("lock_status") == "GRANTED", 1).when(F.col("lock_status") == "PENDING", 2).otherwise(0))


def innodb_status_metrics(texts: DataFrame) -> DataFrame:
    section = F.regexp_extract("status_text", r"(?s)\nTRANSACTIONS\n-+\n(.*?)(?:\n-{3,}\n[A-Z]|$)", 1)
    rows = texts.withColumn("section", F.when(section != "", section).otherwise(F.regexp_extract("status_text", r"(?s)^TRANSACTIONS\n-+\n(.*?)(?:\n-{3,}\n[A-Z]|$)", 1)))
    number = lambda c, p: F.regexp_extract(c, p, 1).try_cast("decimal(20,0)")
    return rows.select(
        *(c for c in texts.columns if c != "status_text"), F.coalesce(number("status_text", r"History list length (\d+)"), F.lit(0)).alias("history_length"), F.regexp_count("section", F.lit("ACTIVE")).alias("active"),
        F.regexp_count("section", F.lit("LOCK WAIT")).alias("lock_waits"), F.coalesce(number("section", r"Trx id counter (\d+)"), F.lit(0)).alias("trx_id_counter"),
    )


def deadlock_participants(texts: DataFrame) -> DataFrame:
    """One row per participant of the latest deadlock in each status text, with the time on the section's first line."""
    keep = [c for c in texts.columns if c != "status_text"]
    section = F.regexp_extract("status_text", r"(?s)LATEST DETECTED DEADLOCK\n-+\n(.*?)(?:\n-{3,}\n[A-Z]|$)", 1)
    rows = texts.select(*keep, section.alias("s")).filter("s <> ''")
    blocks = F.filter(F.split("s", r"(?=\*\*\* \(\d+\) TRANSACTION:)"), lambda b, i: i > 0)
    rows = rows.select(*keep, F.substring(F.regexp_extract("s", r"^\s*([^\n]*)", 1), 1, 19).alias("deadlock_ts"), F.posexplode(blocks).alias("n", "b"))
    part = lambda p: F.regexp_extract("b", p, 1)
    origin = part(r"(?:MySQL|MariaDB) thread id \d+, OS thread handle \S+, query id \d+ ([^\n]*)")
    return rows.select(
        *keep, "deadlock_ts", (F.col("n") + 1).alias("n"), part(r"TRANSACTION (\w+), ").alias("trx_id"), F.coalesce(part(r"thread id (\d+)").try_cast("bigint"), F.lit(0)).alias("thread_id"),
        F.split_part(origin, F.lit(" "), F.lit(1)).alias("host"), F.regexp_extract(origin, r"^\S+(?: \d+\.\d+\.\d+\.\d+)? (\S+)", 1).alias("user_name"), F.replace(part(r"of table (\S+) "), F.lit("`"), F.lit("")).alias("table_name"), part(r"index (\S+) of table").alias("index_name"), part(r"lock_mode (\w+)").alias("lock_mode"), part(r"thread id [^\n]*\n([^\n]*)").alias("query"),
    )


def server_info(servers: DataFrame) -> DataFrame:
    parts = F.split(F.substring_index("version", "-", 1), r"\.")
    number = F.when(F.size(parts) < 3, 0).otherwise(parts[0].try_cast("int") * 10000 + parts[1].try_cast("int") * 100 + parts[2].try_cast("int"))
    lower = F.lower("version")
    maria = lower.contains("mariadb")
    return servers.select("server_id", "version", F.coalesce(number, F.lit(0)).alias("version_number"), maria.alias("is_mariadb"), lower.contains("aurora").alias("is_aurora"), (F.col("has_rds_kill") & ~maria).alias("is_rds"))


def capability_audit(consumers: DataFrame, tables: DataFrame, instruments: DataFrame) -> DataFrame:
    """What each server with ``consumers`` (server_id, name, enabled) can tell, and a warning for each thing it cannot.

    ``tables`` (server_id, table_name) says who has connection attributes. A server without the metadata-lock instrument in
    ``instruments`` (server_id, name, enabled) may call it otherwise, so it counts as able."""
    on = lambda n: F.coalesce(F.bool_or((F.col("name") == n) & (F.col("enabled") == "YES")), F.lit(False))
    rows = consumers.groupBy("server_id").agg(on("global_instrumentation").alias("global_on"), on("statements_digest").alias("digest_on"), on("events_waits_current").alias("waits_on"), on("events_statements_history_long").alias("history_long"))
    attributes = tables.filter(F.col("table_name") == "session_connect_attrs").select("server_id").distinct().withColumn("attributes", F.lit(True))
    mdl = instruments.filter(F.col("name") == MDL_INSTRUMENT).groupBy("server_id").agg(F.coalesce(F.bool_or(F.col("enabled") == "YES"), F.lit(False)).alias("mdl"))
    rows = rows.join(attributes, "server_id", "left").join(mdl, "server_id", "left")
    rows = rows.select(
        "server_id", "global_on", (F.col("digest_on") & F.col("global_on")).alias("digest"), (F.col("waits_on") | F.col("global_on")).alias("waits"), "history_long",
        F.coalesce("attributes", F.lit(False)).alias("connect_attributes"), F.coalesce("mdl", F.lit(True)).alias("mdl"),
    )
    missing = F.when(~F.col("global_on"), "global_instrumentation").otherwise("statements_digest")
    warnings = F.array_compact(F.array(
        F.when(~F.col("digest"), F.concat(F.lit("no statement digests: consumer "), missing, F.lit(" is off"))), F.when(~F.col("waits"), "no wait events: consumer global_instrumentation is off"),
        F.when(~F.col("history_long"), "no recent examples: consumer events_statements_history_long is off"), F.when(~F.col("connect_attributes"), "no connection attributes: applications are told by comments only"),
        F.when(~F.col("mdl"), f"no metadata locks: instrument {MDL_INSTRUMENT} is off"),
    ))
    return rows.withColumn("warnings", warnings).drop("global_on")


def cloud_metrics_latest(points: DataFrame, as_of: Column, window_s: int = 300) -> DataFrame:
    """The latest value of each metric within the window; missing and negative ones are 0, in the reported unit."""
    rows = points.filter((F.unix_micros("ts") > F.unix_micros(as_of) - window_s * 1_000_000) & (F.col("ts") <= as_of)).filter(F.col("is_aurora") | ~F.col("metric_name").isin(*AURORA_ONLY))
    wide = rows.groupBy("instance", "is_aurora", "metric_name").agg(F.max_by("value", F.struct("ts", "value")).alias("value")).groupBy("instance", "is_aurora").pivot("metric_name", list(METRICS)).agg(F.max("value"))
    return wide.select("instance", "is_aurora", *(F.round(F.greatest(F.coalesce(F.col(k), F.lit(0.0)), F.lit(0.0)) * f, 4).alias(n) for k, (n, f) in METRICS.items()))


def rds_target(servers: DataFrame, region: str | None = None, instance: str | None = None) -> DataFrame:
    pattern = r"^([^.]+)\.[^.]+\.([a-z0-9-]+)\.rds\.amazonaws\.com"
    pick = lambda given, n: F.coalesce(F.nullif(F.lit(given or ""), F.lit("")), F.regexp_extract("host", pattern, n))
    rows = servers.select("server_id", "host", pick(instance, 1).alias("instance"), pick(region, 2).alias("region"))
    ok = (F.col("instance") != "") & (F.col("region") != "")
    return rows.withColumn("ok", ok).withColumn("reason", F.when(~ok, "host is not an RDS endpoint").otherwise(""))
