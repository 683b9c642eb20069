"""Health gauges, ratios, replication state and the verdict per snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Status variables of the wide row, in its order.
VARIABLES = {
    "Uptime": "uptime_s", "Threads_running": "threads_running", "Threads_connected": "threads_connected", "Innodb_buffer_pool_pages_dirty": "bp_pages_dirty",
    "Innodb_buffer_pool_pages_total": "bp_pages_total", "Innodb_buffer_pool_read_requests": "bp_read_requests", "Innodb_buffer_pool_reads": "bp_reads", "Aborted_clients": "aborted_clients",
}
VERDICTS = ("HEALTHY", "WARN", "PAGE")


def health_vitals(status_vars: DataFrame) -> DataFrame:
    """Name and value rows to one wide row per server and poll; what does not parse is 0."""
    wide = status_vars.groupBy("server_id", "poll_ts").pivot("variable_name", list(VARIABLES)).agg(F.max(F.expr("try_cast(value AS BIGINT)")))
    return wide.select("server_id", "poll_ts", *(F.coalesce(F.col(k), F.lit(0)).alias(v) for k, v in VARIABLES.items()))


def health_ratios(vitals: DataFrame) -> DataFrame:
    requests, reads = F.col("bp_read_requests"), F.col("bp_reads")
    hit = F.when(requests == 0, 0.0).when(reads > requests, 1.0).otherwise((requests - reads) / requests)
    running = F.when(F.col("threads_connected") == 0, 0.0).otherwise(F.col("threads_running") / F.col("threads_connected"))
    return vitals.withColumn("bp_hit", F.round(hit, 6)).withColumn("running_ratio", F.round(running, 6))


def verdict(gauges: DataFrame) -> DataFrame:
    """HEALTHY, WARN or PAGE by the worst gauge, and which one that is (the first of equals).

    Gauges: running_ratio, history_length, replica_lag_s, aborted_delta, cloud_cpu, max_severity; null is no signal."""
    level = lambda c, warn, page: F.when(F.col(c) > page, 2).when(F.col(c) > warn, 1).otherwise(0)
    levels = {"running_ratio": level("running_ratio", 0.5, 0.8), "history_length": level("history_length", 1_000_000, 5_000_000), "replica_lag": level("replica_lag_s", 5, 30), "aborted_clients": F.when(F.col("aborted_delta") > 0, 1).otherwise(0), "cloud_cpu": level("cloud_cpu", 80, 95), "issues": F.coalesce("max_severity", F.lit(0))}
    worst = F.greatest(*levels.values())
    by = F
    for name, c in levels.items():
        by = by.when(c == worst, name)
    return gauges.withColumn("level", worst).withColumn("driver", F.when(worst > 0, by)).withColumn("verdict", F.element_at(F.array(*(F.lit(v) for v in VERDICTS)), worst + 1))


def as_of(base: DataFrame, signals: dict[str, DataFrame], within_s: int) -> DataFrame:
    """``base`` (server_id, poll_ts, ...) and, for each of ``signals`` (server_id, ts, value), a column with the value that
    was the latest at poll_ts, if it was at most ``within_s`` old. Of one instant the greatest value counts.

    Time is cut into spans of ``within_s`` and a signal is seen in its own and the next, so a window holds one server's
    rows of one span and not its whole history."""
    span = lambda ts: F.floor(F.unix_micros(ts) / (within_s * 1_000_000))
    rows = base.select("server_id", span("poll_ts").alias("span"), F.col("poll_ts").alias("ts"), F.struct(*base.columns).alias("base"))
    for name, df in signals.items():
        latest = df.filter("ts is not null").groupBy("server_id", "ts").agg(F.max("value").alias("value")).withColumn("span", F.explode(F.array(span("ts"), span("ts") + 1)))
        rows = rows.unionByName(latest.select("server_id", "span", "ts", F.struct("ts", "value").alias(name)), allowMissingColumns=True)
    seen = Window.partitionBy("server_id", "span").orderBy("ts", F.col("base").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("base", "ts", *(F.last(name, ignorenulls=True).over(seen).alias(name) for name in signals)).filter("base is not null")
    fresh = lambda name: F.unix_micros("ts") - F.unix_micros(F.col(name)["ts"]) <= within_s * 1_000_000
    return rows.select("base.*", *(F.when(fresh(name), F.col(name)["value"]).alias(name) for name in signals))


def replica_status(rows: DataFrame) -> DataFrame:
    """``status`` is the status row as a map; names differ by version, the first that is not empty counts."""
    pick = lambda *names: F.coalesce(*(F.nullif(F.try_element_at("status", F.lit(n)), F.lit("")) for n in names))
    yes = lambda c: F.coalesce(F.lower(c) == "yes", F.lit(False))
    has = F.col("status").isNotNull() & (F.size("status") > 0)
    lag = pick("Seconds_Behind_Source", "Seconds_Behind_Master").try_cast("bigint")
    return rows.select(
        *(c for c in rows.columns if c != "status"), F.when(has, "replica").otherwise("standalone").alias("role"), yes(pick("Replica_IO_Running", "Slave_IO_Running")).alias("io_running"), yes(pick("Replica_SQL_Running", "Slave_SQL_Running")).alias("sql_running"),
        F.coalesce(lag, F.lit(-1)).alias("lag_s"), F.coalesce(pick("Last_Error"), F.lit("")).alias("last_error"), F.coalesce(pick("Retrieved_Gtid_Set"), F.lit("")).alias("gtid_retrieved"),
    )


def replication_health(replicas: DataFrame, warn_s: int = 5, critical_s: int = 30) -> DataFrame:
    level = F.when(F.col("lag_s") > critical_s, 2).when((F.col("lag_s") > warn_s) | ~F.col("io_running") | ~F.col("sql_running"), 1).otherwise(0)
    return replicas.filter("role = 'replica'").withColumn("severity", level).withColumn("lag_known", F.col("lag_s") >= 0)
