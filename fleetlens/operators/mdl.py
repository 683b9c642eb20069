"""Metadata-lock queues, holders and blockers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.operators.pairs import paired

TABLE_KEY = ["server_id", "snapshot_ts", "object_schema", "object_name"]

# The holders that block a waiter, by its lock type.
BLOCKS = {
    "SHARED_READ": "EXCLUSIVE SHARED_NO_READ_WRITE",
    "SHARED_HIGH_PRIO": "EXCLUSIVE SHARED_NO_READ_WRITE",
    "SHARED_WRITE": "EXCLUSIVE SHARED_NO_READ_WRITE SHARED_NO_WRITE",
    "SHARED_WRITE_LOW_PRIO": "EXCLUSIVE SHARED_NO_READ_WRITE SHARED_NO_WRITE",
    "SHARED_UPGRADABLE": "SHARED_UPGRADABLE SHARED_NO_READ_WRITE SHARED_NO_WRITE EXCLUSIVE",
    "SHARED_NO_WRITE": "SHARED_WRITE SHARED_NO_WRITE SHARED_NO_READ_WRITE SHARED_UPGRADABLE EXCLUSIVE",
    "SHARED_NO_READ_WRITE": "SHARED_READ SHARED_HIGH_PRIO SHARED_WRITE SHARED_WRITE_LOW_PRIO SHARED_UPGRADABLE SHARED_NO_WRITE SHARED_NO_READ_WRITE EXCLUSIVE",
    "INTENTION_EXCLUSIVE": "EXCLUSIVE",
    "EXCLUSIVE": "SHARED_READ SHARED_HIGH_PRIO SHARED_WRITE SHARED_WRITE_LOW_PRIO SHARED_UPGRADABLE SHARED_NO_WRITE SHARED_NO_READ_WRITE INTENTION_EXCLUSIVE EXCLUSIVE",
}


def table_locks(locks: DataFrame) -> DataFrame:
    return locks.filter("object_type = 'TABLE' and object_name <> ''")


def mdl_tables(locks: DataFrame) -> DataFrame:
    """Per table: pending and granted requests, the oldest pending wait and pending counts by lock type."""
    rows = table_locks(locks)
    pending = F.col("lock_status") == "PENDING"
    sums = rows.groupBy(*TABLE_KEY).agg(F.count_if(pending).alias("pending"), F.count_if(F.col("lock_status") == "GRANTED").alias("granted"), F.coalesce(F.max(F.when(pending, F.col("time_s"))), F.lit(0)).alias("oldest_wait_s"))
    kinds = rows.filter(pending).groupBy(*TABLE_KEY, "lock_type").agg(F.count("*").alias("n")).groupBy(*TABLE_KEY).agg(F.array_sort(F.collect_list(F.struct("lock_type", "n"))).alias("pending_types"))
    return sums.join(kinds, TABLE_KEY, "left").withColumn("pending_types", F.coalesce("pending_types", F.array().cast("array<struct<lock_type: string, n: bigint>>")))


def queue_positions(locks: DataFrame) -> DataFrame:
    by = Window.partitionBy(*TABLE_KEY)
    rows = table_locks(locks).filter("lock_status = 'PENDING'")
    return rows.select(*TABLE_KEY, "pid", "thread_id", "lock_type", "time_s", F.row_number().over(by.orderBy(F.desc("time_s"), "thread_id")).alias("position"), F.count("*").over(by).alias("depth"))


def holders(locks: DataFrame) -> DataFrame:
    order = Window.partitionBy(*TABLE_KEY).orderBy(F.desc("time_s"), "thread_id")
    return table_locks(locks).filter("lock_status = 'GRANTED'").select(*TABLE_KEY, "pid", "thread_id", "lock_type", "time_s", F.row_number().over(order).alias("place"))


def _matrix() -> Column:
    return F.create_map(*(x for k, v in BLOCKS.items() for x in (F.lit(k), F.array(*(F.lit(t) for t in v.split())))))


def holders_by_type(locks: DataFrame) -> DataFrame:
    """For each table and lock type the number of holders and the one that holds longest."""
    longest = F.max_by("pid", F.struct("time_s", -F.col("thread_id"))).alias("longest_pid")
    return table_locks(locks).filter("lock_status = 'GRANTED'").groupBy(*TABLE_KEY, F.col("lock_type").alias("holding_type")).agg(F.count("*").alias("holders"), longest)


def mdl_blockers(locks: DataFrame) -> DataFrame:
    """Pending requests with what blocks them, by the holders' lock type: how many other sessions hold one, and who holds
    the longest. An unknown request is blocked by all.

    Holders are counted by table and type before they meet the requests, so a request gives at most as many rows as
    there are lock types; a session's own locks (same process or thread) are counted apart and taken off. The names
    behind the numbers are `all_blocker_pairs`, and `blocker_pairs` of a table."""
    rows = table_locks(locks)
    waiting = rows.filter("lock_status = 'PENDING'").select(*TABLE_KEY, F.col("pid").alias("waiting_pid"), F.col("thread_id").alias("wt"), F.col("lock_type").alias("waiting_type"))
    row = F.try_element_at(_matrix(), F.col("waiting_type"))
    met = waiting.join(holders_by_type(locks), TABLE_KEY).filter(row.isNull() | F.array_contains(row, F.col("holding_type")))
    granted = rows.filter("lock_status = 'GRANTED'").select(*TABLE_KEY, "pid", "thread_id", F.col("lock_type").alias("holding_type"))
    of_pid = granted.groupBy(*TABLE_KEY, "holding_type", F.col("pid").alias("waiting_pid")).agg(F.count("*").alias("own"))
    of_thread = granted.filter("thread_id <> 0").groupBy(*TABLE_KEY, "holding_type", F.col("thread_id").alias("wt"), "pid").agg(F.count("*").alias("n"))
    # the locks of the request's thread under another process id: rows of a thread have few ids
    threads = of_thread.groupBy(*TABLE_KEY, "holding_type", "wt").agg(F.collect_list(F.struct("pid", "n")).alias("pids"))
    met = met.join(of_pid, [*TABLE_KEY, "holding_type", "waiting_pid"], "left").join(threads, [*TABLE_KEY, "holding_type", "wt"], "left")
    apart = F.aggregate(F.filter(F.coalesce("pids", F.array().cast("array<struct<pid: bigint, n: bigint>>")), lambda x: x["pid"] != F.col("waiting_pid")), F.lit(0).cast("long"), lambda s, x: s + x["n"])
    met = met.withColumn("blockers", F.col("holders") - F.coalesce("own", F.lit(0)) - apart)
    return met.filter("blockers > 0").select(*TABLE_KEY, "waiting_pid", "waiting_type", "holding_type", "blockers", "longest_pid")


def all_blocker_pairs(locks: DataFrame) -> DataFrame:
    """Pending requests with each holder that blocks them; an unknown request is blocked by all. Requests meet the holders
    of the types that block theirs, not all of the table."""
    rows = table_locks(locks)
    kinds = F.coalesce(F.try_element_at(_matrix(), F.col("waiting_type")), F.array(*map(F.lit, (*BLOCKS, ""))))
    waiting = rows.filter("lock_status = 'PENDING'").select(*TABLE_KEY, F.col("pid").alias("waiting_pid"), F.col("thread_id").alias("wt"), F.col("lock_type").alias("waiting_type"))
    kind = F.when(F.col("lock_type").isin(*BLOCKS), F.col("lock_type")).otherwise("")
    holding = rows.filter("lock_status = 'GRANTED'").select(*TABLE_KEY, kind.alias("kind"), F.col("lock_type").alias("holding_type"), F.struct("pid", "thread_id").alias("holder"))
    met = paired(waiting.withColumn("kind", F.explode(kinds)), holding, [*TABLE_KEY, "kind"], "waiting_pid", "holder")
    other = (F.col("waiting_pid") != F.col("holder.pid")) & ((F.col("wt") == 0) | (F.col("wt") != F.col("holder.thread_id")))
    return met.filter(other).select(*TABLE_KEY, "waiting_pid", "waiting_type", F.col("holder.pid").alias("blocking_pid"), "holding_type")


def blocker_pairs(locks: DataFrame, schema: str, name: str) -> DataFrame:
    """Pending requests of one table with each holder that blocks them."""
    return all_blocker_pairs(locks.filter((F.col("object_schema") == schema) & (F.col("object_name") == name)))


def table_detail(locks: DataFrame, schema: str, name: str) -> DataFrame:
    """The holders of one table, by time held downwards, and the requests that wait for it, in order of the queue."""
    rows = table_locks(locks).filter((F.col("object_schema") == schema) & (F.col("object_name") == name))
    waiting = queue_positions(rows).select(*TABLE_KEY, F.lit("PENDING").alias("lock_status"), "pid", "thread_id", "lock_type", "time_s", F.col("position").alias("place"))
    return holders(rows).select(*TABLE_KEY, F.lit("GRANTED").alias("lock_status"), "pid", "thread_id", "lock_type", "time_s", "place").unionByName(waiting)
