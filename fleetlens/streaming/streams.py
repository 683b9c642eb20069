"""Structured Streaming forms of the stateful operators; each equals its batch form on the same rows.

State is keyed by server (by server and digest for plans); what a server has of digests or wait events is a map state
with one entry each, so a step reads and writes the entries that moved. Polls are kept until the watermark has passed
them and are then applied in order, whatever order they came in; the log of successful polls comes as a stream of its
own, so a poll without rows is known. Rows later than the watermark are dropped by Spark and counted in its metrics.

These operators need the RocksDB state store, see `with_state_store`."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from fleetlens.functions.text import is_cpu_wait, wait_class
from fleetlens.operators.deltas import RESET_CHECKED
from fleetlens.plans.explain import plan_hash
from fleetlens.sources.landing import as_stream, drained, shared_path

CHECKED = list(RESET_CHECKED)
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_state_store(spark: SparkSession) -> SparkSession:
    """Set the state store that map states, timers and TTL need, for the queries this session starts from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS_DB)
    return spark


class _Polls(StatefulProcessor):
    """Polls of one server in order: rows wait under (poll, names...) until the watermark has passed the poll.

    ``waiting`` has the rows of polls to come, ``logged`` the polls in the log, ``held`` the last values of each name
    with their poll, ``last`` the last poll of the log that was applied. A name that no poll within ``retention_s`` (0:
    for ever) had leaves ``held``; a server without polls for that long leaves the state whole, by its timer."""

    names: tuple[str, ...] = ()
    values: tuple[str, ...] = ()
    output: tuple[str, ...] = ()

    def __init__(self, retention_s: int):
        self.retention_us = retention_s * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        name_schema = ", ".join(f"{n} string" for n in self.names)
        value_schema = ", ".join(f"{v} decimal(20,0)" for v in self.values)
        self.handle = handle
        self.waiting = handle.getMapState("waiting", f"poll_us long, {name_schema}", value_schema)
        self.logged = handle.getMapState("logged", "poll_us long", "is_logged boolean")
        self.held = handle.getMapState("held", name_schema, f"poll_us long, {value_schema}")
        self.last = handle.getValueState("last", "poll_us long")

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0] if self.last.exists() else -1
        due: set[int] = set()
        fresh: dict[tuple, tuple] = {}
        for part in rows:
            for r in part.itertuples(index=False):
                if r.poll_us <= last:
                    continue
                due.add(r.poll_us)
                if r.is_logged:
                    self.logged.updateValue((r.poll_us,), (True,))
                    continue
                at, value = (r.poll_us, *(getattr(r, n) for n in self.names)), tuple(getattr(r, v) for v in self.values)
                fresh[at] = tuple(a + b for a, b in zip(fresh[at], value, strict=True)) if at in fresh else value
        for at, value in fresh.items():
            before = self.waiting.getValue(at) if self.waiting.containsKey(at) else None
            self.waiting.updateValue(at, tuple(a + b for a, b in zip(before, value, strict=True)) if before else value)
        for poll_us in due:
            self.handle.registerTimer(poll_us // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = timerValues.getCurrentWatermarkInMs() * 1000
        logged = sorted(p for (p,) in self.logged.keys() if p < until)
        waiting: dict[int, list[tuple]] = {}
        for at, value in self.waiting.iterator():
            if at[0] < until:
                waiting.setdefault(at[0], []).append((tuple(at[1:]), tuple(value)))
        last = self.last.get()[0] if self.last.exists() else None
        out: list[tuple] = []
        if logged or waiting:
            held = {tuple(n): (v[0], tuple(v[1:])) for n, v in self.held.iterator()}
            moved: set[tuple] = set()
            for poll_us in sorted({*logged, *waiting}):
                rows = sorted(waiting.get(poll_us, []))
                in_log = poll_us in logged
                if in_log:
                    out += self.deltas(key[0], poll_us, last, rows, held)
                for name, value in rows:
                    held[name] = poll_us, value
                    moved.add(name)
                    self.waiting.removeKey((poll_us, *name))
                if in_log:
                    last = poll_us
                    self.logged.removeKey((poll_us,))
            newest = max({*logged, *waiting})
            for name, (seen, value) in held.items():
                if self.retention_us and seen < newest - self.retention_us:
                    self.held.removeKey(name)
                elif name in moved:
                    self.held.updateValue(name, (seen, *value))
            if last is not None:
                self.last.update((last,))
            if self.retention_us:
                self.handle.registerTimer((newest + self.retention_us) // 1000 + 1)
        elif self.retention_us and last is not None and last < until - self.retention_us and not any(True for _ in self.waiting.keys()):
            for state in (self.held, self.last):
                state.clear()
        yield pd.DataFrame(out, columns=list(self.output))

    def deltas(self, server: int, poll_us: int, last: int | None, rows: list, held: dict) -> list[tuple]:
        raise NotImplementedError


class DigestDeltas(_Polls):
    """A delta is taken against the poll just before; a digest which that poll lacks is a seed, a decrease a reset."""

    names, values = ("schema_name", "digest"), tuple(CHECKED)
    output = ("server_id", "schema_name", "digest", "poll_us", "interval_ns", "exec_delta", "timer_delta")

    def deltas(self, server, poll_us, last, rows, held):
        out = []
        for name, now in rows:
            seen, before = held.get(name, (None, ()))
            if last is not None and seen == last and all(a >= b for a, b in zip(now, before, strict=True)) and (now[0] > before[0] or now[1] > before[1]):
                out.append((server, *name, poll_us, (poll_us - last) * 1000, int(now[0] - before[0]), int(now[1] - before[1])))
        return out


class WaitLoad(_Polls):
    """Class sums of wait deltas; an event's baseline stays when a poll lacks it."""

    names, values = ("event_name", "wait_kind"), ("count_star", "sum_timer_wait")
    output = ("server_id", "poll_us", "class", "interval_ns", "count_delta", "timer_delta_ps")

    def deltas(self, server, poll_us, last, rows, held):
        sums: dict[str, list[int]] = {}
        for name, now in rows:
            if name in held and all(a >= b for a, b in zip(now, held[name][1], strict=True)):
                s = sums.setdefault(name[1], [0, 0])
                s[0] += int(now[0] - held[name][1][0])
                s[1] += int(now[1] - held[name][1][1])
        return [(server, poll_us, c, (poll_us - last) * 1000 if last is not None else None, *s) for c, s in sorted(sums.items()) if any(s)]


def _polled(processor: _Polls, rows: DataFrame, log: DataFrame, late: str, schema: str) -> DataFrame:
    """Rows and log of successful polls through a processor, by server."""
    marks = log.select("server_id", "poll_ts", F.lit(True).alias("is_logged"))
    own = rows.select("server_id", "poll_ts", *processor.names, *(F.col(v).cast("decimal(20,0)").alias(v) for v in processor.values), F.lit(False).alias("is_logged"))
    both = own.unionByName(marks, allowMissingColumns=True).filter("poll_ts is not null").withColumn("poll_us", F.unix_micros("poll_ts")).withWatermark("poll_ts", late)
    with_state_store(rows.sparkSession)
    found = both.groupBy("server_id").transformWithStateInPandas(processor, schema, "Append", "EventTime")
    return found.withColumn("poll_ts", F.timestamp_micros("poll_us")).drop("poll_us")


def digest_delta_stream(polls: DataFrame, log: DataFrame, late: str = "1 minute", retention_s: int = 3600) -> DataFrame:
    """Deltas of digest polls against the poll just before in ``log`` (server_id, poll_ts)."""
    rows = polls.filter("digest is not null and server_id is not null").withColumn("schema_name", F.coalesce("schema_name", F.lit("")))
    return _polled(DigestDeltas(retention_s), rows, log, late, "server_id long, schema_name string, digest string, poll_us long, interval_ns long, exec_delta long, timer_delta long")


def wait_load_stream(polls: DataFrame, log: DataFrame, late: str = "1 minute", retention_s: int = 0) -> DataFrame:
    """Class sums of wait deltas; intervals are between polls of ``log`` (server_id, poll_ts)."""
    rows = polls.filter("count_star > 0 and event_name is not null and server_id is not null").withColumn("wait_kind", wait_class(F.col("event_name")))
    return _polled(WaitLoad(retention_s), rows, log, late, "server_id long, poll_us long, class string, interval_ns long, count_delta long, timer_delta_ps long")


def cpu_stream(marked_ticks: DataFrame, every: str = "10 seconds", late: str = "1 minute") -> DataFrame:
    """``marked_ticks``: session rows, and one row per tick with marker = 1 (so no distinct is needed)."""
    rows = marked_ticks.withWatermark("tick_ts", late).groupBy("server_id", F.window("tick_ts", every).alias("w"))
    return rows.agg(F.sum("on_cpu").alias("cpu_observations"), F.sum("marker").alias("cpu_ticks")).select("server_id", F.col("w.start").alias("ts"), "cpu_observations", "cpu_ticks")


def load_window_stream(samples: DataFrame, length: str = "60 seconds", every: str = "10 seconds", late: str = "1 minute") -> DataFrame:
    rows = samples.withWatermark("ts", late).groupBy("server_id", F.window("ts", length, every).alias("w"))
    return rows.agg(F.count("*").alias("observations")).select("server_id", F.col("w.start").alias("window_start"), "observations")


class _Changes(StatefulProcessor):
    """A key's rows in order of ``at``; a row that is not later than what the key has seen is late and dropped. What
    differs from the value before comes out; a first value does too, if ``first``. State: one row a key, for ``ttl_ms``."""

    def __init__(self, keys: list[str], first: bool, ttl_ms: int | None):
        self.output, self.first, self.ttl_ms = [*keys, "at", "before", "value"], first, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "value string, at long", self.ttl_ms)

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, at = self.seen.get() if self.seen.exists() else (None, None)
        out = []
        for r in pd.concat(list(rows), ignore_index=True).sort_values(["at", "value"], kind="stable").itertuples(index=False):
            if at is not None and r.at <= at:
                continue
            if r.value != last and (self.first or last is not None):
                out.append((*key, r.at, last, r.value))
            last, at = r.value, int(r.at)
        self.seen.update((last, at))
        yield pd.DataFrame(out, columns=self.output)


def _changes(rows: DataFrame, keys: list[str], value: str, at: str, first: bool, ttl_s: int | None) -> DataFrame:
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    with_state_store(rows.sparkSession)
    given = rows.select(*keys, F.col(value).alias("value"), F.col(at).alias("at"))
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", at long, before string, value string"
    mode = "ProcessingTime" if ttl_s else "None"
    return given.groupBy(*keys).transformWithStateInPandas(_Changes(keys, first, ttl_s * 1000 if ttl_s else None), schema, "Append", mode)


def deadlock_stream(reports: DataFrame, ttl_s: int | None = None) -> DataFrame:
    """Each new deadlock of a server (server_id, snapshot_ts, deadlock_ts): one whose timestamp is not the last one's.
    State is the last timestamp of each server."""
    rows = reports.filter("deadlock_ts is not null and server_id is not null").withColumn("us", F.unix_micros("snapshot_ts"))
    return _changes(rows, ["server_id"], "deadlock_ts", "us", True, ttl_s).select("server_id", F.timestamp_micros("at").alias("snapshot_ts"), F.col("value").alias("deadlock_ts"))


def plan_flip_stream(hashes: DataFrame, ttl_s: int | None = None) -> DataFrame:
    """Where a digest's plan hash differs from the one before on the same server (if ``hashes`` has server_id)."""
    keys = [*(["server_id"] if "server_id" in hashes.columns else []), "digest"]
    return _changes(hashes, keys, "plan_hash", "ts", False, ttl_s).select(*keys, F.col("at").alias("ts"), F.col("before").alias("prior_hash"), F.col("value").alias("new_hash"))


def report_log(report: DataFrame, path: str, checkpoint: str):
    """Append each snapshot report of a stream to JSON partitioned by server and day."""
    rows = report.withColumn("day", F.to_date("snapshot_ts"))
    return rows.writeStream.format("json").partitionBy("server_id", "day").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")


def logged(report: DataFrame) -> DataFrame:
    """Run a report through `report_log` to the end of what has landed and read the log."""
    spark = report.sparkSession
    path = shared_path(spark, "report-log")
    report_log(as_stream(report, "reports"), path, shared_path(spark, "report-log-checkpoint")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(report.schema.add("day", "date")).json(path).drop("day")


#: Rows come in this many files by time, a file a micro-batch.
PARTS = 3


def _polls_and_log(t, rows: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Rows and log of polls as two streams; the log ends with a mark of no server, at which the last polls are due."""
    end = t.good_polls.agg(F.lit(None).cast("long").alias("server_id"), (F.max("poll_ts") + F.expr("INTERVAL 1 DAY")).alias("poll_ts"))
    return as_stream(rows, name), as_stream(t.good_polls.select("server_id", "poll_ts").unionByName(end), f"{name}-log")


def _cpu(t) -> DataFrame:
    ticks = t.session_ticks
    on_cpu = (F.col("executing") & is_cpu_wait(F.col("current_wait"))).cast("long")
    rows = ticks.select("server_id", "tick_ts", on_cpu.alias("on_cpu"), F.lit(0).cast("long").alias("marker"))
    marks = ticks.select("server_id", "tick_ts").distinct().select("server_id", "tick_ts", F.lit(0).cast("long").alias("on_cpu"), F.lit(1).cast("long").alias("marker"))
    return drained(cpu_stream(as_stream(rows.unionByName(marks), "ticks", "tick_ts", PARTS)), "cpu")


STREAMS = {
    "stream_digest_deltas": lambda t: drained(digest_delta_stream(*_polls_and_log(t, t.digest_polls, "digest-polls")), "digest-deltas"),
    "stream_wait_load": lambda t: drained(wait_load_stream(*_polls_and_log(t, t.wait_polls, "wait-polls")), "wait-load"),
    "stream_cpu": _cpu,
    "stream_load_window": lambda t: drained(load_window_stream(as_stream(t.samples().select("server_id", "ts"), "samples", "ts", PARTS), "6 hours", "1 hour"), "load-window"),
    "stream_deadlocks": lambda t: drained(deadlock_stream(as_stream(t.deadlock_reports().select("server_id", "snapshot_ts", "deadlock_ts"), "deadlocks", "snapshot_ts", PARTS)), "deadlocks"),
    "stream_plan_flips": lambda t: drained(plan_flip_stream(as_stream(plan_hash(t.plans).select("digest", "ts", "plan_hash"), "plan-hashes")), "plan-flips"),
}
