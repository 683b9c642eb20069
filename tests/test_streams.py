"""Streams over several micro-batches, out of order, with empty polls, a restart and retention, against batch forms."""

import random
import time

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import deltas, issues
from fleetlens.plans import explain
from fleetlens.streaming import streams
from tests.test_telemetry import DIGEST, T0, at, digests, log

START = int(T0.timestamp())
LOG = "server_id long, poll_ts timestamp"
WAITS = "server_id long, poll_ts timestamp, event_name string, count_star long, sum_timer_wait long"


class Files:
    """Two inputs and one output of a stream; each `go` runs what has landed to its end, a file a micro-batch."""

    def __init__(self, spark, folder, make, *schemas):
        self.spark, self.folder, self.make, self.schemas, self.n = spark, str(folder), make, schemas, 0

    def put(self, which, df):
        df.coalesce(1).write.mode("append").parquet(f"{self.folder}/in{which}")

    def go(self):
        given = [self.spark.readStream.schema(s).option("maxFilesPerTrigger", 1).parquet(f"{self.folder}/in{i}") for i, s in enumerate(self.schemas)]
        running = self.make(*given).writeStream.format("parquet").option("path", f"{self.folder}/out").option("checkpointLocation", f"{self.folder}/check").trigger(availableNow=True).start()
        running.awaitTermination()
        return running.recentProgress

    def rows(self, *names):
        return sorted(tuple(r[n] for n in names) for r in self.spark.read.parquet(f"{self.folder}/out").collect())


def two_servers(spark, rows):
    whole = digests(spark, *rows)
    return whole.unionByName(whole.withColumn("server_id", F.lit(2).cast("long")).filter("digest <> 'b'"))


def logs(spark, *seconds, end=None):
    rows = log(spark, *seconds)
    out = rows.unionByName(rows.withColumn("server_id", F.lit(2).cast("long")))
    return out if end is None else out.unionByName(spark.createDataFrame([(None, at(end))], LOG))


POLLS = [(0, "a", 3, 1000, 20), (10, "a", 10, 4000, 100), (10, "b", 1, 1, 1), (20, "a", 2, 10, 5), (20, "b", 5, 9, 2), (30, "a", 4, 20, 6), (40, "b", 7, 12, 3), (60, "a", 9, 90, 9), (60, "b", 8, 13, 4), (70, "a", 10, 91, 9)]
SECONDS = [0, 10, 20, 30, 40, 50, 60, 70]  # 50 is a poll without rows


def test_digest_deltas_out_of_order_with_an_empty_poll_and_a_restart(spark, tmp_path):
    files = Files(spark, tmp_path, lambda rows, polls: streams.digest_delta_stream(rows, polls, "30 seconds"), DIGEST, LOG)
    for order in ([10, 0], [30, 20, 40], [70, 60, 50]):
        for s in order:
            files.put(0, two_servers(spark, [p for p in POLLS if p[0] == s] or [(s, "none", 0, 0, 0)]).filter("digest <> 'none'"))
            files.put(1, logs(spark, s))
        files.go()  # each a restart from the checkpoint
    files.put(1, logs(spark, end=10_000))
    files.go()
    files.put(0, two_servers(spark, [(20, "a", 99, 99_999, 99)]))  # late: the watermark is far beyond
    files.put(1, logs(spark, 20))
    files.go()
    whole = two_servers(spark, POLLS)
    want = deltas.digest_deltas(logs(spark, *SECONDS), whole).select("server_id", "digest", "poll_ts", "exec_delta", "timer_delta", "interval_ns").collect()
    assert files.rows("server_id", "digest", "poll_ts", "exec_delta", "timer_delta", "interval_ns") == sorted(map(tuple, want)) and want


@pytest.mark.parametrize("seed", [1, 2])
def test_random_polls_equal_batch(spark, tmp_path, seed):
    """Failed polls (rows that the log lacks), gaps, resets and repeated rows, in any order within the delay."""
    rng = random.Random(seed)
    count, rows, polls = {}, [], []
    for s in range(0, 200, 10):
        if rng.random() < 0.85:
            polls.append(s)
        for d in "abc":
            if rng.random() < 0.7:
                count[d] = max(1, count.get(d, 5) + rng.choice([0, 1, 5, 5, -4]))
                rows += [(s, d, count[d], count[d] * 7, count[d])] * rng.choice([1, 1, 2])
    files = Files(spark, tmp_path, lambda r, p: streams.digest_delta_stream(r, p, "500 seconds"), DIGEST, LOG)
    mixed = rng.sample(rows, len(rows))
    for k in range(0, len(mixed), 20):
        files.put(0, two_servers(spark, mixed[k : k + 20]))
    files.put(1, logs(spark, *polls))
    files.go()
    files.put(1, logs(spark, end=10_000))
    files.go()
    want = deltas.digest_deltas(logs(spark, *polls), two_servers(spark, rows)).select("server_id", "digest", "poll_ts", "exec_delta").collect()
    assert files.rows("server_id", "digest", "poll_ts", "exec_delta") == sorted(map(tuple, want)) and want


def test_wait_load_with_an_empty_poll(spark, tmp_path):
    rows = [(0, "wait/io/file/a", 1, 10), (0, "wait/lock/x", 5, 5), (10, "wait/lock/x", 8, 9), (30, "wait/io/file/a", 101, 4_000_010), (30, "wait/lock/x", 8, 9), (30, "wait/io/file/b", 3, 3), (40, "wait/lock/x", 2, 1), (50, "wait/lock/x", 9, 6)]
    frame = lambda some: spark.createDataFrame([(1, at(s), e, n, t) for s, e, n, t in some], WAITS)
    files = Files(spark, tmp_path, lambda r, p: streams.wait_load_stream(r, p, "15 seconds"), WAITS, LOG)
    for part in ((10, 0), (30,), (50, 40)):
        for s in part:
            files.put(0, frame([r for r in rows if r[0] == s]))
            files.put(1, log(spark, s))
        if part == (30,):
            files.put(1, log(spark, 20))
        files.go()
    files.put(1, spark.createDataFrame([(None, at(1000))], LOG))
    files.go()
    got = files.rows("class", "poll_ts", "interval_ns", "count_delta", "timer_delta_ps")
    batch = deltas.wait_deltas(frame(rows), log(spark, 0, 10, 20, 30, 40, 50))
    assert got == sorted(tuple(r) for r in batch.select("class", "poll_ts", "interval_ns", "count_delta", "timer_delta_ps").collect())
    assert [g[:3] for g in got] == [("IO", at(30), 10**10), ("Lock", at(10), 10**10), ("Lock", at(50), 10**10)]


def state_rows(progress):
    return [p.stateOperators[0].numRowsTotal for p in progress if p.stateOperators][-1]


def test_digests_leave_the_state(spark, tmp_path):
    """A digest that no poll of the retention window has is gone, and so is a server that is not polled any more."""
    files = Files(spark, tmp_path, lambda r, p: streams.digest_delta_stream(r, p, "1 second", retention_s=60), DIGEST, LOG)
    held = []
    for s, names in ((0, "abcdefgh"), (10, "ab"), (100, "ab"), (110, "ab"), (300, ""), (310, "")):
        rows = [(s, d, s + 1, s + 1, 1) for d in names] or [(s, "none", 0, 0, 0)]
        files.put(0, digests(spark, *rows).filter("digest <> 'none'"))
        files.put(1, log(spark, s) if names else spark.createDataFrame([(None, at(s))], LOG))
        held.append(state_rows(files.go()))
    assert held[3] == held[2] - len("cdefgh") and held[-1] <= 2, held  # what is left are marks of no server
    assert files.rows("digest", "poll_ts") == [(d, at(s)) for d in "ab" for s in (10, 100, 110)]


def test_plan_flips_over_batches_and_servers(spark, tmp_path):
    schema = "server_id long, digest string, ts long, plan_hash string"
    rows = [(s, "d", i, h) for i, h in enumerate(["x", "x", "y", "x"]) for s in (1, 2) if s == 1 or h == "x"]
    files = Files(spark, tmp_path, streams.plan_flip_stream, schema)
    for i in range(4):
        files.put(0, spark.createDataFrame([r for r in rows if r[2] == i], schema))
    progress = files.go()
    want = explain.plan_flips(spark.createDataFrame(rows, schema)).select("server_id", "ts", "prior_hash", "new_hash").collect()
    assert files.rows("server_id", "ts", "prior_hash", "new_hash") == sorted(map(tuple, want)) == [(1, 2, "x", "y"), (1, 3, "y", "x")]
    assert state_rows(progress) == 2


def test_deadlocks_keep_one_row_a_server(spark, tmp_path):
    schema = "server_id long, snapshot_ts timestamp, deadlock_ts string"
    rows = [(s, at(i), d) for i, d in enumerate(["d1", "d1", None, "d1", "d2", "d1"]) for s in (1, 2) if s == 1 or i != 4]
    files = Files(spark, tmp_path, streams.deadlock_stream, schema)
    for i in range(0, 6, 2):
        files.put(0, spark.createDataFrame([r for r in rows if r[1] in (at(i), at(i + 1))], schema))
    progress = files.go()
    reports = spark.createDataFrame(rows, schema).withColumn("participants", F.array().cast("array<long>"))
    alive = spark.createDataFrame([], "server_id long, snapshot_ts timestamp, pid long")
    want = issues.deadlocks(reports, alive).select("server_id", "snapshot_ts", "deadlock_ts").collect()
    assert files.rows("server_id", "snapshot_ts", "deadlock_ts") == sorted(map(tuple, want)) and len(want) == 4
    assert state_rows(progress) == 2
    # with a TTL the state store works by the clock, so the query runs until it is stopped
    running = streams.deadlock_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in0"), ttl_s=3600).writeStream.format("memory").queryName("deadlocks_ttl").start()
    until = time.monotonic() + 60
    while spark.table("deadlocks_ttl").count() < 4 and time.monotonic() < until:
        time.sleep(0.5)
    running.stop()
    assert spark.table("deadlocks_ttl").count() == 4


def test_windows_in_append_mode(spark, tmp_path):
    """A window comes out once, when the watermark has passed its end; a row that is later than that is left out."""
    schema = "server_id long, ts timestamp"
    files = Files(spark, tmp_path, lambda df: streams.load_window_stream(df, "10 seconds", "10 seconds"), schema)
    for s in (0, 5, 300, 310, 2, 600):  # 2 comes two batches after the watermark has passed it
        files.put(0, spark.createDataFrame([(1, at(s))], schema))
    files.go()
    assert files.rows("window_start", "observations") == [(at(0), 2), (at(300), 1), (at(310), 1)]


def test_report_log(spark, tmp_path):
    folder, out, check = (f"{tmp_path}/{x}" for x in ("in", "out", "check"))
    schema = "server_id long, snapshot_ts timestamp, processes long, max_severity string"
    for i in range(3):
        spark.createDataFrame([(i % 2, at(86_400 * i), i, "INFO")], schema).coalesce(1).write.mode("append").parquet(folder)
        streams.report_log(spark.readStream.schema(schema).parquet(folder), out, check).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.json(out)
    assert sorted((r.server_id, str(r.day), r.processes) for r in got.collect()) == [(0, "2024-01-01", 0), (0, "2024-01-03", 2), (1, "2024-01-02", 1)]
