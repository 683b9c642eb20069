"""Telemetry operators on small hand-made relations, and streams against their batch forms."""

import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fleetlens.functions import format as fmt
from fleetlens.functions import text as txt
from fleetlens.operators import deltas, health, issues, load, locks, mdl
from fleetlens.plans import explain
from fleetlens.queries import QUERIES
from fleetlens.sources import assembly

T0 = dt.datetime(2024, 1, 1)
at = lambda s: T0 + dt.timedelta(seconds=s)
DIGEST = "server_id long, poll_ts timestamp, schema_name string, digest string, digest_text string, count_star decimal(20,0), sum_timer_wait decimal(20,0), sum_lock_time decimal(20,0), sum_rows_examined decimal(20,0), sum_rows_sent decimal(20,0), sum_no_index_used decimal(20,0), sum_created_tmp_disk_tables decimal(20,0), sum_sort_merge_passes decimal(20,0)"


def digests(spark, *rows):
    from decimal import Decimal

    return spark.createDataFrame([(1, at(s), "db", d, "t", *map(Decimal, (n, t, 0, r, 0, 0, 0, 0))) for s, d, n, t, r in rows], DIGEST)


def log(spark, *seconds):
    return spark.createDataFrame([(1, at(s)) for s in seconds], "server_id long, poll_ts timestamp")


def values(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_digest_delta_seed_reset_and_absence(spark):
    polls = digests(spark, (0, "a", 3, 1000, 20), (10, "a", 10, 4000, 100), (20, "a", 2, 10, 5), (30, "a", 4, 20, 6), (50, "a", 9, 90, 9))
    out = deltas.digest_outcomes(log(spark, 0, 10, 20, 30, 40, 50), polls)
    assert [r.outcome for r in out.orderBy("poll_ts").collect()] == ["seed", "emit", "reset", "emit", "seed"]
    assert values(deltas.digest_deltas(log(spark, 0, 10), polls.filter(F.col("poll_ts") <= at(10))), "exec_delta", "timer_delta", "rows_examined_delta", "interval_ns") == [(7, 3000, 80, 10**10)]


def test_wait_delta_spans_gaps(spark):
    rows = [(0, "wait/io/file/a", 1, 10), (0, "wait/lock/x", 5, 5), (10, "wait/lock/x", 8, 9), (20, "wait/io/file/a", 101, 4_000_010), (20, "wait/lock/x", 8, 9)]
    df = spark.createDataFrame([(1, at(s), e, n, t) for s, e, n, t in rows], "server_id long, poll_ts timestamp, event_name string, count_star long, sum_timer_wait long")
    polls = log(spark, 0, 10, 20)
    assert values(deltas.wait_deltas(df, polls), "class", "count_delta", "timer_delta_ps", "interval_ns", "spans_gap") == [("IO", 100, 4_000_000, 10**10, True), ("Lock", 3, 4, 10**10, False)]
    polls = log(spark, 0, 10, 15, 20, 30)  # the polls at 15 and 30 saw no waits
    assert values(deltas.wait_deltas(df, polls), "class", "interval_ns", "spans_gap") == [("IO", 5 * 10**9, True), ("Lock", 10**10, False)]
    assert values(deltas.wait_poll_audit(df, polls), "poll_ts", "seen", "seeded", "emitted") == [(at(0), 2, 2, 0), (at(10), 1, 0, 1), (at(15), 0, 0, 0), (at(20), 2, 0, 1), (at(30), 0, 0, 0)]


def test_aborted_clients_and_retention(spark):
    df = spark.createDataFrame([(1, at(i), v) for i, v in enumerate((100, 105, 110, 3))], "server_id long, poll_ts timestamp, aborted_clients long")
    assert [r.aborted_delta for r in deltas.aborted_clients_delta(df).orderBy("poll_ts").collect()] == [100, 5, 5, 0]
    ten = spark.createDataFrame([(1, at(i)) for i in range(10)], "server_id long, poll_ts timestamp")
    assert deltas.retained_samples(ten, ["server_id"], F.lit(at(9)), 4, 100).count() == 5
    assert values(deltas.retained_samples(ten, ["server_id"], F.lit(at(4)), 0, 3), "poll_ts") == [(at(2),), (at(3),), (at(4),)]


def test_statement_load(spark):
    row = "server_id long, schema_name string, digest string, digest_text string, poll_ts timestamp, interval_ns long, exec_delta long, timer_delta long, rows_examined_delta long, rows_sent_delta long, no_index_delta long"
    df = spark.createDataFrame([(1, "s", "hot", "SELECT 1 FROM t", at(10), 10**10, 20, 30 * 10**12, 5, 1, 1), (1, "s", "cold", "x", at(10), 10**10, 1, 10**12, 1, 1, 0)], row)
    assert values(load.top_sql(df), "rank", "digest", "aas", "avg_latency_ns", "no_idx") == [(1, "hot", 3.0, 1_500_000_000, True), (2, "cold", 0.1, 10**9, False)]
    assert values(load.busiest_tables(df), "table_name", "aas") == [("s.t", 3.0)]
    app = spark.createDataFrame([(1, "hot", "checkout")], "server_id long, digest string, app_tag string")
    assert load.top_sql(df, sessions=app, app="checkout").count() == 1 and load.top_sql(df, sessions=app.limit(0), app="checkout").count() == 0


LOCKS = "server_id long, snapshot_ts timestamp, blocking_pid long, waiting_pid long, wait_ms long"


def test_long_chain_and_snapshots_apart(spark):
    chain = [(1, T0, i, i + 1, 5) for i in range(1000)]
    apart = [(1, at(1), 1, 2, 5), (1, at(2), 2, 3, 5), (2, at(1), 2, 3, 5), (1, at(3), None, 3, 5), (1, at(4), 7, 7, None)]
    df = spark.createDataFrame(chain + apart, LOCKS)
    got = locks.lock_chains(df).collect()
    assert sorted(len(r.path) for r in got) == [2, 2, 2, 1001] and max(r.max_wait_ms for r in got) == 5
    tree = locks.lock_tree(df).filter(F.col("snapshot_ts") == T0)
    assert tree.count() == 1001 and tree.agg(F.max("depth")).first()[0] == 1000 and locks.lock_tree(df, 2).filter(F.col("snapshot_ts") == T0).count() == 3
    assert [r.path for r in locks.lock_cycles(df).collect()] == [[7]]
    ring = spark.createDataFrame([(1, T0, i, (i + 1) % 300, 1) for i in range(300)], LOCKS)
    assert [r.participants for r in locks.lock_cycles(ring).collect()] == [300] and locks.lock_chains(ring).count() == 0


def test_chain_issues(spark):
    edge = lambda s, a, b, t: (1, at(s), a, b, 20_000, t, f"q{b}", f"q{a}", f"u{b}", "h", f"u{a}", "h")
    row = LOCKS + ", lock_table string, waiting_query string, blocking_query string, waiting_user string, waiting_host string, blocking_user string, blocking_host string"
    df = spark.createDataFrame([edge(0, 1, 2, "s.t"), edge(0, 2, 3, "s.x"), edge(1, 3, 4, None)], row)
    chains = locks.chain_text(locks.lock_chains(df), locks.sessions_of(df))
    got = issues.chain_issues(chains).unionByName(issues.cycle_issues(locks.lock_cycles(df))).orderBy("snapshot_ts").collect()
    assert [r.title for r in got] == ["Lock chain detected (depth 3)", "Lock chain detected (depth 2)"] and {r.severity for r in got} == {2}
    d = got[0].details
    assert d["chain"] == "PID:1(u1@h) s.t [q1] -> PID:2(u2@h) s.t [q2] -> PID:3(u3@h) s.x [q3]" and d["lock_table"] == "s.t"
    assert d["root_query"] == "q1" and d["blocked_queries"] == "q2, q3" and d["root_blocker"] == "1"


@pytest.mark.parametrize(("edges", "chains", "cycles"), [([(1, 2), (2, 3)], [[1, 2, 3]], []), ([(1, 2), (1, 3)], [[1, 2], [1, 3]], []), ([(1, 2), (2, 1)], [], [[1, 2]]), ([], [], [])])
def test_lock_paths(spark, edges, chains, cycles):
    df = spark.createDataFrame([(1, T0, a, b, 30_000) for a, b in edges], LOCKS)
    got = locks.lock_chains(df).collect()
    assert sorted(r.path for r in got) == chains and all(r.severity == 2 for r in got)
    assert sorted(r.path for r in locks.lock_cycles(df).collect()) == cycles


def test_metadata_blockers(spark):
    row = "server_id long, snapshot_ts timestamp, pid long, thread_id long, lock_type string, lock_status string, object_type string, object_schema string, object_name string, time_s long"
    lock = lambda pid, kind, status, s=1: (1, T0, pid, pid, kind, status, "TABLE", "db", "t", s)
    df = spark.createDataFrame([lock(1, "EXCLUSIVE", "PENDING", 9), lock(2, "SHARED_READ", "GRANTED"), lock(3, "SHARED_WRITE", "GRANTED"), lock(4, "SHARED_READ", "PENDING", 5), lock(5, "ODD", "PENDING", 7), lock(6, "SHARED_READ", "VICTIM"), lock(1, "SHARED_READ", "GRANTED")], row)
    pairs = mdl.blocker_pairs(df, "db", "t")
    assert values(pairs.filter("waiting_pid = 1"), "blocking_pid") == [(2,), (3,)] and pairs.filter("waiting_pid = 4").count() == 0
    assert values(pairs.filter("waiting_pid = 5"), "blocking_pid") == [(1,), (2,), (3,)]
    assert values(mdl.table_detail(df, "db", "t"), "lock_status", "pid", "place") == [("GRANTED", 1, 1), ("GRANTED", 2, 2), ("GRANTED", 3, 3), ("PENDING", 1, 1), ("PENDING", 4, 3), ("PENDING", 5, 2)]
    assert values(mdl.queue_positions(df), "pid", "position", "depth") == [(1, 1, 3), (4, 3, 3), (5, 2, 3)]


def test_blockers_are_counted_without_pairs(spark):
    """Counts by lock type equal the pairs, with own locks of the same process, of the same thread and of thread 0."""
    rng = random.Random(2)
    row = "server_id long, snapshot_ts timestamp, pid long, thread_id long, lock_type string, lock_status string, object_type string, object_schema string, object_name string, time_s long"
    kinds = [*mdl.BLOCKS, "ODD"]
    rows = [(1, T0, rng.randrange(12), rng.randrange(8), rng.choice(kinds), rng.choice(["PENDING", "GRANTED", "GRANTED", "VICTIM"]), "TABLE", "db", "t", rng.randrange(9)) for _ in range(400)]
    df = spark.createDataFrame(rows, row)
    key = ("waiting_pid", "waiting_type", "holding_type")
    want = Counter(values(mdl.blocker_pairs(df, "db", "t"), *key))
    got = Counter()
    for *k, n in values(mdl.mdl_blockers(df), *key, "blockers"):
        got[tuple(k)] += n
    assert got == want and want


def test_ddl_of_a_database_is_listed_once(spark):
    row = "server_id long, snapshot_ts timestamp, pid long, user_name string, host string, db string, command string, time_s long, state string, info string"
    wait = issues.METADATA_WAIT
    rows = [(1, T0, 1, "u", "h", "d", "Query", 5, wait, "ALTER TABLE a"), (1, T0, 2, "u", "h", "d", "Query", 50, "x", "drop table b"), (1, T0, 3, "u", "h", "d", "Query", 12, wait, "SELECT 1"), (1, T0, 4, "u", "h", "", "Query", 12, wait, "SELECT 1"), (1, at(1), 5, "u", "h", "d", "Query", 1, wait, "SELECT 1"), (1, T0, 6, "u", "h", "e", "Query", 90, wait, "CREATE TABLE c")]
    procs = spark.createDataFrame(rows, row)
    trx = procs.filter("pid in (1, 2, 3)").select("server_id", "snapshot_ts", "db", "pid")
    assert values(issues.dml_blocked_by_ddl(procs), "blocked_pid", "ddls", "ddl_pid", "severity") == [(3, 2, 2, 2)]
    assert values(issues.dml_ddl_pairs(procs, "d"), "blocked_pid", "ddl_pid") == [(3, 1), (3, 2)]
    assert values(issues.ddl_blocked(procs, trx), "pid", "blockers", "severity") == [(1, "2, 3", 1), (6, "unknown", 2)]


def test_deadlocks_reported_again_while_alive(spark):
    reports = spark.createDataFrame([(1, at(0), "d1", [5]), (1, at(1), "d1", [5]), (1, at(2), None, []), (1, at(3), "d1", [5]), (1, at(4), "d2", [6])], "server_id long, snapshot_ts timestamp, deadlock_ts string, participants array<long>")
    alive = spark.createDataFrame([(1, at(1), 5)], "server_id long, snapshot_ts timestamp, pid long")
    assert [r.snapshot_ts for r in issues.deadlocks(reports, alive).orderBy("snapshot_ts").collect()] == [at(0), at(1), at(4)]


def test_verdict_levels(spark):
    row = "running_ratio double, history_length long, replica_lag_s long, aborted_delta long, cloud_cpu double, max_severity int"
    df = spark.createDataFrame([(0.5, 0, None, 0, None, 0), (0.6, 0, None, 0, None, 0), (0.1, 6_000_000, 0, 0, 0.0, 0), (0.0, 0, 0, 1, 0.0, None)], row)
    assert values(health.verdict(df), "verdict") == [("HEALTHY",), ("PAGE",), ("WARN",), ("WARN",)]


def test_tree_as_it_is_read(spark):
    """The older root first, texts by source, and the participants that are outside the tree."""
    at_ = "server_id long, snapshot_ts timestamp, "
    waits = spark.createDataFrame([(1, T0, 10, 11, 5, "edge"), (1, T0, 20, 21, 7, "edge"), (1, T0, 21, 22, 9, "edge")], at_ + "blocking_pid long, waiting_pid long, wait_ms long, blocking_query string")
    waits = waits.selectExpr("*", "'u' blocking_user", "'h' blocking_host", "'u' waiting_user", "'h' waiting_host", "'t' lock_table", "'' waiting_query")
    trx = spark.createDataFrame([(1, T0, 10, 30, "old"), (1, T0, 20, 90, "")], at_ + "pid long, age_s long, query string")
    procs = spark.createDataFrame([(1, T0, 20, 1, ""), (1, T0, 22, 1, "listed")], at_ + "pid long, time_s long, info string")
    dead = spark.createDataFrame([(1, T0, 0), (1, T0, 22), (1, T0, 99), (1, T0, 99)], at_ + "pid long")
    got = locks.tree_report(waits, trx, procs, dead).orderBy("place").collect()
    assert [(r.pid, r.depth, r.wait_ms, r.query) for r in got] == [(20, 0, 0, "edge"), (21, 1, 7, "edge"), (22, 2, 9, "listed"), (10, 0, 0, "old"), (11, 1, 5, ""), (99, None, 0, "")]


def test_the_row_before_over_days(spark):
    """The first row of a day takes the last one of the day before that has rows, however long ago."""
    seconds = (5, 50, 86_405, 5 * 86_400, 5 * 86_400 + 7)
    rows = spark.createDataFrame([(k, at(s), s) for k in (1, 2) for s in seconds if k == 1 or s != 50], "server_id long, poll_ts timestamp, n int")
    got = sorted((r.server_id, r.n, r.before.n if r.before else None) for r in deltas.with_before(rows, ["server_id"]).collect())
    assert got == [(1, 5, None), (1, 50, 5), (1, 86_405, 50), (1, 432_000, 86_405), (1, 432_007, 432_000), (2, 5, None), (2, 86_405, 5), (2, 432_000, 86_405), (2, 432_007, 432_000)]


def test_signals_as_of_a_poll(spark):
    base = spark.createDataFrame([(1, at(50), "a"), (1, at(100), "b"), (1, at(250), "c"), (2, at(100), "d")], "server_id long, poll_ts timestamp, name string")
    lags = spark.createDataFrame([(1, at(60), 5), (1, at(100), 7), (1, at(100), 9), (1, at(101), 1), (2, None, 4), (2, at(0), None)], "server_id long, ts timestamp, value long")
    cpu = spark.createDataFrame([(1, at(149), 1.0), (1, at(150), None), (2, at(1), 3.0)], "server_id long, ts timestamp, value double")
    got = health.as_of(base, {"lag_s": lags, "cpu": cpu}, 100).orderBy("name").collect()
    assert [(r.name, r.lag_s, r.cpu) for r in got] == [("a", None, None), ("b", 9, None), ("c", None, None), ("d", None, 3.0)]


@pytest.mark.parametrize(("sql", "table", "label", "safe"), [
    ("/* c */ -- d\n SELECT * FROM `shop`.`orders` FOR UPDATE", "shop.orders", "SELECT FOR UPDATE orders", True), ("update t set a=1", "t", "UPDATE t", False), ("/* open", "", "", False), ("", "", "", False),
    ("# x\nWITH q AS (SELECT 1) SELECT 2", "", "WITH", True), ("ALTER TABLE a.b ADD c INT", "a.b", "ALTER TABLE b", False),
])
def test_sql_text(spark, sql, table, label, safe):
    c = F.lit(sql)
    assert one(spark, txt.table_from_sql(c)) == table and one(spark, txt.query_label(F.lit(None).cast("string"), c)) == label and one(spark, txt.explain_safe(c)) == safe


@pytest.mark.parametrize(("sql", "table"), [
    ("", ""), ("SELECT 1", ""), ("SELECT * FROM users", "users"), ("SELECT * FROM `users`", "users"), ("SELECT * FROM `alice`.`inbox`", "alice.inbox"), ("SELECT * FROM alice.inbox", "alice.inbox"),
    ("UPDATE `accounts` SET balance=balance+1", "accounts"), ("INSERT INTO `mydb`.`audit_log` VALUES (?)", "mydb.audit_log"), ("SELECT * FROM a JOIN `b`.`c` ON a.id=c.id", "a"), ("/* hint */ SELECT * FROM `alice`.`inbox`", "alice.inbox"),
    ("BEGIN", ""), ("SELECT * FROM (SELECT 1) x JOIN y", "y"), ("delete from\n  s . t", "s.t"), ("SELECT a FROM t.", "t"), ("SELECT from", ""), ("FROM", ""), ("select 1 from\t`x`", "x"), ("perform t", ""), ("SELECT xfrom t", "t"),
])
def test_table_of_a_statement(spark, sql, table):
    assert one(spark, txt.table_from_sql(F.lit(sql))) == table


def test_every_participant_of_a_deadlock(spark):
    text = "LATEST DETECTED DEADLOCK\n----\n2024-01-02 03:04:05 0x7f\n" + "".join(f"*** ({n}) TRANSACTION:\nTRANSACTION {n}, ACTIVE 3 sec\nMySQL thread id {n}, OS thread handle 1, query id 9 h u\nUPDATE t\n" for n in range(1, 1501))
    got = assembly.deadlock_participants(spark.createDataFrame([(1, text), (2, "no section")], "server_id long, status_text string"))
    assert values(got, "n", "thread_id") == [(n, n) for n in range(1, 1501)]


@pytest.mark.parametrize(("sql", "tag"), [("/* service='a%2Cb,c',x=1 */ SELECT 1", "a,b,c"), ("/* service=plain */ S", "plain"), ("SELECT 1 /* service=late */", "prog"), ("/* service=open", "prog"), ("", "prog"), ("/*service=a,service=b*/", "b"), ("/*service=%zz*/", "%zz")])
def test_app_tags(spark, sql, tag):
    assert one(spark, txt.app_tag(F.lit(sql), F.lit("prog"))) == tag


def test_durations(spark):
    assert [one(spark, fmt.human_duration(F.lit(x))) for x in (999, 60_000, 61_000, 3_600_000, 3_660_000)] == ["999ms", "1m", "1m1s", "1h", "1h1m"]
    assert [one(spark, fmt.parse_duration(F.lit(x))) for x in ("19h14m", "5s", "x", "", "5")] == [69_240, 5, 0, 0, 0]


def test_plan_hash_ignores_costs(spark):
    plan = '{"query_block":{"select_id":1,"cost_info":{"query_cost":"%s"},"nested_loop":[{"table":{"table_name":"t","access_type":"%s","rows_examined_per_scan":"5000","rows_produced_per_join":%s}}]}}'
    df = spark.createDataFrame([("d", 1, plan % (1, "ALL", 10)), ("d", 2, plan % (9, "ALL", 11)), ("d", 3, plan % (9, "ref", 11)), ("d", 4, "broken {")], "digest string, ts long, plan_json string")
    hashes = explain.plan_hash(df)
    assert values(explain.plan_flips(hashes), "ts") == [(3,)] and hashes.count() == 3
    servers = hashes.withColumn("server_id", F.when(F.col("ts") == 2, 1).otherwise(2))
    assert values(explain.plan_flips(servers), "server_id", "ts") == [(2, 3)]
    deep = '{"query_block":' + '{"ordering_operation":{"nested_loop":[' * 60 + '{"table":{"table_name":"t"}}' + "]}}" * 60 + "}"
    assert explain.plan_nodes(spark.createDataFrame([("d", 1, deep)], df.schema)).count() == 1 + 3 * 60 + 1
    assert values(explain.plan_red_flags(df), "ts", "flag") == [(1, "BIG_SCAN_RATIO"), (1, "FULL_SCAN"), (2, "BIG_SCAN_RATIO"), (2, "FULL_SCAN"), (3, "BIG_SCAN_RATIO")]


@pytest.mark.parametrize(("stream", "batch", "columns"), [
    ("stream_digest_deltas", "digest_deltas", ("server_id", "digest", "poll_ts", "exec_delta", "timer_delta")), ("stream_wait_load", "wait_deltas", ("server_id", "class", "poll_ts", "count_delta", "timer_delta_ps")),
    ("stream_cpu", "cpu_samples", ("server_id", "ts", "cpu_observations", "cpu_ticks")), ("stream_plan_flips", "plan_flips", ("digest", "ts", "new_hash")),
])
def test_stream_equals_batch(spark, data, stream, batch, columns):
    assert values(QUERIES[stream](spark, data), *columns) == values(QUERIES[batch](spark, data), *columns)


def test_load_by_user_adds_up(spark, data):
    total = QUERIES["session_samples"](spark, data).count()
    assert QUERIES["load_by_user"](spark, data).agg(F.sum("observations")).first()[0] == total
