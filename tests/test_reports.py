"""Lock waits of both dialects and the reports, on small hand-made relations."""

import json

from pyspark.sql import functions as F

from fleetlens.operators import issues, load
from fleetlens.sources import assembly
from tests.test_telemetry import T0, at, values

AT = "server_id long, snapshot_ts timestamp, "


def test_lock_waits_of_both_dialects(spark):
    """A server of each; an idle blocker's text comes from its thread's latest statement; unknown sides are ''."""
    frame = lambda rows, schema: spark.createDataFrame(rows, AT + schema)
    waits, locks = assembly.lock_tables(
        frame([(1, T0, "a", "b", "l1")], "requesting_trx_id string, blocking_trx_id string, blocking_lock_id string"), frame([(1, T0, "l1", "`s`.`t`", "PRIMARY", "X")], "lock_id string, lock_table string, lock_index string, lock_mode string"),
        frame([(2, T0, "a", "b", "l1"), (2, T0, "a", "gone", "l1")], "requesting_engine_transaction_id string, blocking_engine_transaction_id string, blocking_engine_lock_id string"),
        frame([(2, T0, "l1", "s", None, None, "S,REC")], "engine_lock_id string, object_schema string, object_name string, index_name string, lock_mode string"),
    )
    trx = frame([(s, T0, "a", 10, "UPDATE t", at(-2)) for s in (1, 2)] + [(s, T0, "b", 11, None, None) for s in (1, 2)], "trx_id string, pid long, trx_query string, wait_started timestamp")
    procs = frame([(1, T0, 10, "u", "h"), (2, T0, 11, "v", "i")], "pid long, user_name string, host string")
    threads = frame([(1, T0, 11, 51), (2, T0, 10, 50)], "pid long, thread_id long")
    said = frame([(1, T0, 51, 1, "old", "d1"), (1, T0, 51, 2, "DELETE x", "d2"), (2, T0, 50, 1, "UPDATE t", "d3")], "thread_id long, event_id long, sql_text string, digest_text string")
    got = assembly.lock_waits(waits, locks, trx, procs, threads, said)
    names = ("server_id", "waiting_pid", "waiting_query", "waiting_digest", "blocking_pid", "blocking_query", "blocking_digest", "lock_table", "lock_index", "lock_type", "wait_started", "wait_ms", "waiting_user", "blocking_user")
    assert values(got, *names) == [(1, 10, "UPDATE t", "", 11, "DELETE x", "d2", "`s`.`t`", "PRIMARY", "X", at(-2), 2000, "u", ""), (2, 10, "UPDATE t", "d3", 11, "", "", "s.", "", "S,REC", at(-2), 2000, "", "v")]


def test_snapshot_report_has_whole_issues(spark):
    trx = spark.createDataFrame([(1, T0, 7, "u", "h", "d", 400, "UPDATE t SET a = 1", "")], AT + "pid long, user_name string, host string, db string, age_s long, query string, digest_text string")
    procs = spark.createDataFrame([(1, T0, 9, "u", "h", "d", "Query", 12, issues.METADATA_WAIT, "ALTER TABLE t")], AT + "pid long, user_name string, host string, db string, command string, time_s long, state string, info string")
    cycles = spark.createDataFrame([(1, T0, [3, 4], 2, 2)], AT + "path array<long>, participants int, severity int")
    dead = spark.createDataFrame([(1, T0, "d1", [3, 4], 2)], AT + "deadlock_ts string, participants array<long>, severity int")
    found = issues.all_issues(issues.long_transactions(trx), issues.cycle_issues(cycles), issues.ddl_conflicts(procs, trx), issues.deadlock_issues(dead))
    shots = spark.createDataFrame([(1, T0), (2, T0)], AT.rstrip(", "))
    report = issues.snapshot_report(issues.snapshot_counts(shots, processes=procs), found, spark.createDataFrame([(1, "8.0.45")], "server_id long, version string"))
    one, two = (json.loads(x) for x in report.orderBy("server_id").toJSON().collect())
    assert (one["server"], one["max_severity"], one["processes"]) == ("8.0.45", "CRITICAL", 1) and (two["server"], two["max_severity"], two["issues"]) == ("", "INFO", [])
    assert [(i["detector"], i["severity"]) for i in one["issues"]] == [("long_transaction", "CRITICAL"), ("lock_chain", "CRITICAL"), ("ddl_conflict", "CRITICAL"), ("deadlock", "CRITICAL")]
    assert [i["description"] for i in one["issues"]] == ["Transaction of u@h has run for 6m40s: UPDATE t SET a = 1", "Sessions wait for each other: 3 -> 4", "DDL of u@h on d waits for a metadata lock for 12 s: ALTER TABLE t. May be blocked by 7", "Deadlock at d1: 3 <-> 4"]
    assert one["issues"][2]["details"] == {"ddl_pid": "9", "user": "u", "host": "h", "database": "d", "query": "ALTER TABLE t", "wait_seconds": "12", "blockers": "7"}


def test_load_report_is_a_map(spark):
    rows = [(1, "CPU", 0, 1.5, 2.0), (1, "IO", 1, 0.5, 2.0), (2, "CPU", 0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "server_id long, class string, ordinal int, aas double, total double")
    got = load.load_report(df, 60).orderBy("server_id").collect()
    assert [(r.classes, r.total, r.window_seconds) for r in got] == [({"CPU": 1.5, "IO": 0.5}, 2.0, 60), ({"CPU": 0.0}, 0.0, 60)]
    assert load.load_report(df.withColumn("poll_ts", F.lit(T0))).columns == ["server_id", "poll_ts", "classes", "total"]
