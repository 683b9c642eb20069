"""Pairs of metadata locks and of statements, against plain joins, with more of a key than a block has."""

import random

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import issues, mdl, pairs
from fleetlens.queries import QUERIES
from tests.test_telemetry import T0, at, values

AT = "server_id long, snapshot_ts timestamp, "
LOCK = AT + "pid long, thread_id long, lock_type string, lock_status string, object_type string, object_schema string, object_name string, time_s long"
PROCESS = AT + "pid long, user_name string, host string, db string, command string, time_s long, state string, info string"


def locks_of(spark, n):
    rng = random.Random(3)
    kinds = [*mdl.BLOCKS, "ODD"]
    rows = [(1, at(rng.randrange(2)), rng.randrange(40), rng.randrange(30), rng.choice(kinds), rng.choice(["PENDING", "GRANTED", "VICTIM"]), "TABLE", "db", rng.choice("tu"), 1) for _ in range(n)]
    return rows, spark.createDataFrame(rows, LOCK)


def blocks(w, h):
    return (w[4] not in mdl.BLOCKS or h[4] in mdl.BLOCKS[w[4]].split()) and w[2] != h[2] and (w[3] == 0 or w[3] != h[3])


@pytest.mark.parametrize("block", [3, 1000])
def test_every_blocker_of_every_request(spark, monkeypatch, block):
    monkeypatch.setattr(pairs, "BLOCK", block)
    rows, df = locks_of(spark, 300)
    key = lambda r: (r[1], r[8])
    want = sorted((w[1], w[8], w[2], w[4], h[2], h[4]) for w in rows for h in rows if w[5] == "PENDING" and h[5] == "GRANTED" and key(w) == key(h) and blocks(w, h))
    assert values(mdl.all_blocker_pairs(df), "snapshot_ts", "object_name", "waiting_pid", "waiting_type", "blocking_pid", "holding_type") == want
    assert values(mdl.blocker_pairs(df, "db", "t"), "snapshot_ts", "waiting_pid", "blocking_pid") == sorted((a, c, e) for a, b, c, _, e, _ in want if b == "t")


def test_requests_meet_only_holders_of_blocking_types(spark):
    """The plan joins by lock type, so rows that meet and do not conflict are not made."""
    _, df = locks_of(spark, 10)
    plan = mdl.blocker_pairs(df, "db", "t")._jdf.queryExecution().optimizedPlan().toString()
    join = next(line for line in plan.splitlines() if "Join Inner" in line and "salt" in line)
    assert "kind" in join and "Generate" in plan


@pytest.mark.parametrize("block", [2, 1000])
def test_every_ddl_of_every_waiting_statement(spark, monkeypatch, block):
    monkeypatch.setattr(pairs, "BLOCK", block)
    wait = issues.METADATA_WAIT
    rows = [(1, T0, i, "u", "h", "de"[i % 2], "Query", i, wait, "ALTER TABLE a" if i % 3 == 0 else "SELECT 1") for i in range(60)] + [(1, T0, 99, "u", "h", "", "Query", 1, wait, "SELECT 1")]
    procs = spark.createDataFrame(rows, PROCESS)
    want = [(a[5], a[2], b[2], 2 if a[7] >= 10 else 1) for a in rows for b in rows if a[5] and a[5] == b[5] and a[2] % 3 and not b[2] % 3 and b[2] < 99 and a[2] < 99]
    assert values(issues.dml_ddl_pairs(procs), "db", "blocked_pid", "ddl_pid", "severity") == sorted(want)
    assert values(issues.dml_ddl_pairs(procs, "d"), "blocked_pid", "ddl_pid") == sorted((b, c) for a, b, c, _ in want if a == "d")


def test_registered_pairs_are_whole(spark, data):
    one = QUERIES["mdl_blockers"](spark, data)
    assert one.count() == QUERIES["mdl_blocker_counts"](spark, data).agg(F.sum("blockers")).first()[0] and "blocking_pid" in one.columns
    two = QUERIES["dml_blocked_by_ddl"](spark, data)
    assert two.count() == QUERIES["dml_ddl_counts"](spark, data).agg(F.sum("ddls")).first()[0]
