"""Issues of the registered queries are those of every chain and cycle, as the SQL lists them."""

import pytest

from fleetlens import queries
from fleetlens.operators import issues
from tests.test_locks import graph_of, listed, rings
from tests.test_telemetry import T0, values

TEXTS = "lock_table string, waiting_query string, blocking_query string, waiting_user string, waiting_host string, blocking_user string, blocking_host string"
#: A queue of five sessions (each waits for all before it), and three sessions that all wait for each other.
QUEUE = [(a, b) for a in range(1, 6) for b in range(a + 1, 6)]
KNOT = [(a, b) for a in range(11, 14) for b in range(11, 14) if a != b]


@pytest.fixture
def tangled(spark, monkeypatch):
    """The registered queries, with these locks in place of the trees and rings of the test tables."""
    waits = spark.createDataFrame([(1, T0, a, b, 5, *["x"] * 7) for a, b in QUEUE], f"server_id long, snapshot_ts timestamp, blocking_pid long, waiting_pid long, wait_ms long, {TEXTS}")
    own = {"lock_waits": waits, "lock_rings": spark.createDataFrame([(1, T0, a, b) for a, b in KNOT], "server_id long, snapshot_ts timestamp, blocking_pid long, waiting_pid long")}
    given = queries.relation
    monkeypatch.setattr(queries, "relation", lambda session, sf_dir, name: own[name] if name in own else given(session, sf_dir, name))


def test_all_issues_has_every_chain_and_cycle(spark, data, tangled):
    chains, cycles = listed(graph_of([(a, b, 5) for a, b in QUEUE])), rings(graph_of([(a, b, 5) for a, b in KNOT]))
    hard = sum(len(p) >= 4 for p, _ in chains)
    assert (len(chains), hard, len(cycles)) == (8, 4, 5)
    got = queries.QUERIES["all_issues"](spark, data).filter("detector = 'lock_chain'")
    assert values(got, "severity", "issues") == [(1, len(chains) - hard), (2, hard + len(cycles))]
    rows = queries.Fleet(spark, data).issues().filter("detector = 'lock_chain'")
    texts = {r.description for r in rows.collect()}
    assert len(texts) == len(chains) + len(cycles)
    pids = [r.pid for r in queries.QUERIES["issue_rows"](spark, data).filter("detector = 'lock_chain'").collect()]
    assert (pids.count(1), pids.count(None), len(pids)) == (8, 5, 13)


def test_snapshot_report_holds_every_issue(spark, data, tangled):
    """Every chain, cycle and pair with its texts, what may block waiting DDL, and snapshots without issues."""
    got = queries.QUERIES["snapshot_report"](spark, data).cache()
    pairs, ddl = (queries.QUERIES[n](spark, data).count() for n in ("dml_blocked_by_ddl", "ddl_blocked"))
    assert got.filter("detector = 'ddl_conflict'").count() == pairs + ddl and got.filter("detector = 'lock_chain'").count() == 13
    assert got.filter("detector is not null and not (description <> '' and details like '{%}')").count() == 0
    named = {(r.pid, r.blockers) for r in queries.QUERIES["ddl_blocked"](spark, data).collect()}
    told = got.filter("title like 'DDL blocked%'").selectExpr("CAST(get_json_object(details, '$.ddl_pid') AS BIGINT) AS pid", "get_json_object(details, '$.blockers') AS blockers", "description").collect()
    assert {(r.pid, r.blockers) for r in told} == named and all(r.description.endswith(f". May be blocked by {r.blockers}") for r in told)
    two = got.filter("title = 'DML blocked by DDL'").selectExpr("get_json_object(details, '$.blocked_pid') AS a", "get_json_object(details, '$.ddl_pid') AS b")
    assert two.distinct().count() == pairs
    worst = {(r.server_id, r.snapshot_ts): r.severity for r in queries.QUERIES["max_severity"](spark, data).collect()}
    labels = {(r.server_id, r.snapshot_ts): ["INFO", "WARNING", "CRITICAL"].index(r.max_severity) for r in got.collect()}
    assert labels == worst


def test_a_snapshot_without_issues_has_a_row(spark):
    heads = spark.createDataFrame([(1, T0, "8", 2, "CRITICAL", 1, 1, 1), (2, T0, "", 3, "INFO", 0, 0, 0)], "server_id long, snapshot_ts timestamp, server string, processes long, max_severity string, issues int, critical int, described int")
    told = spark.createDataFrame([(1, T0, 0, "deadlock", "CRITICAL", "t", "d", {"a": "b"})], "server_id long, snapshot_ts timestamp, ordinal int, detector string, severity string, title string, description string, details map<string, string>")
    got = sorted((tuple(r) for r in issues.report_rows(heads, told).select("server_id", "processes", "max_severity", "detector", "details").collect()), key=str)
    assert got == [(1, 2, "CRITICAL", "deadlock", {"a": "b"}), (2, 3, "INFO", None, None)]


def test_report_heads_need_no_lists_of_blockers(spark, data):
    """The log's rows only count issues, so what may block waiting DDL is not put together for them."""
    assert "collect_set" not in queries.report_heads(queries.Fleet(spark, data))._jdf.queryExecution().optimizedPlan().toString()
