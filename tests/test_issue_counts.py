"""Issues of pairs are all counted and listed; reports and tables of issues need no text of all blockers and no array of a snapshot."""

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import issues
from fleetlens.queries import QUERIES
from tests.test_telemetry import T0, values

AT = "server_id long, snapshot_ts timestamp, "
PROCESS = AT + "pid long, user_name string, host string, db string, command string, time_s long, state string, info string"


@pytest.fixture(scope="module")
def procs(spark):
    wait = issues.METADATA_WAIT
    sql = lambda i: "ALTER TABLE s.a" if i % 4 == 0 else "SELECT 1 FROM s.b"
    return spark.createDataFrame([(1, T0, i, "u", "h", "d" if i < 18 else "e", "Query", i, wait, sql(i)) for i in range(1, 22)], PROCESS).cache()


def test_an_issue_for_each_ddl_statement(procs):
    """13 statements of d wait for 4 DDL statements each, two of e for one."""
    pairs = issues.dml_ddl_pairs(procs).count()
    found = issues.all_issues(issues.ddl_conflicts(procs))
    assert found.agg(F.sum("times")).first()[0] == pairs + 5 == 13 * 4 + 3 + 5
    rows = issues.issue_rows(found, procs)
    assert rows.count() == pairs + 5 and rows.filter("pid = 3").count() == 4 and "times" not in rows.columns
    key = ("bucket", "issues", "critical", "warning", "pids", "oldest_s")
    got = values(issues.issues_per_table(issues.issue_row_groups(found, procs)), *key)
    assert got == values(issues.issues_per_table(rows), *key) and sum(r[1] for r in got) == pairs + 5
    shots = procs.select("server_id", "snapshot_ts").distinct()
    assert values(issues.snapshot_counts(shots, issues=found, processes=procs), "issues", "processes") == [(pairs + 5, 21)]


def test_registered_issues_count_pairs(spark, data):
    pairs = QUERIES["dml_blocked_by_ddl"](spark, data).count()
    ddl = QUERIES["ddl_blocked"](spark, data).count()
    assert QUERIES["all_issues"](spark, data).filter("detector = 'ddl_conflict'").agg(F.sum("issues")).first()[0] == pairs + ddl
    assert QUERIES["issue_rows"](spark, data).filter("detector = 'ddl_conflict'").count() == pairs + ddl
    assert QUERIES["snapshot_counts"](spark, data).agg(F.sum("issues")).first()[0] == QUERIES["all_issues"](spark, data).agg(F.sum("issues")).first()[0]
    assert QUERIES["issues_per_table"](spark, data).agg(F.sum("issues")).first()[0] == QUERIES["issue_rows"](spark, data).count()


def test_blockers_without_the_waiter(spark, procs):
    trx = procs.filter("pid in (1, 4, 8, 12, 20, 44)").select("server_id", "snapshot_ts", "db", "pid")
    extra = spark.createDataFrame([(1, T0, "d", 44), (1, T0, "d", 44), (1, T0, "d", 112), (1, T0, None, 7)], AT + "db string, pid long")
    got = dict(values(issues.ddl_blocked(procs, trx.unionByName(extra)), "pid", "blockers"))
    assert got == {4: "1, 8, 12, 44, 112", 8: "1, 4, 12, 44, 112", 12: "1, 4, 8, 44, 112", 16: "1, 4, 8, 12, 44, 112", 20: "unknown"}


def test_report_heads_equal_the_nested_report(spark, procs):
    trx = procs.select("*", F.col("pid").alias("age_s"), F.col("info").alias("query"), F.lit("").alias("digest_text"))
    found = issues.all_issues(issues.long_transactions(trx, 5, 15), issues.ddl_conflicts(procs, trx))
    shots = spark.createDataFrame([(1, T0), (2, T0)], AT.rstrip(", "))
    counts, servers = issues.snapshot_counts(shots, processes=procs), spark.createDataFrame([(1, "8.0.45")], "server_id long, version string")
    heads = issues.report_heads(counts, issues.report_issues(found), servers)
    worst = F.size(F.filter("issues", lambda i: i["severity"] == "CRITICAL"))
    told = F.size(F.filter("issues", lambda i: (i["description"] != "") & (F.size(i["details"]) > 0)))
    nested = issues.snapshot_report(counts, found, servers).select("server_id", "server", "processes", "max_severity", F.size("issues").alias("issues"), worst.alias("critical"), told.alias("described"))
    key = nested.columns
    assert values(heads, *key) == values(nested, *key)
    assert "collect_list" not in heads._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["issue_rows", "issues_per_table", "issues_by_table", "issues_by_bucket"])
def test_issue_rows_make_no_list_of_blockers(spark, data, name):
    """What may block waiting DDL is in no column of these, so it must not be put together for them."""
    assert "collect_set" not in QUERIES[name](spark, data)._jdf.queryExecution().optimizedPlan().toString()
