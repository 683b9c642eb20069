"""Issue detectors, issue rows and what is made of them. Severity: 0 INFO, 1 WARNING, 2 CRITICAL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.functions.format import SEVERITIES, format_duration, parse_duration, severity_label, truncate_text
from fleetlens.functions.text import is_ddl, query_label, table_from_sql, untableable_bucket
from fleetlens.operators.pairs import dealt_join, paired

SNAPSHOT = ["server_id", "snapshot_ts"]
METADATA_WAIT = "Waiting for table metadata lock"
ISSUE = [*SNAPSHOT, "detector", "severity", "title", "description", "details"]

# Who and what is never killed.
SYSTEM_USERS = ("system user", "event_scheduler", "slave_worker", "slave_io", "slave_sql")
DUMP_COMMANDS = ("Binlog Dump", "Binlog Dump GTID")
REPLICATION_STATES = ("Slave_IO_Running", "Slave_SQL_Running", "Waiting for master to send event")


def details(**items: Column) -> Column:
    """MAP<STRING,STRING> of the items that are not null."""
    pairs = F.array(*(F.struct(F.lit(k).alias("k"), v.cast("string").alias("v")) for k, v in items.items()))
    return F.map_from_entries(F.filter(pairs, lambda p: p["v"].isNotNull()))


def long_transactions(transactions: DataFrame, warn_s: int = 30, critical_s: int = 300) -> DataFrame:
    """Transactions of at least ``warn_s``; age_s is snapshot minus start, null without a start."""
    rows = transactions.filter(F.col("age_s") >= warn_s)
    text = F.when(F.coalesce("digest_text", F.lit("")) != "", F.col("digest_text")).otherwise(F.col("query"))
    return rows.select(
        *SNAPSHOT, F.lit("long_transaction").alias("detector"), F.when(F.col("age_s") >= critical_s, 2).otherwise(1).alias("severity"),
        F.format_string("Transaction running for %s", format_duration(F.col("age_s"))).alias("title"),
        F.format_string("Transaction of %s@%s has run for %s: %s", "user_name", "host", format_duration(F.col("age_s")), truncate_text(text, 100)).alias("description"),
        details(thread_id=F.col("pid"), database=F.col("db"), user=F.col("user_name"), host=F.col("host"), query=text, duration=format_duration(F.col("age_s"))).alias("details"),
    )


def _ddl_waits(processes: DataFrame) -> DataFrame:
    return processes.withColumn("ddl", is_ddl(F.col("info")))


def _waiting_ddl(processes: DataFrame, threshold_s: int) -> DataFrame:
    waiting = _ddl_waits(processes).filter(F.col("ddl") & (F.col("state") == METADATA_WAIT)).select(*SNAPSHOT, "pid", "user_name", "host", "db", "time_s", "info")
    return waiting.withColumn("severity", F.when(F.col("time_s") >= threshold_s, 2).otherwise(1))


def ddl_blocked(processes: DataFrame, transactions: DataFrame, threshold_s: int = 10) -> DataFrame:
    """DDL that waits for a metadata lock, with the transactions of its database that may block it.

    The transactions of a database are sorted and written out once; a waiter's text is that one without its own id. The
    result is as large as the waiters times the transactions of their databases, what is held is one such text."""
    ids = F.array_join(F.array_sort(F.collect_set("pid")).cast("array<string>"), ", ")
    open_ = transactions.groupBy(*SNAPSHOT, "db").agg(F.concat(F.lit(", "), ids, F.lit(", ")).alias("open"))
    found = dealt_join(_waiting_ddl(processes, threshold_s), open_, [*SNAPSHOT, "db"], "pid", "left")
    others = F.replace("open", F.concat(F.lit(", "), F.col("pid").cast("string"), F.lit(", ")), F.lit(", "))
    found = found.withColumn("others", others).withColumn("blockers", F.when(F.octet_length("others") > 2, F.substring("others", F.lit(3), F.octet_length("others") - 4)).otherwise("unknown"))
    return found.drop("open", "others")


def ddl_by_database(processes: DataFrame) -> DataFrame:
    """The DDL statements of each database of a snapshot: their ids, how many, and the one that runs longest."""
    longest = F.max_by(F.struct(F.col("pid").alias("ddl_pid"), F.col("info").alias("ddl_query")), F.struct("time_s", -F.col("pid"))).alias("longest")
    return _ddl_waits(processes).filter("ddl and db <> ''").groupBy(*SNAPSHOT, "db").agg(F.array_sort(F.collect_list("pid")).alias("ddl_pids"), F.count("*").alias("ddls"), longest).select(*SNAPSHOT, "db", "ddl_pids", "ddls", "longest.*")


def _dml_waits(processes: DataFrame) -> DataFrame:
    rows = _ddl_waits(processes).filter((F.col("db") != "") & ~F.col("ddl") & (F.col("state") == METADATA_WAIT))
    return rows.select(*SNAPSHOT, "db", F.col("pid").alias("blocked_pid"), "user_name", "host", "time_s", F.col("info").alias("blocked_query"))


def dml_blocked_by_ddl(processes: DataFrame, threshold_s: int = 10) -> DataFrame:
    """Statements that wait for a metadata lock while DDL runs in their database: one row each, with the number of the
    DDL statements and the one that runs longest (the smaller id of equals). `ddl_by_database` lists them all, once."""
    found = _dml_waits(processes).join(ddl_by_database(processes).drop("ddl_pids"), [*SNAPSHOT, "db"])
    return found.withColumn("severity", F.when(F.col("time_s") >= threshold_s, 2).otherwise(1))


def dml_ddl_pairs(processes: DataFrame, db: str | None = None, threshold_s: int = 10) -> DataFrame:
    """Every waiting statement with every DDL statement of its database; of one database if it is named."""
    rows = processes if db is None else processes.filter(F.col("db") == db)
    ddl = _ddl_waits(rows).filter("ddl and db <> ''").select(*SNAPSHOT, "db", F.col("pid").alias("ddl_pid"))
    found = paired(_dml_waits(rows).select(*SNAPSHOT, "db", "blocked_pid", "time_s"), ddl, [*SNAPSHOT, "db"], "blocked_pid", "ddl_pid")
    return found.withColumn("severity", F.when(F.col("time_s") >= threshold_s, 2).otherwise(1))


def ddl_conflicts(processes: DataFrame, transactions: DataFrame | None = None, threshold_s: int = 10) -> DataFrame:
    """Issues of waiting DDL, and of statements that wait for DDL. The latter stand for one issue for each DDL statement of
    the database, as many as ``times`` says; which ones they are is `dml_ddl_pairs`. Without ``transactions`` the texts do
    not name potential blockers."""
    two = dml_blocked_by_ddl(processes, threshold_s)
    return waiting_ddl_issues(processes, transactions, threshold_s).withColumn("times", F.lit(1).cast("long")).unionByName(two.select(
        *SNAPSHOT, F.lit("ddl_conflict").alias("detector"), "severity", F.format_string("DML blocked by DDL: %s", "ddl_query").alias("title"),
        F.format_string("Statement of %s@%s waits for %d s for %d DDL statements, the longest of them %d: %s", "user_name", "host", "time_s", "ddls", "ddl_pid", truncate_text(F.col("blocked_query"), 80)).alias("description"),
        details(blocked_pid=F.col("blocked_pid"), user=F.col("user_name"), host=F.col("host"), query=F.col("blocked_query"), wait_seconds=F.col("time_s"), longest_ddl=F.col("ddl_pid"), ddl_statements=F.col("ddls")).alias("details"), F.col("ddls").alias("times"),
    ))


def dml_ddl_issues(processes: DataFrame, threshold_s: int = 10) -> DataFrame:
    """One issue for each waiting statement and each DDL statement of its database, where `ddl_conflicts` has one row with
    their number. Texts are put together but for the DDL statement's id before statements meet the DDL."""
    ddl = _ddl_waits(processes).filter("ddl and db <> ''").select(*SNAPSHOT, "db", F.col("pid").alias("ddl_pid"))
    told = F.concat(F.lit("Statement of "), "user_name", F.lit("@"), "host", F.lit(" waits for "), F.col("time_s").cast("string"), F.lit(" s for DDL "))
    waits = _dml_waits(processes).select(*SNAPSHOT, "db", "blocked_pid", "user_name", "host", "time_s", "blocked_query", told.alias("told"), F.concat(F.lit(": "), truncate_text(F.col("blocked_query"), 80)).alias("cut"), F.when(F.col("time_s") >= threshold_s, 2).otherwise(1).alias("severity"))
    found = paired(waits, ddl, [*SNAPSHOT, "db"], "blocked_pid", "ddl_pid")
    return found.select(
        *SNAPSHOT, F.lit("ddl_conflict").alias("detector"), "severity", F.lit("DML blocked by DDL").alias("title"), F.concat("told", F.col("ddl_pid").cast("string"), "cut").alias("description"),
        details(blocked_pid=F.col("blocked_pid"), ddl_pid=F.col("ddl_pid"), user=F.col("user_name"), host=F.col("host"), query=F.col("blocked_query"), wait_seconds=F.col("time_s")).alias("details"),
    )


def waiting_ddl_issues(processes: DataFrame, transactions: DataFrame | None, threshold_s: int = 10) -> DataFrame:
    """Issues of DDL that waits for a metadata lock. Without ``transactions`` the texts do not name potential blockers."""
    named = transactions is not None
    rows = ddl_blocked(processes, transactions, threshold_s) if named else _waiting_ddl(processes, threshold_s)
    told = F.format_string("DDL of %s@%s on %s waits for a metadata lock for %d s: %s", "user_name", "host", "db", "time_s", truncate_text(F.col("info"), 80))
    return rows.select(
        *SNAPSHOT, F.lit("ddl_conflict").alias("detector"), "severity", F.format_string("DDL blocked by metadata lock: %s", "info").alias("title"),
        (F.concat(told, F.lit(". May be blocked by "), "blockers") if named else told).alias("description"),
        details(ddl_pid=F.col("pid"), user=F.col("user_name"), host=F.col("host"), database=F.col("db"), query=F.col("info"), wait_seconds=F.col("time_s"), **({"blockers": F.col("blockers")} if named else {})).alias("details"),
    )


def deadlocks(reports: DataFrame, processes: DataFrame) -> DataFrame:
    """Reports (server_id, snapshot_ts, deadlock_ts, participants ARRAY<BIGINT>), one per snapshot, that are issues: a new
    timestamp, or the last one again while a participant is alive. A snapshot without a report keeps the last one."""
    before = Window.partitionBy("server_id").orderBy("snapshot_ts").rowsBetween(Window.unboundedPreceding, -1)
    rows = reports.withColumn("last_ts", F.last("deadlock_ts", ignorenulls=True).over(before)).filter("deadlock_ts is not null")
    alive = rows.select(*SNAPSHOT, F.explode("participants").alias("pid")).join(processes.select(*SNAPSHOT, "pid"), [*SNAPSHOT, "pid"], "left_semi").select(*SNAPSHOT).distinct().withColumn("alive", F.lit(True))
    rows = rows.join(alive, SNAPSHOT, "left")
    return rows.filter("last_ts is null or last_ts <> deadlock_ts or alive").select(*SNAPSHOT, "deadlock_ts", "participants", F.lit(2).alias("severity"))


def deadlock_issues(found: DataFrame) -> DataFrame:
    n = F.size("participants")
    ids = F.map_from_arrays(F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("trx"), i.cast("string"), F.lit("_thread_id"))), F.transform("participants", lambda p: p.cast("string")))
    return found.filter(n > 0).select(*SNAPSHOT, F.lit("deadlock").alias("detector"), "severity", F.lit("Deadlock detected").alias("title"), F.format_string("Deadlock at %s: %s", "deadlock_ts", F.array_join(F.transform("participants", lambda p: p.cast("string")), " <-> ")).alias("description"), F.map_concat(details(timestamp=F.col("deadlock_ts"), participants=n), ids).alias("details"))


def chain_issues(chains: DataFrame) -> DataFrame:
    """One issue per row of ``chains`` (`locks.lock_chains`, or `locks.chain_totals` where paths are too many to list), which
    has what `locks.chain_text` adds."""
    number = F.col("chains") if "chains" in chains.columns else F.lit(None).cast("string")
    return chains.select(
        *SNAPSHOT, F.lit("lock_chain").alias("detector"), "severity", F.format_string("Lock chain detected (depth %d)", "depth").alias("title"), F.col("chain_text").alias("description"),
        details(chain_depth=F.col("depth"), root_blocker=F.col("root_blocker"), chain=F.col("chain_text"), root_query=F.col("root_query"), blocked_queries=F.col("blocked_queries"), lock_table=F.col("lock_table"), chains=number).alias("details"),
    )


def cycle_issues(cycles: DataFrame) -> DataFrame:
    """One issue per row of ``cycles`` (`locks.lock_cycles`, or `locks.cycle_groups`)."""
    return cycles.select(*SNAPSHOT, F.lit("lock_chain").alias("detector"), "severity", F.format_string("Lock cycle detected (%d participants)", "participants").alias("title"), F.concat(F.lit("Sessions wait for each other: "), F.array_join(F.transform("path", lambda p: p.cast("string")), " -> ")).alias("description"), details(cycle_size=F.col("participants")).alias("details"))


def all_issues(*parts: DataFrame) -> DataFrame:
    """The detectors' issues under each other, with the detector's place in the order given and ``times``, the number of
    issues that a row stands for."""
    return reduce(DataFrame.unionByName, (p.select(*ISSUE, _times(p).alias("times"), F.lit(i).alias("ordinal")) for i, p in enumerate(parts)))


def _times(rows: DataFrame) -> Column:
    return F.col("times") if "times" in rows.columns else F.lit(1).cast("long")


def issue_rows(issues: DataFrame, processes: DataFrame) -> DataFrame:
    """One row per issue, one per participant for deadlocks; gaps are filled from the process list."""
    rows = issue_row_groups(issues, processes)
    return rows.withColumn("time", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).drop("time", "times")


def issue_row_groups(issues: DataFrame, processes: DataFrame) -> DataFrame:
    """`issue_rows` with equal rows of one issue row once, with how many ``times`` it stands for. Dealt out by process id in
    a fixed number of partitions: what the rows are repeated to is not seen in their size."""
    d = lambda k: F.try_element_at("details", F.lit(k))
    count = F.coalesce(d("participants").try_cast("int"), F.lit(1))
    rows = issues.withColumn("n", F.explode(F.when((F.col("detector") == "deadlock") & (count > 0), F.sequence(F.lit(1), F.greatest(count, F.lit(1)))).otherwise(F.array(F.lit(1)))))
    key = F.concat(F.lit("trx"), F.col("n").cast("string"), F.lit("_thread_id"))
    number = lambda c: F.nullif(c.try_cast("bigint"), F.lit(0).cast("bigint"))
    pid = F.coalesce(F.when(F.col("detector") == "deadlock", number(F.try_element_at("details", key))), *(number(d(k)) for k in ("thread_id", "ddl_pid", "blocked_pid", "root_blocker")))
    age = F.coalesce(F.when(F.coalesce(d("duration"), F.lit("")) != "", parse_duration(d("duration"))), d("wait_seconds").try_cast("bigint"), F.lit(0).cast("bigint"))
    rows = rows.select(*SNAPSHOT, "detector", "severity", "title", "n", pid.alias("pid"), F.coalesce(d("user"), F.lit("")).alias("u"), F.coalesce(d("host"), F.lit("")).alias("h"), F.coalesce(d("query"), d("root_query"), F.lit("")).alias("q"), F.coalesce(F.nullif(d("table"), F.lit("")), F.nullif(d("lock_table"), F.lit(""))).alias("t"), age.alias("age_s"), _times(issues).alias("times"))
    procs = processes.groupBy(*SNAPSHOT, "pid").agg(F.max_by(F.struct("user_name", "host", "info"), F.struct("time_s", "user_name", "host", "info")).alias("p"))
    parts = int(issues.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(parts, *SNAPSHOT, "pid").join(procs, [*SNAPSHOT, "pid"], "left")
    fill = lambda own, other: F.when(F.col(own) != "", F.col(own)).otherwise(F.coalesce(F.col(f"p.{other}"), F.lit("")))
    rows = rows.select(*SNAPSHOT, "detector", "severity", "title", "n", "pid", fill("u", "user_name").alias("user_name"), fill("h", "host").alias("host"), fill("q", "info").alias("query"), "t", "age_s", "times")
    return rows.withColumn("table_name", F.coalesce("t", table_from_sql(F.col("query")))).drop("t")


def table_or_bucket() -> Column:
    """An issue row's table, or the bucket of statements without one."""
    return F.when(F.col("table_name") != "", F.col("table_name")).otherwise(untableable_bucket(F.col("query")))


def issues_of(rows: DataFrame, name: str) -> DataFrame:
    """The issue rows of a table or of a bucket."""
    return rows.filter(table_or_bucket() == name)


def issues_per_table(rows: DataFrame) -> DataFrame:
    """Counts by table or bucket of `issue_rows`, or of `issue_row_groups`, which are fewer."""
    number = lambda level: F.sum(F.when(F.col("severity") == level, _times(rows)).otherwise(0))
    return rows.groupBy(*SNAPSHOT, table_or_bucket().alias("bucket")).agg(
        F.sum(_times(rows)).alias("issues"), number(2).alias("critical"), number(1).alias("warning"), number(0).alias("info"),
        F.max("severity").alias("max_severity"), F.max("age_s").alias("oldest_s"), F.count_distinct("pid").alias("pids"),
    )


def max_severity(snapshots: DataFrame, issues: DataFrame) -> DataFrame:
    return snapshots.join(issues.groupBy(*SNAPSHOT).agg(F.max("severity").alias("severity")), SNAPSHOT, "left").withColumn("severity", F.coalesce("severity", F.lit(0)))


def snapshot_counts(snapshots: DataFrame, **relations: DataFrame) -> DataFrame:
    out = snapshots
    for name, df in relations.items():
        out = out.join(df.groupBy(*SNAPSHOT).agg(F.sum(_times(df)).alias(name)), SNAPSHOT, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def kill_eligibility(processes: DataFrame, own_pids: list[int] | None = None) -> DataFrame:
    """Each process with the reason that makes it unsafe to end, or null; the first rule that holds counts."""
    state = reduce(Column.__or__, (F.col("state").contains(s) for s in REPLICATION_STATES))
    reason = F.when(F.col("pid").isin(own_pids or [-1]), "own connection").when(F.lower("user_name").isin(*SYSTEM_USERS), F.format_string("system user '%s'", "user_name"))
    reason = reason.when(F.col("command").isin(*DUMP_COMMANDS), "replication thread").when(state, F.format_string("replication state '%s'", "state"))
    return processes.withColumn("reason", reason).withColumn("safe", F.col("reason").isNull())


def long_open_transactions(processes: DataFrame, least_s: int = 30, limit: int = 5) -> DataFrame:
    rows = processes.filter(F.col("time_s") >= least_s).withColumn("rank", F.row_number().over(Window.partitionBy(*SNAPSHOT).orderBy(F.desc("time_s"), "pid")))
    label = F.when(F.coalesce("info", F.lit("")) == "", "(idle in trx)").otherwise(query_label(F.lit(""), F.col("info")))
    return rows.filter(F.col("rank") <= limit).select(*SNAPSHOT, "rank", "pid", "user_name", "time_s", label.alias("label"))


def snapshot_report(counts: DataFrame, issues: DataFrame, servers: DataFrame) -> DataFrame:
    """One row per snapshot with the server's version ('' if unknown), its counts, the highest severity's label and its
    issues (detector, severity, title, description, details) in the detectors' order, ready for write.json."""
    issue = F.struct("ordinal", "title", "description", "detector", severity_label(F.col("severity")).alias("severity"), F.map_entries("details").alias("entries"))
    nested = issues.groupBy(*SNAPSHOT).agg(F.max("severity").alias("s"), F.array_sort(F.collect_list(issue)).alias("issues"))
    told = F.transform("issues", lambda i: F.struct(i["detector"].alias("detector"), i["severity"].alias("severity"), i["title"].alias("title"), i["description"].alias("description"), F.map_from_entries(i["entries"]).alias("details")))
    rows = counts.join(nested, SNAPSHOT, "left").join(servers.select("server_id", F.col("version").alias("server")), "server_id", "left")
    return rows.withColumn("max_severity", severity_label(F.coalesce("s", F.lit(0)))).withColumn("issues", F.coalesce(told, F.array().cast(issues_type()))).withColumn("server", F.coalesce("server", F.lit(""))).drop("s")


def report_issues(issues: DataFrame) -> DataFrame:
    """The issues of the snapshot reports as rows, whole, ready for write.json; ``ordinal`` has the detectors' order. For
    snapshots whose issues are too many for one row."""
    return issues.select(*SNAPSHOT, "ordinal", "detector", severity_label(F.col("severity")).alias("severity"), "title", "description", "details")


def report_heads(counts: DataFrame, told: DataFrame, servers: DataFrame) -> DataFrame:
    """`snapshot_report` with the number of issues, of critical ones and of those with description and details in place of
    the issues, from ``told`` (`report_issues`). A snapshot's issues are counted where they are and meet nowhere."""
    whole = (F.col("description") != "") & (F.size("details") > 0)
    place = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity"))
    sums = told.groupBy(*SNAPSHOT).agg(F.max(place).alias("s"), *(c.cast("int").alias(n) for n, c in {"issues": F.count("*"), "critical": F.count_if(F.col("severity") == "CRITICAL"), "described": F.count_if(whole)}.items()))
    rows = counts.join(sums, SNAPSHOT, "left").join(servers.select("server_id", F.col("version").alias("server")), "server_id", "left")
    return rows.withColumns({n: F.coalesce(n, F.lit(0)) for n in ("issues", "critical", "described")} | {"max_severity": severity_label(F.coalesce("s", F.lit(1)) - 1), "server": F.coalesce("server", F.lit(""))}).drop("s")


def report_rows(heads: DataFrame, told: DataFrame) -> DataFrame:
    """The whole snapshot reports as rows: each issue of ``told`` (`report_issues`) with its snapshot's head of ``heads``
    (`report_heads`), and one row without an issue for a snapshot that has none. Heads, one a snapshot, go to where the
    issues are, so texts are not moved and no row holds more than one issue; `snapshot_report` nests them instead."""
    head = heads.drop("issues", "critical", "described")
    return told.join(F.broadcast(head), SNAPSHOT).unionByName(head.join(heads.filter("issues = 0").select(*SNAPSHOT), SNAPSHOT, "left_semi"), allowMissingColumns=True)


def issues_type() -> str:
    return "array<struct<detector: string, severity: string, title: string, description: string, details: map<string, string>>>"
