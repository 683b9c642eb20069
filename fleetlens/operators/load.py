"""Average active sessions by statement, class, user, host, schema and table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.functions.format import div, half_up
from fleetlens.functions.text import WAIT_CLASSES, table_from_sql

SORTS = {"aas": "aas", "calls": "calls", "latency": "avg_latency_ns", "rows": "rows_examined"}


def statement_load(deltas: DataFrame, sessions: DataFrame | None = None, app: str | None = None, schema: str | None = None, denominator: str = "samples", wall_s: float | None = None) -> DataFrame:
    """Load of each digest over the given deltas. The denominator is the time of the emitted samples, or ``wall_s``."""
    rows = deltas
    if schema is not None:
        rows = rows.filter(F.col("schema_name") == schema)
    if app is not None:
        rows = rows.join(sessions.filter(F.col("app_tag") == app).select("server_id", "digest").distinct(), ["server_id", "digest"], "left_semi")
    s = F.lit(wall_s) if denominator == "wall" else F.sum("interval_ns") / 1e9
    out = rows.groupBy("server_id", "schema_name", "digest").agg(
        F.max("digest_text").alias("digest_text"), F.sum("exec_delta").alias("calls"), F.sum("timer_delta").alias("timer_ps"), F.sum("rows_examined_delta").alias("rows_examined"),
        F.sum("rows_sent_delta").alias("rows_sent"), F.sum("no_index_delta").alias("no_index_calls"), s.alias("seconds"),
    )
    return statement_columns(out, ["server_id", "schema_name", "digest"])


def statement_columns(sums: DataFrame, key: list[str]) -> DataFrame:
    """Rates and means of statements from their sums."""
    return sums.filter("calls > 0").select(
        *key, "digest_text", "calls", div(div(F.col("timer_ps"), F.col("calls")), 1000).alias("avg_latency_ns"), F.round(F.col("timer_ps") / 1e12 / F.col("seconds"), 6).alias("aas"),
        F.round(F.col("calls") / F.col("seconds"), 6).alias("calls_per_s"), F.round(F.col("rows_examined") / F.col("calls"), 6).alias("rows_per_call"), "rows_examined", "rows_sent", (F.col("no_index_calls") > 0).alias("no_idx"),
    )


def top_sql(deltas: DataFrame, sort: str = "aas", limit: int = 20, **filters) -> DataFrame:
    order = Window.partitionBy("server_id").orderBy(F.desc(SORTS[sort]), "schema_name", "digest")
    return statement_load(deltas, **filters).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def load_by_group(samples: DataFrame, group: str) -> DataFrame:
    """Executing observations of each group over the distinct sample times of its server ('' is '(unknown)')."""
    ticks = samples.groupBy("server_id").agg(F.count_distinct("ts").alias("ticks"))
    rows = samples.filter("executing").groupBy("server_id", F.when(F.col(group) == "", "(unknown)").otherwise(F.col(group)).alias("name")).agg(F.count("*").alias("observations"))
    return rows.join(ticks, "server_id").select("server_id", "name", "observations", "ticks", F.round(F.col("observations") / F.col("ticks"), 6).alias("aas"))


def load_by_class(waits: DataFrame, cpu: DataFrame, servers: DataFrame) -> DataFrame:
    """Six rows per server in fixed order, zero without data, and the total."""
    classes = F.array(*(F.struct(F.lit(c).alias("class"), F.lit(i).alias("ordinal")) for i, c in enumerate(WAIT_CLASSES)))
    timed = waits.groupBy("server_id", "class").agg((F.sum("timer_delta_ps") / 1e12 / (F.sum("interval_ns") / 1e9)).alias("aas"))
    on_cpu = cpu.groupBy("server_id").agg((F.sum("cpu_observations") / F.sum("cpu_ticks")).alias("aas")).withColumn("class", F.lit("CPU"))
    rows = servers.select("server_id").distinct().select("server_id", F.inline(classes)).join(timed.unionByName(on_cpu), ["server_id", "class"], "left")
    return rows.select("server_id", "class", "ordinal", half_up(F.coalesce("aas", F.lit(0.0)), 6).alias("aas"), half_up(F.sum(F.coalesce("aas", F.lit(0.0))).over(Window.partitionBy("server_id")), 6).alias("total"))


def load_report(load: DataFrame, window_s: int | None = None) -> DataFrame:
    """One row per server (and poll) of `load_by_class` rows: classes MAP<STRING,DOUBLE>, total and, for a trailing window,
    its seconds; ready for write.json."""
    key = [c for c in ("server_id", "poll_ts") if c in load.columns]
    classes = F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "class", "aas"))), lambda x: F.struct(x["class"], x["aas"])))
    out = load.groupBy(*key).agg(classes.alias("classes"), F.max("total").alias("total"))
    return out if window_s is None else out.withColumn("window_seconds", F.lit(window_s))


def load_trail(waits: DataFrame, cpu: DataFrame, points: int = 60) -> DataFrame:
    """Total load at each poll time, the last ``points`` of each server."""
    timed = waits.select("server_id", F.col("poll_ts").alias("ts"), (F.col("timer_delta_ps") / 1e12 / (F.col("interval_ns") / 1e9)).alias("aas"))
    both = timed.unionByName(cpu.select("server_id", "ts", (F.col("cpu_observations") / F.col("cpu_ticks")).alias("aas")))
    rows = both.groupBy("server_id", "ts").agg(F.round(F.sum("aas"), 6).alias("aas"))
    return rows.withColumn("age", F.row_number().over(Window.partitionBy("server_id").orderBy(F.desc("ts")))).filter(F.col("age") <= points)


def busiest_tables(deltas: DataFrame, limit: int = 5, statements: int = 500) -> DataFrame:
    rows = top_sql(deltas, "aas", statements).withColumn("t", table_from_sql(F.col("digest_text"))).filter("t <> ''")
    name = F.when(F.col("t").contains(".") | (F.col("schema_name") == ""), F.col("t")).otherwise(F.concat_ws(".", "schema_name", "t"))
    out = rows.groupBy("server_id", name.alias("table_name")).agg(F.round(F.sum("aas"), 5).alias("aas"), F.round(F.sum("calls_per_s"), 5).alias("calls_per_s"))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("server_id").orderBy(F.desc("aas"), "table_name"))).filter(F.col("rank") <= limit)


def top_users_share(samples: DataFrame, limit: int = 5) -> DataFrame:
    rows = load_by_group(samples, "user_name").withColumn("rank", F.row_number().over(Window.partitionBy("server_id").orderBy(F.desc("observations"), "name"))).filter(F.col("rank") <= limit)
    return rows.withColumn("share", F.round(F.col("observations") / F.max("observations").over(Window.partitionBy("server_id")), 6))


def digest_app_samples(samples: DataFrame) -> DataFrame:
    ticks = samples.groupBy("server_id").agg(F.count_distinct("ts").alias("ticks"))
    return samples.filter("executing").groupBy("server_id", "digest", "app_tag").agg(F.count("*").alias("observations")).join(ticks, "server_id")
