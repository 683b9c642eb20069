"""Counter deltas with seeds and resets, session samples and retention (batch forms)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.functions.text import app_tag, is_cpu_wait, wait_class

DIGEST_COUNTERS = {
    "count_star": "exec_delta", "sum_timer_wait": "timer_delta", "sum_rows_examined": "rows_examined_delta", "sum_rows_sent": "rows_sent_delta", "sum_lock_time": "lock_delta",
    "sum_no_index_used": "no_index_delta", "sum_created_tmp_disk_tables": "tmp_disk_delta", "sum_sort_merge_passes": "sort_merge_delta",
}
RESET_CHECKED = ("count_star", "sum_timer_wait", "sum_rows_examined", "sum_rows_sent", "sum_lock_time")
DIGEST_KEY = ("server_id", "schema_name", "digest")


def with_before(rows: DataFrame, key: list[str]) -> DataFrame:
    """``rows`` and, as struct ``before``, the row of the same key with the next smaller poll_ts.

    Windows hold one key's rows of one day; a day's first row takes the last one of the day before that has any, from a
    window over one row a day. No key and no poll_ts may be null. The struct is the whole row and both sides share filters, so
    that they can read one shuffle."""
    row, by_day = F.struct(*rows.columns), [*key, "day"]
    rows = rows.withColumn("row", row).withColumn("day", F.to_date("poll_ts")).filter("day is not null")
    last = rows.groupBy(*by_day).agg(F.max_by("row", "poll_ts").alias("last"))
    carried = last.select(*by_day, F.lag("last").over(Window.partitionBy(*key).orderBy("day")).alias("carried"))
    rows = rows.withColumn("before", F.lag("row").over(Window.partitionBy(*by_day).orderBy("poll_ts"))).join(carried, by_day)
    return rows.select("row.*", F.coalesce("before", "carried").alias("before"))


def digest_outcomes(polls: DataFrame, digest_polls: DataFrame) -> DataFrame:
    """Every digest row of every poll with its outcome (seed, reset, idle or emit) and its deltas.

    ``polls`` are the successful polls (server_id, poll_ts), empty ones included: a delta is taken against the poll
    just before only. Rows of one key and poll are summed. Counters that are not reset-checked are clamped at 0."""
    by_server = Window.partitionBy("server_id").orderBy("poll_ts")
    log = polls.select("server_id", "poll_ts").distinct().withColumn("prev_poll_ts", F.lag("poll_ts").over(by_server))
    rows = digest_polls.filter("digest is not null and server_id is not null and poll_ts is not null").withColumn("schema_name", F.coalesce("schema_name", F.lit("")))
    rows = rows.groupBy(*DIGEST_KEY, "poll_ts").agg(F.max("digest_text").alias("digest_text"), *(F.sum(c).cast("decimal(20,0)").alias(c) for c in DIGEST_COUNTERS))
    rows = with_before(rows, list(DIGEST_KEY))
    rows = rows.withColumns({"seen_ts": F.col("before.poll_ts")} | {f"prev_{c}": F.col(f"before.{c}") for c in DIGEST_COUNTERS})
    rows = rows.join(log, ["server_id", "poll_ts"])
    reset = F.lit(False)
    for c in RESET_CHECKED:
        reset = reset | (F.col(c) < F.col(f"prev_{c}"))
    moved = (F.col("count_star") > F.col("prev_count_star")) | (F.col("sum_timer_wait") > F.col("prev_sum_timer_wait"))
    outcome = F.when(F.col("seen_ts").isNull() | F.col("prev_poll_ts").isNull() | (F.col("seen_ts") != F.col("prev_poll_ts")), "seed").when(reset, "reset").when(moved, "emit").otherwise("idle")
    interval = (F.unix_micros("poll_ts") - F.unix_micros("prev_poll_ts")) * 1000
    return rows.select(
        *DIGEST_KEY, "poll_ts", "digest_text", outcome.alias("outcome"), interval.alias("interval_ns"),
        *(F.greatest(F.col(c) - F.col(f"prev_{c}"), F.lit(0)).cast("long").alias(d) for c, d in DIGEST_COUNTERS.items()),
    )


def digest_deltas(polls: DataFrame, digest_polls: DataFrame) -> DataFrame:
    return digest_outcomes(polls, digest_polls).filter("outcome = 'emit'").drop("outcome")


def digest_poll_audit(polls: DataFrame, digest_polls: DataFrame) -> DataFrame:
    out = digest_outcomes(polls, digest_polls).groupBy("server_id", "poll_ts")
    return out.agg(F.count("*").alias("seen"), *(F.count_if(F.col("outcome") == o).alias(n) for o, n in (("emit", "emitted"), ("reset", "resets"), ("seed", "seeded"))))


def wait_outcomes(wait_polls: DataFrame, log: DataFrame) -> DataFrame:
    """Every wait event of every poll with outcome and deltas; a delta may span polls that missed the event.

    ``log`` are the successful polls (server_id, poll_ts), those without waits included: intervals are between them.
    Rows of a poll that the log lacks are baselines and no more."""
    polls = log.select("server_id", "poll_ts").distinct().withColumn("prev_poll_ts", F.lag("poll_ts").over(Window.partitionBy("server_id").orderBy("poll_ts")))
    rows = with_before(wait_polls.filter("count_star > 0 and event_name is not null and server_id is not null and poll_ts is not null"), ["server_id", "event_name"])
    rows = rows.withColumns({"seen_ts": F.col("before.poll_ts"), "pc": F.col("before.count_star"), "pt": F.col("before.sum_timer_wait")}).join(polls, ["server_id", "poll_ts"])
    outcome = F.when(F.col("seen_ts").isNull(), "seed").when((F.col("count_star") < F.col("pc")) | (F.col("sum_timer_wait") < F.col("pt")), "reset").otherwise("delta")
    return rows.select(
        "server_id", "poll_ts", "event_name", wait_class(F.col("event_name")).alias("class"), outcome.alias("outcome"), ((F.unix_micros("poll_ts") - F.unix_micros("prev_poll_ts")) * 1000).alias("interval_ns"),
        (F.col("seen_ts") < F.col("prev_poll_ts")).alias("spans_gap"), (F.col("count_star") - F.col("pc")).cast("long").alias("count_delta"), (F.col("sum_timer_wait") - F.col("pt")).cast("long").alias("timer_delta_ps"),
    )


def wait_deltas(wait_polls: DataFrame, log: DataFrame) -> DataFrame:
    """Class sums of each poll's wait deltas."""
    rows = wait_outcomes(wait_polls, log).filter("outcome = 'delta'").groupBy("server_id", "poll_ts", "class")
    rows = rows.agg(F.max("interval_ns").alias("interval_ns"), F.sum("count_delta").alias("count_delta"), F.sum("timer_delta_ps").alias("timer_delta_ps"), F.bool_or("spans_gap").alias("spans_gap"))
    return rows.filter("count_delta <> 0 or timer_delta_ps <> 0")


def wait_poll_audit(wait_polls: DataFrame, log: DataFrame) -> DataFrame:
    """Per successful poll what it saw, seeded and reset, and the classes it emitted; polls without waits have zeros."""
    counts = wait_outcomes(wait_polls, log).groupBy("server_id", "poll_ts").agg(F.count("*").alias("seen"), F.count_if(F.col("outcome") == "seed").alias("seeded"), F.count_if(F.col("outcome") == "reset").alias("resets"))
    emitted = wait_deltas(wait_polls, log).groupBy("server_id", "poll_ts").agg(F.count("*").alias("emitted"))
    every = log.select("server_id", "poll_ts").distinct()
    return every.join(counts, ["server_id", "poll_ts"], "left").join(emitted, ["server_id", "poll_ts"], "left").fillna(0, ["seen", "seeded", "resets", "emitted"])


def executing_sessions(ticks: DataFrame) -> DataFrame:
    """Session samples: executing sessions with their application tag (also the projection D7)."""
    return ticks.filter("executing").select("server_id", F.col("tick_ts").alias("ts"), "processlist_id", "digest", "schema_name", app_tag(F.col("sql_text"), F.col("program_name")).alias("app_tag"), "user_name", "host", F.col("current_wait").alias("event_name"), "executing")


def cpu_samples(ticks: DataFrame, tick_log: DataFrame, every: str = "10 seconds") -> DataFrame:
    """Per flush interval: executing sessions on CPU and successful ticks; ``tick_log`` (server_id, tick_ts) has empty ticks too."""
    on_cpu = ticks.filter(F.col("executing") & is_cpu_wait(F.col("current_wait"))).select("server_id", "tick_ts", F.lit(1).alias("n"), F.lit(False).alias("good"))
    rows = on_cpu.unionByName(tick_log.select("server_id", "tick_ts", F.lit(0).alias("n"), F.lit(True).alias("good")))
    every_tick = rows.groupBy("server_id", "tick_ts").agg(F.sum("n").alias("n"), F.bool_or("good").alias("good")).filter("good")
    return every_tick.groupBy("server_id", F.window("tick_ts", every)["start"].alias("ts")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("cpu_observations"), F.count("*").alias("cpu_ticks"))


def aborted_clients_delta(vitals: DataFrame) -> DataFrame:
    before = F.lag("aborted_clients", 1, 0).over(Window.partitionBy("server_id").orderBy("poll_ts"))
    return vitals.withColumn("aborted_delta", F.greatest(F.col("aborted_clients") - before, F.lit(0)))


def retained_samples(samples: DataFrame, series: list[str], as_of: Column, window_s: int, newest: int, ts: str = "poll_ts") -> DataFrame:
    """The newest ``newest`` samples of each series that lie in the window up to ``as_of`` (0: no lower bound)."""
    rank = F.row_number().over(Window.partitionBy(*series).orderBy(F.desc(ts)))
    samples = samples.filter(F.col(ts) <= as_of)
    if window_s:
        samples = samples.filter(F.unix_micros(ts) >= F.unix_micros(as_of) - window_s * 1_000_000)
    return samples.withColumn("__rank", rank).filter(F.col("__rank") <= newest).drop("__rank")


def latest_sample(samples: DataFrame, series: list[str], ts: str = "poll_ts") -> DataFrame:
    rest = [c for c in samples.columns if c not in series]
    return samples.groupBy(*series).agg(F.max_by(F.struct(*rest), ts).alias("s")).select(*series, "s.*")


def tracked_digests(deltas: DataFrame, most: int, protect_s: int, as_of: Column) -> DataFrame:
    """At most ``most`` digests of each server: young ones first, then by cumulative load; the rest is evicted."""
    rows = deltas.groupBy(*DIGEST_KEY).agg(F.sum("timer_delta").alias("load"), F.min("poll_ts").alias("first_seen"), F.max("digest_text").alias("digest_text"))
    young = F.unix_micros("first_seen") > F.unix_micros(as_of) - protect_s * 1_000_000
    order = Window.partitionBy("server_id").orderBy(F.desc(young), F.desc("load"), "schema_name", "digest")
    rows = rows.withColumn("place", F.row_number().over(order))
    return rows.withColumn("kept", F.col("place") <= most).withColumn("evicted", F.sum(F.when(F.col("kept"), 0).otherwise(1)).over(Window.partitionBy("server_id"))).drop("place")


def poll_error_counts(polls: DataFrame) -> DataFrame:
    return polls.groupBy("server_id", "collector").agg(F.count("*").alias("polls"), F.count_if(~F.col("ok")).alias("failed"))
