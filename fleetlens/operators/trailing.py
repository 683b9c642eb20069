"""Load over a trailing window as of every poll: time-range frames over samples that are dealt out by key and day."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.functions.format import half_up
from fleetlens.functions.text import WAIT_CLASSES
from fleetlens.operators.load import SORTS, statement_columns

DAY_US = 86_400_000_000


def _next_polls(times: DataFrame, log: DataFrame, window_s: int) -> DataFrame:
    """(server_id, ts, n, ahead) for each (server_id, ts): the ordinal of the first poll at or after ts, and how many polls
    there are from it on within the window. Times behind the last poll go.

    Polls are numbered by server; the first poll behind a time is looked for within its day, else it is the first one
    of a later day that has any."""
    at = F.unix_micros("poll_ts")
    by_server = Window.partitionBy("server_id").orderBy(at)
    polls = log.select("server_id", "poll_ts").filter("server_id is not null and poll_ts is not null").distinct()
    polls = polls.select("server_id", "poll_ts", F.row_number().over(by_server).cast("long").alias("n"), F.count("*").over(by_server.rangeBetween(0, window_s * 1_000_000)).alias("ahead"))
    day = lambda c: F.floor(F.unix_micros(c) / DAY_US)
    poll = F.struct("n", "ahead")
    both = times.select("server_id", "ts", day("ts").alias("day"), F.lit(None).cast(polls.select(poll.alias("p")).schema["p"].dataType).alias("p"), F.lit(True).alias("is_time"))
    both = both.unionByName(polls.select("server_id", F.col("poll_ts").alias("ts"), day("poll_ts").alias("day"), poll.alias("p"), F.lit(False).alias("is_time")))
    onwards = Window.partitionBy("server_id", "day").orderBy(F.desc(F.unix_micros("ts"))).rangeBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("today", F.max_by("p", F.when(F.col("p").isNotNull(), -F.unix_micros("ts"))).over(onwards)).filter("is_time")
    firsts = both.groupBy("server_id", "day").agg(F.min_by("p", F.when(F.col("p").isNotNull(), F.unix_micros("ts"))).alias("first"))
    later = Window.partitionBy("server_id").orderBy("day").rowsBetween(1, Window.unboundedFollowing)
    firsts = firsts.select("server_id", "day", F.first("first", ignorenulls=True).over(later).alias("later"))
    found = found.join(firsts, ["server_id", "day"]).select("server_id", "ts", F.coalesce("today", "later").alias("p"))
    return found.filter("p is not null").select("server_id", "ts", "p.n", "p.ahead")


def trailing(samples: DataFrame, log: DataFrame, key: list[str], measures: list[str], window_s: int = 3600, ts: str = "poll_ts") -> DataFrame:
    """(key, poll_ts, measures summed) as of each poll of ``log``, over the samples of the ``window_s`` seconds up to it,
    both ends included, for the polls whose window has a sample of the key. ``key`` has server_id.

    A sample asks for the polls from it up to the key's next sample, so rows grow with what comes out. Frames stand in
    partitions of one key and day; samples are copied to the later days that their window reaches."""
    width = window_s * 1_000_000
    rows = samples.filter(F.col(ts).isNotNull() & F.col("server_id").isNotNull()).groupBy(*key, F.col(ts).alias("ts")).agg(*(F.sum(m).alias(m) for m in measures))
    times = _next_polls(rows.select("server_id", "ts").distinct(), log, window_s)
    placed = rows.select(*key, "ts").join(times, ["server_id", "ts"]).groupBy(*key, "n").agg(F.max("ahead").alias("ahead"), F.min(F.floor(F.unix_micros("ts") / DAY_US)).alias("day"))
    after = F.lead("n").over(Window.partitionBy(*key, "day").orderBy("n"))
    asked = placed.withColumn("after", after).select(*key, F.explode(F.sequence("n", F.least(F.coalesce(F.col("after") - 1, F.col("n") + F.col("ahead") - 1), F.col("n") + F.col("ahead") - 1))).alias("n")).distinct()
    numbered = log.select("server_id", "poll_ts").filter("server_id is not null and poll_ts is not null").distinct().withColumn("n", F.row_number().over(Window.partitionBy("server_id").orderBy(F.unix_micros("poll_ts"))).cast("long"))
    grid = asked.join(numbered, ["server_id", "n"]).select(*key, F.unix_micros("poll_ts").alias("us"), "poll_ts", *(F.lit(None).cast(rows.schema[m].dataType).alias(m) for m in measures), F.lit(0).alias("seen"))
    day = F.floor(F.col("us") / DAY_US)
    own = rows.select(*key, F.unix_micros("ts").alias("us"), F.lit(None).cast("timestamp").alias("poll_ts"), *measures, F.lit(1).alias("seen"))
    own = own.withColumn("day", F.explode(F.sequence(day, F.floor((F.col("us") + width) / DAY_US))))
    frame = Window.partitionBy(*key, "day").orderBy("us").rangeBetween(-width, 0)
    both = own.unionByName(grid.withColumn("day", day))
    summed = both.select(*key, "poll_ts", F.sum("seen").over(frame).alias("seen"), *(F.sum(m).over(frame).alias(m) for m in measures))
    return summed.filter("poll_ts is not null and seen > 0").drop("seen")


def top_sql_as_of(deltas: DataFrame, log: DataFrame, window_s: int = 3600, sort: str = "aas", limit: int = 20) -> DataFrame:
    """The top statements of each server as of each poll, by the samples of the window up to it."""
    measures = ["exec_delta", "timer_delta", "rows_examined_delta", "rows_sent_delta", "no_index_delta", "interval_ns"]
    key = ["server_id", "schema_name", "digest"]
    texts = deltas.groupBy(*key).agg(F.max("digest_text").alias("digest_text"))
    sums = trailing(deltas, log, key, measures, window_s).withColumnsRenamed({"exec_delta": "calls", "timer_delta": "timer_ps", "rows_examined_delta": "rows_examined", "rows_sent_delta": "rows_sent", "no_index_delta": "no_index_calls"})
    rows = statement_columns(sums.withColumn("seconds", F.col("interval_ns") / 1e9).join(texts, key), [*key[:1], "poll_ts", *key[1:]])
    order = Window.partitionBy("server_id", "poll_ts").orderBy(F.desc(SORTS[sort]), "schema_name", "digest")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def load_by_group_as_of(samples: DataFrame, log: DataFrame, group: str, window_s: int = 3600) -> DataFrame:
    """Executing observations of each group over the distinct sample times of its server, as of each poll."""
    ticks = trailing(samples.select("server_id", "ts").distinct().withColumn("ticks", F.lit(1)), log, ["server_id"], ["ticks"], window_s, "ts")
    name = F.when(F.col(group) == "", "(unknown)").otherwise(F.col(group)).alias("name")
    rows = samples.filter("executing").select("server_id", "ts", name, F.lit(1).alias("observations"))
    found = trailing(rows, log, ["server_id", "name"], ["observations"], window_s, "ts").join(ticks, ["server_id", "poll_ts"])
    return found.select("server_id", "poll_ts", "name", "observations", "ticks", F.round(F.col("observations") / F.col("ticks"), 6).alias("aas"))


def load_by_class_as_of(waits: DataFrame, cpu: DataFrame, log: DataFrame, window_s: int = 3600) -> DataFrame:
    """Six rows per server and poll in fixed order, zero without data, and the total."""
    classes = F.array(*(F.struct(F.lit(c).alias("class"), F.lit(i).alias("ordinal")) for i, c in enumerate(WAIT_CLASSES)))
    timed = waits.select("server_id", "class", "poll_ts", F.col("timer_delta_ps").alias("top"), F.col("interval_ns").alias("bottom"))
    on_cpu = cpu.select("server_id", F.lit("CPU").alias("class"), F.col("ts").alias("poll_ts"), F.col("cpu_observations").alias("top"), F.col("cpu_ticks").alias("bottom"))
    sums = trailing(timed.unionByName(on_cpu), log, ["server_id", "class"], ["top", "bottom"], window_s)
    aas = F.when(F.col("class") == "CPU", F.col("top") / F.col("bottom")).otherwise(F.col("top") / 1e12 / (F.col("bottom") / 1e9))
    every = log.select("server_id", "poll_ts").distinct().select("server_id", "poll_ts", F.inline(classes))
    rows = every.join(sums.select("server_id", "poll_ts", "class", aas.alias("aas")), ["server_id", "poll_ts", "class"], "left").withColumn("aas", F.coalesce("aas", F.lit(0.0)))
    total = F.sum("aas").over(Window.partitionBy("server_id", "poll_ts").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return rows.select("server_id", "poll_ts", "class", "ordinal", half_up(F.col("aas"), 6).alias("aas"), half_up(total, 6).alias("total"))
