"""Digest deltas as a table by day: a new day is made from its own polls and what the day before carries over."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.operators.deltas import DIGEST_COUNTERS, DIGEST_KEY, digest_deltas

#: What a day carries over: the last row of each digest that is in its server's last poll or later, and that poll.
CARRIED = [*DIGEST_KEY, "poll_ts", "digest_text", *DIGEST_COUNTERS]


def _written(df: DataFrame, path: str) -> None:
    """Replace the days that ``df`` has, and no other; files of a day are sorted by server for pruning by statistics."""
    df.repartition("day").sortWithinPartitions("day", "server_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def _carry(polls: DataFrame, digest_polls: DataFrame, day: dt.date) -> DataFrame:
    """The rows and, with a null digest, the last poll of each server, under ``day``."""
    last = polls.groupBy("server_id").agg(F.max("poll_ts").alias("last"))
    rows = digest_polls.filter("digest is not null and server_id is not null and poll_ts is not null").withColumn("schema_name", F.coalesce("schema_name", F.lit(""))).select(*CARRIED)
    newest = rows.groupBy(*DIGEST_KEY).agg(F.max("poll_ts").alias("poll_ts"))
    kept = rows.join(newest, [*DIGEST_KEY, "poll_ts"]).join(last, "server_id", "left").filter("last is null or poll_ts >= last").drop("last")
    marks = last.select("server_id", F.col("last").alias("poll_ts"))
    return kept.select(*CARRIED).unionByName(marks, allowMissingColumns=True).withColumn("day", F.lit(day))


def build(polls: DataFrame, digest_polls: DataFrame, path: str) -> None:
    """Write the deltas of all days at once, and what the last one carries over."""
    _written(digest_deltas(polls, digest_polls).withColumn("day", F.to_date("poll_ts")), f"{path}/deltas")
    last = polls.agg(F.to_date(F.max("poll_ts"))).first()[0]
    if last is not None:
        _written(_carry(polls, digest_polls, last), f"{path}/carried")


def add_day(spark: SparkSession, polls: DataFrame, digest_polls: DataFrame, path: str, day: dt.date) -> None:
    """Write one day's deltas, again if they are there, from its polls and what the latest day before it carries over.

    ``polls`` and ``digest_polls`` are read for that day only. Days are added in order; to mend a day, add it and those
    after it again."""
    today = F.to_date("poll_ts") == F.lit(day)
    carried = spark.read.parquet(f"{path}/carried").filter(F.col("day") < F.lit(day))
    before = carried.agg(F.max("day")).first()[0]  # of the folders' names
    carried = carried.filter(F.col("day") == F.lit(before))
    log = polls.select("server_id", "poll_ts").filter(today).unionByName(carried.filter("digest is null").select("server_id", "poll_ts"))
    rows = digest_polls.withColumn("schema_name", F.coalesce("schema_name", F.lit(""))).select(*CARRIED).filter(today).unionByName(carried.filter("digest is not null").select(*CARRIED))
    _written(digest_deltas(log, rows).filter(today).withColumn("day", F.lit(day)), f"{path}/deltas")
    _written(_carry(log, rows, day), f"{path}/carried")


def deltas_between(spark: SparkSession, path: str, first: dt.date, last: dt.date) -> DataFrame:
    """The deltas of some days; only their folders are read."""
    return spark.read.parquet(f"{path}/deltas").filter(F.col("day").between(F.lit(first), F.lit(last))).drop("day")
