"""Joins whose result is far larger than what meets: rows of two sides that share a key of which both have many."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Items in a block: writers of Parquet pack 504 values in a run, so blocks of that many repeat to the byte and compress.
#: Parts that the many rows of a key are dealt out to; partitions for each shuffle partition.
BLOCK, SALTS, SPREAD = 504, 8, 4
#: Blocks that are gathered together.
GATHERED = 32


def dealt_join(many: DataFrame, few: DataFrame, on: list[str], deal: str, how: str = "inner") -> DataFrame:
    """A join of many rows with few, large ones. The many rows of a key are dealt out by ``deal``, each part meets a copy of
    the key's few rows, and the number of partitions is fixed: by its input alone the planner would take too few.

    The key is one struct: of a key's columns the planner takes out those that are constant, and would then deal
    everything out once more, to few partitions. In an inner join each of the few rows meets all of the many in turn."""
    spark, key = many.sparkSession, "_".join(on)
    whole = reduce(Column.__and__, (F.col(c).isNotNull() for c in on))
    n = SPREAD * int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = lambda df, salt: df.withColumns({key: F.when(whole, F.struct(*on)), "salt": salt}).repartition(n, key, "salt")
    parts = dealt(many, F.pmod(F.xxhash64(deal), F.lit(SALTS)).cast("int"))
    copies = dealt(few, F.explode(F.array(*map(F.lit, range(SALTS))))).drop(*on)
    met = copies.join(parts, [key, "salt"]) if how == "inner" else parts.join(copies, [key, "salt"], how)
    return met.drop(key, "salt")


def paired(left: DataFrame, right: DataFrame, on: list[str], deal: str, item: str) -> DataFrame:
    """Each row of ``left`` with each ``item`` of the rows of ``right`` that have the same ``on``.

    Items are put in blocks of a key and of what else ``right`` has; blocks meet left rows, and a pair is made where it
    goes out: it is not shuffled, sorted or held. A block is paired with all left rows of its part before the next one is,
    so that what is written repeats after a block's length."""
    rest = [c for c in right.columns if c != item]
    sizes = right.groupBy(*on).agg(F.count("*").alias("n"))
    blocks = right.join(sizes, on).withColumn("block", F.pmod(F.xxhash64(item), F.ceil(F.col("n") / (BLOCK * GATHERED)))).groupBy(*rest, "block").agg(F.array_sort(F.collect_list(item)).alias("items"))
    blocks = blocks.withColumn("first", F.explode(F.sequence(F.lit(1), F.size("items"), F.lit(BLOCK)))).select(*rest, F.slice("items", F.col("first"), F.lit(BLOCK)).alias("items"))
    met = dealt_join(left, blocks, on, deal)
    return met.select(*left.columns, *(c for c in rest if c not in on), F.explode("items").alias(item))
