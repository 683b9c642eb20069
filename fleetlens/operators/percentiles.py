"""Latency percentiles from histograms that merge by addition, with a bound on the error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets for each power of two; a bucket's width is at most this part of its values.
PARTS = 32
RELATIVE_ERROR = 1 / (2 * PARTS)


def bucket_of(value: Column) -> Column:
    """The bucket of a whole number of at least 0, in integer arithmetic: below 2 * PARTS each has its own, above, each
    power of two has PARTS of equal width. Negative values and nulls have none."""
    value = value.cast("bigint")
    shift = F.greatest(F.length(F.bin(value)) - (2 * PARTS).bit_length() + 1, F.lit(0))
    return F.when(value >= 0, F.call_function("shiftright", value, shift) + shift * PARTS)


def bounds_of(bucket: Column) -> tuple[Column, Column]:
    """The least and the greatest value of a bucket."""
    shift = F.greatest(F.floor(bucket / PARTS) - 1, F.lit(0)).cast("int")
    low = F.call_function("shiftleft", (bucket - shift * PARTS).cast("bigint"), shift)
    return low, low + F.call_function("shiftleft", F.lit(1).cast("bigint"), shift) - 1


def histogram(samples: DataFrame, key: list[str], value: str) -> DataFrame:
    """(key, bucket, n) of the samples; a key has some two thousand buckets at most."""
    return samples.select(*key, bucket_of(F.col(value)).alias("bucket")).filter("bucket is not null").groupBy(*key, "bucket").agg(F.count("*").alias("n"))


def merged(histograms: DataFrame, key: list[str]) -> DataFrame:
    """Histograms of a coarser key: counts of equal buckets added up, as of other hours or servers."""
    return histograms.groupBy(*key, "bucket").agg(F.sum("n").alias("n"))


def percentiles(histograms: DataFrame, key: list[str], shares: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """(key, share, n, value): for each share the middle of the bucket that holds the sample of rank ceil(share * n).

    That sample is in the bucket, so ``value`` differs from it by at most RELATIVE_ERROR of it, and by nothing below
    2 * PARTS, whatever was merged."""
    by = Window.partitionBy(*key)
    low, high = bounds_of(F.col("bucket"))
    rows = histograms.select(*key, "bucket", "n", F.sum("n").over(by.orderBy("bucket")).alias("upto"), F.sum("n").over(by).alias("total"))
    rows = rows.withColumn("share", F.explode(F.array(*map(F.lit, shares)))).withColumn("rank", F.greatest(F.ceil(F.col("share") * F.col("total")), F.lit(1)))
    return rows.filter((F.col("rank") <= F.col("upto")) & (F.col("rank") > F.col("upto") - F.col("n"))).select(*key, "share", F.col("total").alias("n"), ((low + high) / 2).alias("value"))
