"""Landing of relations and streams as Parquet in the folder that the whole cluster shares."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path under ``spark.checkpoint.dir``, removed when the driver's Python ends. Where that is unset, a temporary
    folder is set for a session of one machine, as in tests; a cluster has to name one that all its machines share."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not root:
        root = "file://" + tempfile.mkdtemp(prefix="fleetlens-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/telemetry-{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may be gone already; the folder is scratch space
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def landed(df: DataFrame, name: str) -> DataFrame:
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def as_stream(df: DataFrame, name: str, time: str | None = None, parts: int = 1) -> DataFrame:
    """Land a relation and read it as a file stream.

    With ``time``, in ``parts`` appends by equal spans of that column and a last row of nulls one year later, which moves
    the watermark past all others; a micro-batch reads the files of one append."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, name)
    if time is None:
        df.write.parquet(path)
        return spark.readStream.schema(df.schema).parquet(path)
    rows = landed(df, f"{name}-rows")
    first, last = rows.agg(F.min(F.unix_micros(time)), F.max(F.unix_micros(time))).first()
    if first is not None:
        part = F.least(F.floor((F.unix_micros(time) - first) * parts / (last - first + 1)), F.lit(parts - 1))
        for i in range(parts):
            rows.filter(part == i).coalesce(1).write.mode("append").parquet(path)
        end = spark.range(1).select(*(F.timestamp_micros(F.lit(last + 366 * 86_400_000_000)).alias(c) if c == time else F.lit(None).cast(k).alias(c) for c, k in df.dtypes))
        end.coalesce(1).write.mode("append").parquet(path)
    else:
        rows.write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def drained(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream in append mode to the end of what has landed and read its result."""
    spark = stream.sparkSession
    out = shared_path(spark, f"{name}-out")
    writer = stream.writeStream.outputMode("append").option("checkpointLocation", shared_path(spark, f"{name}-checkpoint")).trigger(availableNow=True)
    writer.format("parquet").option("path", out).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
