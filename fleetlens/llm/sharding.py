"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetlens.llm.common import landed

FAN_IN = 64
#: Bytes are the law; tokens and rows decide between bins that are near equal in bytes.
WEIGHTS = np.array([100.0, 1.0, 1.0])


def dot_product_packing(items: np.ndarray, bins: int) -> np.ndarray:
    """The bin of each row of ``items`` (rows of non-negative sizes), largest first, each where the dot product of
    its size with the bin's residual capacity is highest. Sizes and capacities are shares of the items' sums."""
    total = items.sum(axis=0)
    share = items / np.where(total > 0, total, 1)
    residual = np.full((bins, items.shape[1]), 1.0 / bins)
    out = np.zeros(len(items), np.int32)
    for i in np.argsort(-share.sum(axis=1), kind="stable"):
        at = int(np.argmax(residual @ (WEIGHTS * share[i])))
        residual[at] -= share[i]
        out[i] = at
    return out


def _packed(pdf: pd.DataFrame, keys: list[str], shards: int) -> pd.DataFrame:
    pdf = pdf.sort_values(keys, kind="stable")
    return pdf.assign(bin=dot_product_packing(pdf[["bytes", "tokens", "rows"]].to_numpy(float), shards))


def pack_shards(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", rows_per_bucket: int = 4_000, split_share: float = 1 / 4) -> DataFrame:
    """Put every row of ``docs`` into a shard; rows of equal text form a group and stay together.

    Size is the UTF-8 length plus 16; tokens are runs between spaces. A group of over ``split_share`` of one shard's
    bytes or rows is split by row number, landed with the rows, into pieces below that share (there are at most
    2 * shards / split_share such groups, which bounds what is broadcast). Pieces are hashed into buckets; each bucket is packed by itself into ``shards``
    bins, and its bins are then packed, FAN_IN buckets at a time, until one packing remains. No task sees more than a
    bucket's groups or FAN_IN * shards bins.

    Null text: 16 bytes, no tokens, crc null, one group with the empty text's. Null and repeated ids are rows like
    any other. An empty table gives an empty result. Other columns are ignored.
    Returns id, size, text_crc32, shard, slot (gapless from 0 in a shard)."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = landed(
        docs.select(
            F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), (F.octet_length(text).cast("long") + 16).alias("size"), F.crc32(F.col(text_col).cast("binary")).alias("crc"),
            (F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit(""))) + (F.length(text) > 0).cast("int")).cast("long").alias("tokens"), F.xxhash64(text).alias("text_key"),
        ),
        "shard-rows",
    )
    groups = rows.groupBy("text_key").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    whole = groups.agg(F.sum("bytes"), F.sum("n")).first()
    most_bytes, most_rows = max(1.0, (whole[0] or 0) * split_share / shards), max(1.0, (whole[1] or 0) * split_share / shards)
    hot = groups.filter((F.col("n") > 1) & ((F.col("bytes") > most_bytes) | (F.col("n") > most_rows))).select(
        "text_key", F.ceil(F.greatest(F.col("bytes") / most_bytes, F.col("n") / most_rows)).cast("long").alias("pieces")
    )
    buckets = max(1, -(-(whole[1] or 0) // rows_per_bucket))
    pieced = rows.join(F.broadcast(hot), "text_key", "left").withColumn("piece", F.coalesce(F.pmod(F.xxhash64("row"), F.col("pieces")), F.lit(0))).drop("pieces")
    pieced = pieced.withColumn("bucket", F.pmod(F.xxhash64("text_key", "piece"), F.lit(buckets)).cast("int"))
    items = pieced.groupBy("bucket", "text_key", "piece").agg(F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows"))
    placed = landed(
        items.groupBy("bucket").applyInPandas(lambda p: _packed(p, ["text_key", "piece"], shards), "bucket int, text_key long, piece long, bytes long, tokens long, rows long, bin int"), "shard-groups"
    )
    where = _merge_bins(spark, placed.groupBy("bucket", "bin").agg(F.sum("bytes").alias("bytes"), F.sum("tokens").alias("tokens"), F.sum("rows").alias("rows")), buckets, shards)
    counted = where.withColumn("before", F.sum("rows").over(Window.partitionBy("shard").orderBy("bucket", "bin").rowsBetween(Window.unboundedPreceding, -1)))
    counted = counted.select("bucket", "bin", "shard", F.coalesce("before", F.lit(0)).alias("before"))
    to = placed.select("bucket", "text_key", "piece", "bin").join(counted, ["bucket", "bin"])
    at = pieced.join(to.drop("bucket"), ["text_key", "piece"])
    slot = F.row_number().over(Window.partitionBy("bucket", "bin").orderBy("id", "size", "crc")) - 1
    return at.select("id", "size", "crc", "shard", (F.col("before") + slot).cast("long").alias("slot")).withColumnsRenamed({"id": id_col, "crc": "text_crc32"})


def _merge_bins(spark: SparkSession, bins: DataFrame, buckets: int, shards: int) -> DataFrame:
    """(bucket, bin, rows, shard): each bucket's bins packed level by level into the final shards."""
    level = landed(bins.select("bucket", "bin", "bytes", "tokens", "rows", F.col("bucket").alias("node"), F.col("bin").alias("at")), "shard-bins")
    while True:
        parts = level.groupBy("node", "at").agg(F.sum("bytes").alias("bytes"), F.sum("tokens").alias("tokens"), F.sum("rows").alias("rows")).withColumn("parent", F.floor(F.col("node") / FAN_IN).cast("int"))
        packed = parts.groupBy("parent").applyInPandas(lambda p: _packed(p, ["node", "at"], shards), "node int, at int, bytes long, tokens long, rows long, parent int, bin int")
        up = packed.select("node", "at", "parent", F.col("bin").alias("up"))
        level = landed(level.join(up, ["node", "at"]).select("bucket", "bin", "bytes", "tokens", "rows", F.col("parent").alias("node"), F.col("up").alias("at")), "shard-bins")
        buckets = -(-buckets // FAN_IN)
        if buckets <= 1:
            return level.select("bucket", "bin", "rows", F.col("at").alias("shard"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards by the law `bytes`; nulls, repeats and empty tables as in `pack_shards`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = pack_shards(docs)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))
