"""Sets of global transaction ids: what a source has executed and a replica has not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gtid_intervals(text: Column) -> Column:
    """ARRAY of (uuid, lo, hi), both ends included, of a set as servers print it: 'uuid:1-5:7,uuid2:3'. White space does
    not count, letters of a uuid are lower-cased, parts that are no interval are left out; null gives an empty array."""

    def of_uuid(part: Column) -> Column:
        pieces = F.split(part, ":")

        def interval(piece: Column) -> Column:
            ends = F.split(piece, "-")
            lo = ends[0].try_cast("bigint")
            return F.struct(pieces[0].alias("uuid"), lo.alias("lo"), F.when(F.size(ends) > 1, F.get(ends, F.lit(1)).try_cast("bigint")).otherwise(lo).alias("hi"))

        return F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), interval)

    parts = F.split(F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", "")), ",")
    return F.filter(F.flatten(F.transform(parts, of_uuid)), lambda x: x["lo"].isNotNull() & x["hi"].isNotNull() & (x["lo"] <= x["hi"]) & (x["uuid"] != ""))


def gtid_gap(rows: DataFrame, key: list[str], source: str, replica: str) -> DataFrame:
    """(key, missing, gap): how many transactions the ``source`` set has that the ``replica`` set lacks, and which, as a set
    in canonical form ('' for none).

    The ends of all intervals of one uuid are swept in order with two running counts; where the source's is above 0 and
    the replica's is 0, transactions lack. Intervals may overlap and repeat; a row has its own sweep, so work is that of
    the intervals, however long they are. Rows of one key are one; a null key is a key."""
    sides = [rows.select(*key, F.explode(gtid_intervals(F.col(c))).alias("i"), F.lit(int(c == source)).alias("a"), F.lit(int(c == replica)).alias("b")) for c in (source, replica)]
    both = sides[0].unionByName(sides[1]).select(*key, "i.*", "a", "b")
    ends = both.select(*key, "uuid", F.col("lo").alias("at"), "a", "b").unionByName(both.select(*key, "uuid", (F.col("hi") + 1).alias("at"), (-F.col("a")).alias("a"), (-F.col("b")).alias("b")))
    ends = ends.groupBy(*key, "uuid", "at").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    swept = Window.partitionBy(*key, "uuid").orderBy("at")
    state = ends.select(*key, "uuid", "at", (F.sum("a").over(swept) > 0).alias("has"), (F.sum("b").over(swept) > 0).alias("had"), F.lead("at").over(swept).alias("next"))
    lacking = state.filter("has and not had").select(*key, "uuid", F.col("at").alias("lo"), F.col("next").alias("end"))
    starts = lacking.withColumn("n", F.sum(F.when(F.col("lo") == F.lag("end").over(Window.partitionBy(*key, "uuid").orderBy("lo")), 0).otherwise(1)).over(Window.partitionBy(*key, "uuid").orderBy("lo")))
    runs = starts.groupBy(*key, "uuid", "n").agg(F.min("lo").alias("lo"), (F.max("end") - 1).alias("hi"))
    text = F.when(F.col("lo") == F.col("hi"), F.col("lo").cast("string")).otherwise(F.concat_ws("-", "lo", "hi"))
    of_uuid = runs.groupBy(*key, "uuid").agg(F.sum(F.col("hi") - F.col("lo") + 1).alias("missing"), F.array_sort(F.collect_list(F.struct("lo", text.alias("t")))).alias("x"))
    of_uuid = of_uuid.withColumn("t", F.concat(F.col("uuid"), F.lit(":"), F.array_join(F.transform("x", lambda x: x["t"]), ":")))
    found = of_uuid.groupBy(*key).agg(F.sum("missing").alias("missing"), F.array_join(F.array_sort(F.collect_list("t")), ",").alias("gap"))
    every = rows.select(*key).distinct()
    same = [every[k].eqNullSafe(found[k]) for k in key]
    joined = every.join(found, same, "left").select(*(every[k] for k in key), "missing", "gap")
    return joined.withColumn("missing", F.coalesce("missing", F.lit(0).cast("long"))).withColumn("gap", F.coalesce("gap", F.lit("")))
