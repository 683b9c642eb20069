"""Filter interaction audit: what each of several filters removes, alone and in every order of them."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm.common import landed

#: The filters by letter; the bit of a filter is its place here.
FILTERS = "ABCDE"
LEAST_WORDS = 200
LEAST_DISTINCT_PERCENT = 50
MOST_CAPITALS_PERCENT = 3
SPACES = r"[\x20\x09-\x0D]+"


def own_failures(text: Column) -> Column:
    """Bits of the filters that look at one text alone: few words (A), repetitive (B), shouting (C), markup (D)."""
    words = F.filter(F.split(text, SPACES), lambda w: w != "")
    n, capitals = F.size(words), F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    fails = [
        n < LEAST_WORDS,
        100 * F.size(F.array_distinct(words)).cast("long") < LEAST_DISTINCT_PERCENT * n.cast("long"),
        100 * capitals.cast("long") > MOST_CAPITALS_PERCENT * F.length(text).cast("long"),
        text.rlike(r"[#$%&*|]"),
    ]
    bits = F.lit(0)
    for i, fail in enumerate(fails):
        bits = bits.bitwiseOR(F.when(fail, 1 << i).otherwise(0))
    return bits


def later_copies(rows: DataFrame) -> DataFrame:
    """(doc_id, hash, part) of the rows of (doc_id, hash, text, part) whose text a row of smaller doc_id has too: a left
    semi join on hash, exact text and smaller doc_id.

    Only the smallest doc_id of a repeated text can decide. Texts are told apart in full where they are counted, once
    and after they are added up in each task; where a hash stands for one text, which it nearly always does, the join
    needs no text any more, so rows of a hot text are a few bytes that Spark may split. Where it stands for several,
    the join compares them. A null doc_id is smaller than none."""
    texts = landed(rows.groupBy("hash", "text").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).select("hash", "first", "n"), "distinct-texts")
    by_hash = texts.groupBy("hash").agg(F.count("*").alias("texts"), F.min("first").alias("__first"), F.sum("n").alias("n")).withColumnRenamed("hash", "__hash")
    first = landed(by_hash.filter("n > 1").drop("n"), "first-copies")
    same, before = F.col("hash") == F.col("__hash"), F.col("__first") < F.col("doc_id")
    alone = rows.select("doc_id", "hash", "part").join(first.filter("texts = 1"), same & before, "left_semi")
    shared = first.filter("texts > 1").select("__hash")
    if not shared.limit(1).count():
        return alone
    met = rows.join(shared, same, "left_semi")
    least = landed(met.groupBy(F.col("hash").alias("__hash"), F.col("text").alias("__text")).agg(F.min("doc_id").alias("__first")), "first-copies")
    return alone.unionByName(met.join(least, same & (F.col("text") == F.col("__text")) & before, "left_semi").select("doc_id", "hash", "part"))


def failure_combinations(docs: DataFrame, labels: DataFrame, part_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(part, failures, good, toxic, n): documents by part, the bits of all filters they fail and their labels.

    Every row of ``docs`` is a document. Null texts are empty, null parts the empty string; rows of one id, text and
    part have the same failures and count as often as they come. A document is good or toxic if any of the labels of
    its id says so; null ids have no label. An empty table gives no row; other columns of any name are not read."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(F.col(part_col), F.lit("")).alias("part")).withColumn("hash", F.xxhash64("text"))
    own = rows.select("doc_id", "hash", "part", own_failures(F.col("text")).alias("failures"), F.lit(1).cast("long").alias("n"))
    copies = later_copies(rows).select("doc_id", "hash", "part", F.lit(1 << FILTERS.index("E")).alias("failures"), F.lit(0).cast("long").alias("n"))
    of_row = own.unionByName(copies).groupBy("doc_id", "hash", "part").agg(F.bit_or("failures").alias("failures"), F.sum("n").alias("n"))
    of_id = of_row.groupBy("doc_id", "part", "failures").agg(F.sum("n").alias("n"))
    marks = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(*(F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(to) for c, to in (("quality", "good"), ("toxic", "toxic"))))
    return (
        of_id.join(marks, "doc_id", "left")
        .groupBy("part", "failures", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
        .agg(F.sum("n").alias("n"))
    )


def order_report(combinations: DataFrame) -> DataFrame:
    """One row for each part, order of the filters and step in it, from the counts of failure combinations.

    kept, removed: documents after and by the step. redundant: documents that fail its filter and were gone before.
    unique_fails: those that fail no other filter. shapley: what its filter removes over all orders; each of the k
    filters that a document fails is first among them in a k-th of the orders."""
    orders = ["".join(p) for p in permutations(FILTERS)]
    steps = combinations.withColumn("filter_order", F.explode(F.array(*map(F.lit, orders)))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    before, own = F.lit(0), F.lit(0)
    for i, letter in enumerate(FILTERS):
        at = F.instr("filter_order", letter)
        before = before + F.when(at < F.col("step"), 1 << i).otherwise(0)
        own = own + F.when(at == F.col("step"), 1 << i).otherwise(0)
    steps = steps.withColumn("gone", F.col("failures").bitwiseAND(before) != 0).withColumn("own", own).withColumn("fails", F.col("failures").bitwiseAND(F.col("own")) != 0)
    removed = F.col("fails") & ~F.col("gone")

    def total(condition: Column, name: str, weight: Column | None = None) -> Column:
        return F.sum(F.when(condition, F.col("n") if weight is None else weight).otherwise(0)).cast("long").alias(name)

    return steps.groupBy("part", "filter_order", "step").agg(
        total(~F.col("fails") & ~F.col("gone"), "kept"),
        total(removed, "removed"),
        total(F.col("fails") & F.col("gone"), "redundant"),
        total(F.col("failures") == F.col("own"), "unique_fails"),
        total(removed & F.col("good"), "good_lost"),
        total(removed & F.col("toxic"), "toxic_lost"),
        total(F.col("fails"), "shapley", F.col("n") * F.expr(f"{len(orders)} div bit_count(failures)")),
    )


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the five filters remove of all documents by lang, in all 120 orders."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic")
    return order_report(landed(failure_combinations(docs, labels), "failures"))


#: The failures of each document straight from the definitions, and the orders as joins of letters.
ORACLE = r"""
    WITH d AS (
        SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
            list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
        FROM documents
    ), f AS (
        SELECT doc_id, part,
            len(words) < 200 AS a,
            100 * len(list_distinct(words)) < 50 * len(words) AS b,
            100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 3 * length(text) AS c,
            regexp_matches(text, '[#$%&*|]') AS d,
            coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS e
        FROM d
    ), m AS (
        SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id
    ), g AS (
        SELECT part, a, b, c, d, e, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, count(*) AS n
        FROM f LEFT JOIN m USING (doc_id) GROUP BY ALL
    ), l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x), o AS (
        SELECT v.x || w.x || x.x || y.x || z.x AS filter_order
        FROM l v, l w, l x, l y, l z
        WHERE len(list_distinct([v.x, w.x, x.x, y.x, z.x])) = 5
    ), s AS (
        SELECT part, filter_order, CAST(step AS INTEGER) AS step, n, good, toxic,
            CAST(a AS INTEGER) + CAST(b AS INTEGER) + CAST(c AS INTEGER) + CAST(d AS INTEGER) + CAST(e AS INTEGER) AS fails,
            list_transform(range(1, 6), lambda i: CASE substr(filter_order, i, 1) WHEN 'A' THEN a WHEN 'B' THEN b WHEN 'C' THEN c WHEN 'D' THEN d ELSE e END) AS hit
        FROM g, o, range(1, 6) AS r(step)
    ), t AS (
        SELECT *, hit[step] AS own, len(list_filter(hit[1:step - 1], lambda h: h)) > 0 AS gone FROM s
    ), u AS (
        SELECT part, filter_order, step,
            CAST(sum(CASE WHEN NOT own AND NOT gone THEN n ELSE 0 END) AS BIGINT) AS kept,
            CAST(sum(CASE WHEN own AND NOT gone THEN n ELSE 0 END) AS BIGINT) AS removed,
            CAST(sum(CASE WHEN own AND gone THEN n ELSE 0 END) AS BIGINT) AS redundant,
            CAST(sum(CASE WHEN own AND fails = 1 THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
            CAST(sum(CASE WHEN own AND NOT gone AND good THEN n ELSE 0 END) AS BIGINT) AS good_lost,
            CAST(sum(CASE WHEN own AND NOT gone AND toxic THEN n ELSE 0 END) AS BIGINT) AS toxic_lost
        FROM t GROUP BY part, filter_order, step
    )
    SELECT *, CAST(sum(removed) OVER (PARTITION BY part, substr(filter_order, step, 1)) AS BIGINT) AS shapley FROM u"""
