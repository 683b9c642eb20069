"""Benchmark decontamination by spaced seeds, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm.common import landed

WINDOW = 13
LEAST = 11
#: Word positions that a seed reads; between them every window of WINDOW words with LEAST equal ones holds a hit.
MASKS = ((0, 1, 2, 3, 5), (0, 1, 2, 4, 5))
SPAN = 6
SHORTEST = 5
BROADCAST_SEEDS = 500_000
WHITE = "[\\x20\\x09-\\x0D]+"


def words(text: Column) -> Column:
    """Lower-case words between white-space bytes; null and blank texts have none."""
    trimmed = F.btrim(F.lower(text), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, WHITE))


def once(column: Column) -> Column:
    """The column through a generator, so that expressions over it do not take in its making and repeat it."""
    return F.explode(F.array(column))


def _placed(rows: DataFrame, masks: list[tuple[int, ...]], *also: str) -> DataFrame:
    """(also, i, mask, seed): a hash of the words under each mask at each place where the mask fits.

    The hashes are made inside the array, so that what is exploded is numbers and never the words."""
    fits = lambda m: f"if(i + {m[-1]} < size(words), xxhash64({', '.join(f'words[i + {p}]' for p in m)}), null)"
    hashes = f"transform(sequence(0, size(words) - {min(m[-1] for m in masks) + 1}), i -> struct(i, {', '.join(f'{fits(m)} as h{n}' for n, m in enumerate(masks))}))"
    at = rows.filter(F.size("words") > min(m[-1] for m in masks)).select(*also, F.explode(F.expr(hashes)).alias("p"))
    by_mask = F.explode(F.array(*(F.struct(F.lit(n).alias("mask"), F.col(f"p.h{n}").alias("seed")) for n in range(len(masks)))))
    return at.select(*also, F.col("p.i").alias("i"), by_mask.alias("s")).select(*also, "i", "s.mask", "s.seed").filter("seed is not null")


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", broadcast_seeds: int = BROADCAST_SEEDS) -> DataFrame:
    """(id, item, matched): the documents that hold a passage of a benchmark item, with the best window's equal words.

    A passage is WINDOW aligned words of an item of which at least LEAST are equal in the document, so substituted words
    are tolerated; a shorter item must be there as a whole, and one of under SHORTEST words counts as no passage. Both
    sides are hashed under the masks, which ignore fixed positions; equal hashes are hits, and the words along a hit's
    diagonal are compared. Seeds and hits are broadcast up to ``broadcast_seeds`` rows and joined by shuffle beyond that.

    Null ids are left out; null and blank texts hold nothing and leak nothing. Repeated items and rows give the same answer once for each
    (id, item). Very long texts are scanned whole. Empty tables give no rows; other columns are ignored."""
    items = benchmark.select(F.col(item_col).alias("item"), words(F.col(item_text_col)).alias("words")).filter(F.size("words") >= SHORTEST)
    masks = list(MASKS)
    if items.filter(F.size("words") < SPAN).limit(1).count():
        masks.append(tuple(range(SHORTEST)))
    seeds = _placed(items, masks, "item").withColumnRenamed("i", "j")
    if seeds.count() <= broadcast_seeds:
        seeds = F.broadcast(seeds)
    held = docs.select(F.col(id_col).alias("id"), once(words(F.col(text_col))).alias("words"))
    found = _placed(held, masks, "id").join(seeds, ["mask", "seed"]).filter("id is not null")
    hits = landed(found.select("id", "item", (F.col("i") - F.col("j")).alias("diagonal")).distinct(), "hits")
    small = hits.count() <= broadcast_seeds
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text is not null")
    near = texts.join(F.broadcast(hits) if small else hits, "id").join(items.select("item", F.col("words").alias("item_words")), "item").select("id", "item", "item_words", "diagonal", once(words(F.col("text"))).alias("words"))
    equal = F.expr("transform(item_words, (w, m) -> coalesce(int(get(words, diagonal + m) = w), -100))")
    best = F.expr(f"array_max(transform(sequence(1, size(equal) - {WINDOW - 1}), s -> aggregate(slice(equal, s, {WINDOW}), 0, (a, x) -> a + x)))")
    whole = F.expr("if(forall(equal, x -> x = 1), size(item_words), 0)")
    checked = near.filter("words is not null").withColumn("equal", equal).withColumn("matched", F.when(F.size("item_words") >= WINDOW, best).otherwise(whole))
    enough = F.when(F.size("item_words") >= WINDOW, F.col("matched") >= LEAST).otherwise(F.col("matched") > 0)
    return checked.filter(enough).groupBy("id", "item").agg(F.max("matched").cast("int").alias("matched")).withColumnsRenamed({"id": id_col, "item": item_col})


def without_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose text holds no benchmark passage; rows with a null id are judged by their text too."""
    keyed = docs.withColumn("__key", F.xxhash64(F.col("text"), F.octet_length("text"), F.crc32(F.col("text").cast("binary"))))
    bad = leaks(keyed.select(F.col("__key").alias("key"), "text"), benchmark, "key").select(F.col("key").alias("__key")).distinct()
    return keyed.join(bad, "__key", "left_anti").select(*docs.columns)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with benchmark passages; nulls, repeats and empty tables as in the operator it applies."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))


ORACLE = r"""
WITH d AS (SELECT doc_id, string_split_regex(trim(lower(text), E' \t\n\x0b\x0c\r'), '[\x20\x09-\x0D]+') AS w FROM documents WHERE length(trim(text, E' \t\n\x0b\x0c\r')) > 0),
b AS (SELECT item_id, string_split_regex(trim(lower(text), E' \t\n\x0b\x0c\r'), '[\x20\x09-\x0D]+') AS w FROM benchmark WHERE length(trim(text, E' \t\n\x0b\x0c\r')) > 0),
dp AS (SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) AS i FROM d),
bp AS (SELECT item_id, len(w) AS n, unnest(w) AS t, generate_subscripts(w, 1) AS j FROM b),
dg AS (SELECT *, lead(t) OVER (PARTITION BY doc_id ORDER BY i) AS t2, lead(t, 2) OVER (PARTITION BY doc_id ORDER BY i) AS t3 FROM dp),
bg AS (SELECT *, lead(t) OVER (PARTITION BY item_id ORDER BY j) AS t2, lead(t, 2) OVER (PARTITION BY item_id ORDER BY j) AS t3 FROM bp),
near AS (SELECT DISTINCT doc_id, item_id, n, i - j AS diagonal FROM dg JOIN bg USING (t, t2, t3)),
eq AS (SELECT near.doc_id, near.item_id, n, diagonal, bp.j, CASE WHEN dp.t IS NULL THEN -100 WHEN dp.t = bp.t THEN 1 ELSE 0 END AS e
       FROM near JOIN bp USING (item_id, n) LEFT JOIN dp ON dp.doc_id = near.doc_id AND dp.i = bp.j + diagonal),
win AS (SELECT doc_id, item_id, n, j, sum(e) OVER (PARTITION BY doc_id, item_id, diagonal ORDER BY j ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS s,
               sum(e) OVER (PARTITION BY doc_id, item_id, diagonal) AS whole FROM eq)
SELECT doc_id, item_id, CAST(max(CASE WHEN n >= 13 THEN s ELSE n END) AS INTEGER) AS matched
FROM win WHERE (n >= 13 AND j >= 13 AND s >= 11) OR (n BETWEEN 5 AND 12 AND whole = n)
GROUP BY doc_id, item_id"""
