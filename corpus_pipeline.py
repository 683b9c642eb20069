"""From raw documents to token ids: language, near copies, repeated passages, benchmark leaks, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm.common import landed
from fleetlens.llm.decontaminate import without_leaks
from fleetlens.llm.jaccard import jaccard_components
from fleetlens.llm.langid import UNKNOWN, fit, labelled
from fleetlens.llm.sentencepiece_fst import encoded, model_bytes
from fleetlens.llm.suffix_dedup import PASSAGE_WORDS, WORD, without_repeats

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
LEAST_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; ``lang`` becomes the predicted one. Null texts, texts without letters and texts of
    which no language has LEAST_SCORE of the letters go. A row counts by its text alone: equal texts have one fate, null
    and repeated ids are rows like any other, an empty table gives an empty table."""
    model = fit(docs, F.lit(True))
    found = labelled(docs.select(*COLUMNS), model, with_spans=False)
    return found.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SCORE)).withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group of near copies (five-word shingles, Jaccard similarity of 0.8 or more).

    Groups are of rows, each known by a 64-bit hash of its columns, so null and repeated ids are no matter: a null id
    comes after all others, and of rows that are alike in every column one stays. Texts without words stay. An empty
    table gives an empty table."""
    rows = docs.select(*COLUMNS).withColumn("__row", F.xxhash64(*COLUMNS))
    groups = landed(jaccard_components(rows, 5, 80, id_col="__row"), "groups").select("__row", "component_id").distinct()
    ids = landed(rows.groupBy("__row").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")), "rows")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "__row")
    stay = landed(groups.join(ids, "__row").groupBy("component_id").agg(F.min(F.struct(order.alias("o"), "n")).alias("s")).select("s.o.__row", "s.n"), "stay")
    kept = rows.join(stay.select("__row"), "__row", "left_semi")
    if stay.filter("n > 1").limit(1).count():  # rows alike in every column
        kept = kept.dropDuplicates(["__row"])
    return kept.select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of over 50 words that occur more than once; a document that was nothing else goes.
    Equal texts lose what they share, so both go; ids are not looked at; an empty table gives an empty table."""
    found = without_repeats(docs.select(*COLUMNS), PASSAGE_WORDS, WORD)
    left = found.filter((F.col("n_removed") == 0) | (F.length(F.trim("kept_text")) > 0))
    return left.select("doc_id", F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text")).alias("text"), "lang", "source", "n_removed", "n_chars").withColumn(
        "n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    ).select(*COLUMNS)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage. Equal texts have one fate; null and repeated ids are rows like any other;
    without documents or without benchmark items nothing goes."""
    return without_leaks(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every document that is left."""
    return encoded(docs.select("doc_id", "text", "lang", "source"), model_bytes(spark)).select("doc_id", "lang", "source", "n_tokens", "token_ids")


STAGES = [
    ("language identification", language),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("benchmark decontamination", benchmark_leaks),
    ("SentencePiece encoding", tokens),
]

#: Language identification and tokens are not for SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each landed as Parquet before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = landed(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
