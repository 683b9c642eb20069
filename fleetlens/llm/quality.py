"""Quality classifier: averaged hashed word and character n-gram vectors with a softmax output, trained by numpy SGD."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm.common import U64, SpanHash, chunks, mixed, utf8, word_spans

BITS = 17
CHAR_GRAMS = (3, 5)
DIMS = 8
FIT_ROWS = 6_000
EPOCHS = 12
RATE = 2.0
THRESHOLD = 0.7


def _grams(data: np.ndarray, width: int) -> np.ndarray:
    n = max(0, len(data) - width + 1)
    h = np.full(n, 0x9E3779B1 * width & 0xFFFFFFFF, np.uint32)
    for k in range(width):
        h = (h ^ data[k : k + n]) * np.uint32(0x01000193)
        h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA6B)
    return h >> np.uint32(32 - BITS)


def features(data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places, first place of each document and the end) for words, word pairs and each length of character n-grams.

    A pair of equal words is one and the same place, so that repetition is seen whatever the word. Character n-grams
    are of bytes and take in the spaces around words. None crosses a document's end."""
    start, end, doc = word_spans(data, offsets)
    n = len(offsets) - 1
    word = SpanHash(data, 5).spans(start, end) if len(start) else np.zeros(0, np.uint64)
    firsts = np.searchsorted(doc, np.arange(n + 1))
    shift = U64(64 - BITS)
    out = [(word >> shift, firsts)]
    same = doc[1:] == doc[:-1]
    pair = np.where(word[1:] == word[:-1], U64(1), mixed(word[1:] * U64(3) + word[:-1]))[same] >> shift
    out.append((pair, np.searchsorted(doc[1:][same], np.arange(n + 1))))
    for width in CHAR_GRAMS:
        at = _grams(data, width)
        keep = np.ones(len(at), bool)
        for k in range(1, width):
            cut = offsets[1:-1] - k
            keep[cut[(cut >= 0) & (cut < len(at))]] = False
        places = np.concatenate([[0], np.cumsum(keep)])
        out.append((at[keep], places[np.minimum(offsets, len(at))]))
    return out


def _sums(values: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[firsts[1:]] - total[firsts[:-1]]


def train(examples: list[tuple[list[tuple[np.ndarray, np.ndarray]], int]], seed: int = 7) -> np.ndarray:
    """SGD over (unique places and counts by feature kind, label); returns one logit contribution for each place.

    The document vector is the mean over feature kinds of the mean vector of its features; the output is a softmax over
    two classes. As the output is linear in the document vector, a place's vector and the output weights fold into
    the number that this place adds to the logit of label 1. The last entry is the bias."""
    rng = np.random.default_rng(seed)
    kinds = 2 + len(CHAR_GRAMS)
    vectors = (rng.standard_normal((kinds, 2**BITS, DIMS)) * 0.1 / DIMS).astype(np.float32)
    weights, bias = rng.standard_normal((2, DIMS)).astype(np.float32) * 0.5, np.zeros(2, np.float32)
    steps, step = max(1, EPOCHS * len(examples)), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(examples)):
            parts, label = examples[i]
            rate = np.float32(RATE * (1 - step / steps))
            step += 1
            h = np.zeros(DIMS, np.float32)
            for kind, (at, share) in enumerate(parts):
                if len(at):
                    h += share @ vectors[kind, at]
            h /= kinds
            z = weights @ h + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1
            back = weights.T @ p
            weights -= rate * 0.1 * np.outer(p, h)
            bias -= rate * np.float32(0.02) * p
            for kind, (at, share) in enumerate(parts):
                if len(at):
                    vectors[kind, at] -= (rate / kinds) * share[:, None] * back
    logits = (vectors @ (weights[1] - weights[0])).ravel() / kinds
    return np.append(logits, bias[1] - bias[0]).astype(np.float32)


def _example_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, offsets = utf8(b.column(1))
        labels = b.column(2).to_pylist()
        for i, j in chunks(offsets):
            kinds = features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            rows = []
            for d in range(j - i):
                parts = []
                for at, firsts in kinds:
                    place, n = np.unique(at[firsts[d] : firsts[d + 1]], return_counts=True)
                    parts.append({"at": place.astype(np.int32).tobytes(), "share": (n / max(1, n.sum())).astype(np.float32).tobytes()})
                rows.append(parts)
            yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(labels[i:j], pa.int32()), pa.array(rows, pa.list_(pa.struct([("at", pa.binary()), ("share", pa.binary())])))], ["id", "label", "parts"])


def fit(docs: DataFrame, labels: DataFrame, is_training: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", fit_rows: int = FIT_ROWS) -> np.ndarray:
    """Train on at most about ``fit_rows`` labelled documents, chosen by a hash of the id: one task, bounded by that number.

    Labels other than 0 and 1 are left out; without any example every score is 0.5. Whole texts are used."""
    known = labels.filter(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("label")).filter("id is not null")
    n = known.count()
    share = int(min(1.0, fit_rows / max(n, 1)) * 2**32)
    picked = known.filter(F.pmod(F.xxhash64("id", F.lit(23)), F.lit(2**32)) < share)
    rows = docs.filter(is_training).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(picked, "id")
    kind = "id long, label int, parts array<struct<at: binary, share: binary>>"

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable")
        held = [([(np.frombuffer(p["at"], np.int32), np.frombuffer(p["share"], np.float32)) for p in parts], int(label)) for label, parts in zip(pdf["label"], pdf["parts"], strict=True)]
        return pd.DataFrame({"model": [train(held).tobytes()]})

    got = rows.select(F.col("id").cast("long").alias("id"), "text", "label").mapInArrow(_example_rows, kind).groupBy(F.lit(0).alias("all")).applyInPandas(learn, "model binary").collect()
    return np.frombuffer(got[0]["model"], np.float32) if got else np.zeros((2 + len(CHAR_GRAMS)) * 2**BITS + 1, np.float32)


def scored(docs: DataFrame, model: np.ndarray, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Add score (the softmax probability of label 1) and predicted (1 if score >= threshold) to ``docs``.

    Null and empty texts have no features and get the score of the bias alone. Every row gets a row; columns named
    score or predicted are replaced. Long texts are read whole."""
    names = ["score", "predicted"]
    kept = [c for c in docs.columns if c not in names]
    tables, bias = model[:-1].reshape(-1, 2**BITS), float(model[-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = utf8(b.column(b.num_columns - 1))
            logit = np.full(b.num_rows, bias)
            for i, j in chunks(offsets):
                for table, (at, firsts) in zip(tables, features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]), strict=True):
                    logit[i:j] += _sums(table[at], firsts) / np.maximum(np.diff(firsts), 1)
            score = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(score), pa.array((score >= threshold).astype(np.int32))], [*b.schema.names[:-1], *names])

    given = docs.select(*kept, F.col(text_col).cast("string").alias("__text"))
    head = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in given.schema.fields[:-1])
    return given.mapInArrow(run, head + "score double, predicted int")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document; null and empty texts are scored too, see `scored`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4
    model = fit(docs, labels, fold != 2)
    out = scored(docs.select("doc_id", "text", (fold == 2).alias("held_out")), model)
    return out.select("doc_id", "held_out", "score", "predicted")
