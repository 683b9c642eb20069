"""Language labels for whole texts: scripts narrow the candidates, Viterbi with a switching penalty labels word spans."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm.common import chunks, short_batches, unburdened, utf8

BITS = 16
GRAMS = (2, 4)
SWITCH_PENALTY = 12.0
FIT_ROWS = 40_000
SCORED_BYTES = 256_000
LABELLED_BYTES = 1_500_000
UNKNOWN = "und"
BARRED = -30.0

#: Scripts by the first byte of a UTF-8 letter (letters of other first bytes are of script "other").
SCRIPTS = ("none", "latin", "greek", "cyrillic", "armenian_hebrew", "arabic", "indic_thai", "other", "kana", "han", "hangul")
SCRIPT_OF = np.full(256, SCRIPTS.index("other"), np.uint8)
for first, last, script in ((0x41, 0x5A, 1), (0x61, 0x7A, 1), (0xC2, 0xCA, 1), (0xCD, 0xCF, 2), (0xD0, 0xD4, 3), (0xD5, 0xD7, 4), (0xD8, 0xDD, 5), (0xE0, 0xE0, 6), (0xE3, 0xE3, 8), (0xE4, 0xE9, 9), (0xEA, 0xED, 10), (0xF0, 0xF0, 9)):
    SCRIPT_OF[first : last + 1] = script

CODE_POINTS = 0x32400  # no letter lies beyond
MARK, LETTER = 1, 2

_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[:128] = 32
_PLAIN[97:123] = np.arange(97, 123)
_PLAIN[65:91] = np.arange(97, 123)


@cache
def _characters() -> tuple[np.ndarray, np.ndarray]:
    """(LETTER, MARK or 0 by code point; the lower case of each code point of two bytes)."""
    kinds = np.zeros(CODE_POINTS + 1, np.uint8)
    kinds[:CODE_POINTS] = [{"L": LETTER, "M": MARK}.get(unicodedata.category(chr(c))[0], 0) for c in range(CODE_POINTS)]
    lower = np.arange(0x800)
    for c in range(0x80, 0x800):
        low = chr(c).lower()
        if len(low) == 1 and 0x80 <= ord(low) < 0x800:
            lower[c] = ord(low)
    return kinds, lower


def letters(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lower-case text in which every byte of what is neither a letter nor a mark is a space, each letter's script at
    its first byte and 0 elsewhere) of UTF-8 bytes that start and end between characters."""
    kinds, lower = _characters()
    text = _PLAIN[data]
    scripts = ((text != 32) & (data < 0x80)).astype(np.uint8)
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        first = data[lead]
        size = 2 + (first >= 0xE0) + (first >= 0xF0)
        point = (first & (0x7F >> size)).astype(np.int64)
        for k in (1, 2, 3):
            longer = size > k
            point[longer] = point[longer] << 6 | data[np.minimum(lead[longer] + k, len(data) - 1)] & 0x3F
        kind = kinds[np.minimum(point, CODE_POINTS)]
        for k in range(4):
            at = lead[(kind == 0) & (size > k)] + k
            text[at[at < len(text)]] = 32
        scripts[lead[kind == LETTER]] = SCRIPT_OF[first[kind == LETTER]]
        two = (size == 2) & (kind > 0) & (lead + 1 < len(data))
        low = lower[point[two]]
        text[lead[two]], text[lead[two] + 1] = 0xC0 | low >> 6, 0x80 | low & 0x3F
    return text, scripts


def gram_ids(data: np.ndarray, width: int, bits: int = BITS) -> np.ndarray:
    """A table place for the n-gram that starts at each byte; the last width - 1 bytes have none."""
    n = max(0, len(data) - width + 1)
    h = np.full(n, 0x9E3779B1 * width & 0xFFFFFFFF, np.uint32)
    for k in range(width):
        h = (h ^ data[k : k + n]) * np.uint32(0x01000193)
        h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA6B)
    return h >> np.uint32(32 - bits)


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of the runs of letters in plain bytes."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    word = data != 32
    begins, ends = word.copy(), word.copy()
    begins[1:] &= ~word[:-1]
    ends[:-1] &= ~word[1:]
    inner = offsets[1:-1][(offsets[1:-1] < len(data)) & (offsets[1:-1] > 0)]
    begins[inner] = word[inner]
    ends[inner - 1] = word[inner - 1]
    start = np.flatnonzero(begins)
    return start, np.flatnonzero(ends) + 1, np.searchsorted(offsets, start, "right") - 1


def word_scores(data: np.ndarray, offsets: np.ndarray, model: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(scores by word and language, document, letters' bytes): log odds of a word's n-grams, with its two borders,
    for the languages that write the word's script (for all, if none does); words without letters are left out."""
    text, scripts = letters(data)
    start, end, doc = words_of(text, offsets)
    first = np.zeros(len(start), np.uint8)
    if len(start):
        first = np.maximum.reduceat(scripts, np.stack([start, np.minimum(end, len(text) - 1)], 1).ravel())[::2]
        tail = end == len(text)  # reduceat's last range is open
        first[tail] = [scripts[s:].max() for s in start[tail]]
    keep = first > 0
    start, end, doc, first = start[keep], end[keep], doc[keep], first[keep]
    k = len(model["langs"])
    scores = np.zeros((len(start), k), np.float32)
    for width, table in zip(GRAMS, model["tables"], strict=True):
        at = gram_ids(text, width)
        sums = np.zeros((len(at) + 1, k), np.float32 if len(at) < 1000 else np.float64)
        np.cumsum(table[at], axis=0, out=sums[1:], dtype=sums.dtype)
        low = np.maximum(start - 1, offsets[doc])
        high = np.minimum(end + 1, offsets[doc + 1]) - width + 1
        low, high = np.minimum(low, len(at)), np.clip(high, 0, len(at))
        scores += np.where((high > low)[:, None], sums[np.maximum(high, low)] - sums[low], 0)
    scores += np.where(model["writes"][first], 0, BARRED).astype(np.float32)
    return scores, doc, (end - start)


def pieces(data: np.ndarray, offsets: np.ndarray, limit: int = SCORED_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(bytes, offsets, first document) in pieces of about ``limit`` bytes. A longer text comes in several, cut at
    an ASCII byte that is no letter and that both sides keep, so that its words and their borders are the same; a run of
    over ``limit`` bytes without one is cut between characters."""
    for i, j in chunks(offsets, limit):
        at, to = int(offsets[i]), int(offsets[j])
        if j > i + 1 or to - at <= limit:
            yield data[at:to], offsets[i : j + 1] - at, i
            continue
        while at < to:
            end = min(to, at + limit)
            if end < to:
                space = np.flatnonzero(_PLAIN[data[at + 1 : end]] == 32)
                if len(space):
                    end = at + 2 + int(space[-1])
                while data[end] & 0xC0 == 0x80 and end > at + 1:
                    end -= 1
            yield data[at:end], np.array([0, end - at]), i
            at = end - 1 if end < to and _PLAIN[data[end - 1]] == 32 and end - 1 > at else end


def viterbi(scores: np.ndarray, counts: np.ndarray, penalty: float) -> np.ndarray:
    """The best label of each word, documents one after another with ``counts`` words; a change of label costs ``penalty``.

    All documents advance by one word at a time, longest first, so that the step is over arrays."""
    n, k = scores.shape
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64)
    order = np.argsort(-counts, kind="stable")
    starts, lengths = starts[order], counts[order]
    back = np.zeros((n, k), np.uint8)
    states = np.arange(k, dtype=np.uint8)
    value = np.zeros((len(starts), k), np.float32)
    steps = int(lengths[0]) if len(lengths) else 0
    active = np.searchsorted(-lengths, -np.arange(steps), "left")
    for t in range(steps):
        m = active[t]
        at = starts[:m] + t
        v = value[:m]
        if t:
            best = v.argmax(axis=1)
            top = v[np.arange(m), best][:, None] - np.float32(penalty)
            moved = v < top
            back[at] = np.where(moved, best[:, None].astype(np.uint8), states)
            v = np.maximum(v, top) - top
        value[:m] = v + scores[at]
    labels = np.zeros(n, np.uint8)
    state = value.argmax(axis=1)
    for t in range(steps - 1, -1, -1):
        m = active[t]
        at = starts[:m] + t
        labels[at] = state[:m]
        state[:m] = back[at, state[:m]]
    return labels


def fit(docs: DataFrame, is_training: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fit_rows: int = FIT_ROWS) -> dict:
    """Language n-gram tables from at most about ``fit_rows`` labelled rows, chosen by a hash of the id.

    Counting is by task and summed by (language, slice of the table); the driver gets the tables, whose size is
    languages * 2**BITS * len(GRAMS) whatever the input."""
    short_batches(docs.sparkSession)
    rows = docs.filter(is_training & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    n = rows.count()
    share = int(min(1.0, fit_rows / max(n, 1)) * 2**32)
    rows = rows.filter(F.pmod(F.xxhash64(F.col(id_col), F.lit(11)), F.lit(2**32)) < share).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    width = len(GRAMS) * 2**BITS + 256

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            data, offsets = utf8(b.column(1))
            langs = np.array(b.column(0).to_pylist(), object)
            for part, own, i in pieces(data, offsets):
                text, scripts = letters(part)
                here = langs[i : i + len(own) - 1]
                for lang in set(here):
                    held = total.setdefault(lang, np.zeros(width, np.int64))
                    mask = np.repeat(here == lang, np.diff(own))
                    for g, w in enumerate(GRAMS):
                        at = gram_ids(text, w)
                        held[g * 2**BITS : (g + 1) * 2**BITS] += np.bincount(at[mask[: len(at)]], minlength=2**BITS)
                    held[-256:] += np.bincount(scripts[mask], minlength=256)
        for lang, held in total.items():
            at = np.flatnonzero(held)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(at), pa.string()), "at": at, "n": held[at]})

    got = rows.mapInArrow(unburdened(count), "lang string, at long, n long").groupBy("lang", "at").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(got["lang"].unique())
    counts = np.zeros((len(langs), width))
    if len(langs):
        counts[[langs.index(x) for x in got["lang"]], got["at"]] = got["n"]
    tables = []
    for g in range(len(GRAMS)):
        part = counts[:, g * 2**BITS : (g + 1) * 2**BITS] + 0.5
        logs = np.log(part / part.sum(axis=1, keepdims=True)) if len(langs) else part
        tables.append(np.ascontiguousarray((logs - logs.mean(axis=0, keepdims=True)).T.astype(np.float32)) if len(langs) else np.zeros((2**BITS, 0), np.float32))
    scripts = counts[:, -256:]
    writes = (scripts / np.maximum(scripts[:, 1:].sum(axis=1, keepdims=True), 1) >= 0.005).T if len(langs) else np.zeros((256, 0), bool)
    writes[~writes.any(axis=1)] = True
    return {"langs": langs, "tables": tables, "writes": writes}


def _labels(data: np.ndarray, offsets: np.ndarray, model: dict, penalty: float, with_spans: bool) -> tuple[list[str], np.ndarray, list[list[dict]]]:
    """(language, score, spans) of each text."""
    langs, n = model["langs"], len(offsets) - 1
    spans: list[list[dict]] = [[] for _ in range(n)]
    k = len(langs)
    if not k:
        return [UNKNOWN] * n, np.zeros(n), spans
    parts = [(np.zeros((0, k), np.float32), np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for part, own, i in pieces(data, offsets):
        s, d, size = word_scores(part, own, model)
        parts.append((s, d + i, size))
    s, d, size = (np.concatenate([p[x] for p in parts]) for x in range(3))
    label = viterbi(s, np.bincount(d, minlength=n), penalty)
    weight = np.bincount(d * k + label, weights=size, minlength=n * k).reshape(n, k)
    best, whole = weight.argmax(axis=1), weight.sum(axis=1)
    score = np.where(whole > 0, weight[np.arange(n), best] / np.maximum(whole, 1), 0.0)
    if with_spans and len(d):
        new = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (label[1:] != label[:-1])]))
        words, sizes = np.diff(np.append(new, len(d))), np.add.reduceat(size, new)
        for at, lang, w, z in zip(d[new].tolist(), label[new].tolist(), words.tolist(), sizes.tolist(), strict=True):
            spans[at].append({"lang": langs[lang], "words": w, "bytes": z})
    return [langs[p] if w else UNKNOWN for p, w in zip(best.tolist(), whole.tolist(), strict=True)], score, spans


def labelled(docs: DataFrame, model: dict, text_col: str = "text", penalty: float = SWITCH_PENALTY, with_spans: bool = True) -> DataFrame:
    """Add lang_pred, score and (``with_spans``) lang_spans to ``docs``.

    ``lang_spans`` lists (lang, words, bytes) of each span in order; ``lang_pred`` is the language with the most
    letters' bytes over all spans (ties: first by name) and ``score`` its share of them, 0 to 1. Null and empty texts,
    and texts without a letter (digits, marks and symbols of any script are none), give 'und', 0.0 and no spans; so
    does everything if the model has no language. Every row gets a row, repeated rows the same; columns of these names
    are replaced; an empty table gives no rows. Very long texts are scored in pieces but labelled whole."""
    short_batches(docs.sparkSession)
    names = ["lang_pred", "score", *(["lang_spans"] if with_spans else [])]
    kept = [c for c in docs.columns if c not in names]
    kind = pa.list_(pa.struct([("lang", pa.string()), ("words", pa.int64()), ("bytes", pa.int64())]))
    given = docs.select(*kept)
    if text_col not in kept or docs.schema[text_col].dataType.simpleString() != "string":
        given = docs.select(*kept, F.col(text_col).cast("string").alias("__text"))
    place = given.columns.index("__text" if len(given.columns) > len(kept) else text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = utf8(b.column(place))
            for i, j in chunks(offsets, LABELLED_BYTES):
                pred, score, spans = _labels(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], model, penalty, with_spans)
                made = [pa.array(pred, pa.string()), pa.array(score, pa.float64()), *([pa.array(spans, kind)] if with_spans else [])]
                yield pa.RecordBatch.from_arrays([*(c.slice(i, j - i) for c in b.columns[: len(kept)]), *made], [*b.schema.names[: len(kept)], *names])

    head = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in given.schema.fields[: len(kept)])
    return given.mapInArrow(unburdened(run), head + "lang_pred string, score double" + (", lang_spans array<struct<lang: string, words: long, bytes: long>>" if with_spans else ""))


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document. Null ids count as '' for the fold and null texts are 'und'; see `labelled`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5
    model = fit(docs, fold != 0)
    out = labelled(docs.select("doc_id", "text", (fold == 0).alias("held_out")), model)
    return out.select("doc_id", "held_out", "lang_pred", "score", F.size("lang_spans").alias("n_spans"))
