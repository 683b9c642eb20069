"""Cross-tokenizer alignment: which tokens of two tokenizers stand for the same bytes, text by text and corpus-wide."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm.common import chunks, landed, short_batches
from fleetlens.llm.sentencepiece_fst import MODEL, SPACE, model_bytes

VOCABULARY = os.environ.get("FLEETLENS_BYTE_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.json")
#: A space between two characters that are none: both tokenizers cut before it, whatever stands around.
CUT = re.compile(r" (?=\S)(?<=\S )")
#: Links that are expanded at once, and what a worker remembers of words (in links and characters).
EXPANDED = 2_000_000
REMEMBERED = 5_000_000
#: The share of that which the first words may hold for good.
FIRST = 0.6
#: Pairs of at least this share of all links (by document) are looked up in a table of at most so many rows.
FREQUENT = 2**17


class ByteLevel:
    """A byte-level tokenizer of the ``tokenizers`` library; the strings of special tokens are plain text to it."""

    def __init__(self, data: bytes):
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_buffer(data)
        self.own.encode_special_tokens = True
        spec = json.loads(data)
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        self.byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
        self.tokens = [b""] * self.own.get_vocab_size()
        for token, i in self.own.get_vocab().items():
            self.tokens[i] = bytes(map(self.byte_of.__getitem__, token)) if all(c in self.byte_of for c in token) else token.encode()
        before = spec.get("pre_tokenizer") or {}
        self.cuts_at_words = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not spec.get("normalizer")

    def encode(self, text: str) -> list[int]:
        """The ids of a text that has its leading space already."""
        return self.own.encode_batch_fast([text], add_special_tokens=False)[0].ids


class Pieces:
    """A SentencePiece model, which puts the leading space in front by itself."""

    def __init__(self, data: bytes):
        from sentencepiece import SentencePieceProcessor

        self.own = SentencePieceProcessor(model_proto=data)
        n = self.own.get_piece_size()
        pieces = [self.own.id_to_piece(i) for i in range(n)]
        self.tokens = [bytes([int(p[3:5], 16)]) if self.own.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.cuts_at_words = not any(SPACE in p.lstrip(SPACE) for p in pieces)

    def encode(self, text: str) -> list[int]:
        return self.own.encode(text[1:], num_threads=1)


def _ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (length[0] of them), start[1], ..."""
    before = np.cumsum(length) - length
    return np.arange(int(length.sum())) + np.repeat(start - before, length)


def _byte_ends(words: list[str]) -> np.ndarray:
    """Where each word ends in the UTF-8 bytes of the joined words."""
    raw = np.frombuffer("".join(words).encode(), np.uint8)
    starts = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
    return starts[np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))]


def _merged(place: np.ndarray, pair: np.ndarray, links: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal (place, pair) rows added up, in their order."""
    if not len(place):
        return place, pair, links
    if place.max() < 2**31 and pair.max() < 2**32:
        order = np.argsort(place * 2**32 + pair)
    else:
        order = np.lexsort((pair, place))
    place, pair, links = place[order], pair[order], links[order]
    first = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (pair[1:] != pair[:-1])])
    return place[first], pair[first], np.add.reduceat(links, first)


class Aligner:
    """Both tokenizers, and what words of theirs align to.

    Where both cut before a space between two other characters, a text is the row of its words, each encoded and
    aligned once for as long as it is remembered; else the whole text is one word. Tables by word: numbers of tokens,
    groups and links, the written groups, and the distinct id pairs (a * width + b) with their links."""

    def __init__(self, a: bytes, b: bytes):
        self.a, self.b = ByteLevel(a), Pieces(b)
        self.width = len(self.b.tokens)
        self.size_a, self.size_b = (np.array([len(t) for t in x.tokens], np.int64) for x in (self.a, self.b))
        written = [[str(i).encode() for i in range(len(x.tokens))] for x in (self.a, self.b)]
        # what follows an id: a comma inside a side, else the mark of the side's end
        self.written = [w + s for side, end in zip(written, (b"|", b";"), strict=True) for s in (b",", end) for w in side]
        self.size_written = np.array([len(w) for w in self.written], np.int64)
        self.by_words = self.a.cuts_at_words and self.b.cuts_at_words
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.counts = np.zeros((0, 5), np.int64)  # valid, tokens of A and B, groups, links
        self.groups: list[bytes] = []
        self.from_pair = np.zeros(1, np.int64)
        self.pair = self.links = np.zeros(0, np.int64)
        self.held = 0
        self.first: tuple[int, int] | None = None  # how many words stay when memory is full, and what they hold

    def _forget_late(self) -> None:
        """Forget all but the first words, which have the frequent ones."""
        if self.first is None:
            self._forget()
            return
        n, self.held = self.first
        self.known = dict(islice(self.known.items(), n))
        self.groups = self.groups[:n]
        self.counts, self.from_pair = self.counts[:n].copy(), self.from_pair[: n + 1].copy()
        self.pair, self.links = self.pair[: self.from_pair[n]].copy(), self.links[: self.from_pair[n]].copy()

    def words(self, text: str) -> list[str]:
        """The words of space + text, each with its leading space."""
        return [" " + w for w in CUT.split(text)] if self.by_words else [" " + text]

    def _encoded(self, words: list[str]) -> tuple[list[int], list[int]] | None:
        """Ids of the joined words by both, or None where their bytes are not those of the words."""
        text = "".join(words)
        a, b = self.a.encode(text), self.b.encode(text)
        raw = text.encode()
        if any(b"".join(map(x.tokens.__getitem__, ids)) != raw for x, ids in ((self.a, a), (self.b, b))):
            return None
        return a, b

    def learn(self, words: list[str]) -> None:
        """Encode and align new words: plain ones in one go, as neither tokenizer joins them, the others one by one."""
        plain, others = [], []
        for w in words:
            (plain if self.by_words and (rest := w[1:]).strip() == rest != "" and SPACE not in w else others).append(w)
        got = self._encoded(plain) if plain else None
        if got:
            self._add(plain, *got)
        for w in words if got is None else others:
            self._add([w], *(self._encoded([w]) or ((), ())))

    def _add(self, words: list[str], a: list[int], b: list[int]) -> None:
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        n = len(words)
        for w in words:
            self.known[w] = len(self.known)
        if not len(a):  # not the text's bytes
            self.counts = np.concatenate([self.counts, np.zeros((n, 5), np.int64)])
            self.groups += [b""] * n
            self.from_pair = np.concatenate([self.from_pair, np.repeat(self.from_pair[-1:], n)])
            self.held += sum(map(len, words)) + 50 * n
            return
        end_a, end_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        ends = np.zeros(end_a[-1] + 1, np.int8)  # both end with the words
        ends[end_a] += 1
        ends[end_b] += 1
        common = np.flatnonzero(ends == 2)
        before = np.cumsum(ends == 2) - (ends == 2)
        group_a, group_b = before[end_a], before[end_b]
        in_a, in_b = np.bincount(group_a, minlength=len(common)), np.bincount(group_b, minlength=len(common))
        word_ends = _byte_ends(words)
        of_group = np.searchsorted(word_ends, common)
        count = lambda weights: np.bincount(of_group, weights, n).astype(np.int64)
        self.counts = np.concatenate([self.counts, np.stack([np.ones(n, np.int64), count(in_a), count(in_b), count(None), count(in_a * in_b)], axis=1)])
        # written groups: the tokens of A and then of B of each group, with the mark behind each
        at_a = np.arange(len(a)) + (np.cumsum(in_b) - in_b)[group_a]
        at_b = np.arange(len(b)) + np.cumsum(in_a)[group_b]
        row = np.empty(len(a) + len(b), np.int64)
        last_a, last_b = np.append(group_a[1:] != group_a[:-1], True), np.append(group_b[1:] != group_b[:-1], True)
        row[at_a] = a + last_a * len(self.a.tokens)
        row[at_b] = b + 2 * len(self.a.tokens) + last_b * len(self.b.tokens)
        tokens_of_word = count(in_a) + count(in_b)
        written = b"".join(map(self.written.__getitem__, row.tolist()))
        to = np.cumsum(self.size_written[row])[np.cumsum(tokens_of_word) - 1].tolist()
        self.groups += [written[i:j] for i, j in zip([0, *to], to, strict=False)]
        word, pair, links = self._pairs(a, b, in_a, in_b, of_group)
        self.from_pair = np.concatenate([self.from_pair, self.from_pair[-1] + np.searchsorted(word, np.arange(1, n + 1))])
        self.pair, self.links = np.concatenate([self.pair, pair]), np.concatenate([self.links, links])
        self.held += len(pair) * 2 + sum(map(len, words)) + 50 * n

    def _pairs(self, a: np.ndarray, b: np.ndarray, in_a: np.ndarray, in_b: np.ndarray, of_group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, pair, links) of all groups, expanded some groups at a time; one of very many links by its distinct ids."""
        first_a, first_b, links = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b, in_a * in_b
        parts = []
        for g, to in chunks(np.concatenate([[0], np.cumsum(links)]), EXPANDED):
            if links[g] > EXPANDED:
                (ua, ca), (ub, cb) = (np.unique(x[f[g] : f[g] + k[g]], return_counts=True) for x, f, k in ((a, first_a, in_a), (b, first_b, in_b)))
                pair, n = (ua[:, None] * self.width + ub).ravel(), (ca[:, None] * cb).ravel()
                parts.append((np.full(len(pair), of_group[g]), pair, n))
                continue
            left = slice(first_a[g], first_a[g] + in_a[g:to].sum())
            of_a = np.repeat(np.arange(g, to), in_a[g:to])
            pair = np.repeat(a[left], in_b[of_a]) * self.width + b[_ranges(first_b[of_a], in_b[of_a])]
            parts.append(_merged(np.repeat(of_group[of_a], in_b[of_a]), pair, np.ones(len(pair), np.int64)))
        return _merged(*map(np.concatenate, zip(*parts, strict=True)))

    def align(self, texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """For each text (tokens of A and B, groups, links), the digest of the written groups; then the end of each
        text's distinct pairs, the pairs and their links. Texts that a tokenizer does not give back have nothing."""
        if self.held > REMEMBERED:
            self._forget_late()
        elif self.held < FIRST * REMEMBERED:
            self.first = len(self.known), self.held
        of_text = [self.words(t) for t in texts]
        words = list(chain.from_iterable(of_text))
        new = [w for w in dict.fromkeys(words) if w not in self.known]
        if new:
            self.learn(new)
        index = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        n = np.array([len(w) for w in of_text])
        first = np.cumsum(n) - n
        rows = self.counts[index]
        valid = np.minimum.reduceat(rows[:, 0], first) == 1
        counts = np.add.reduceat(rows[:, 1:], first) * valid[:, None]
        digests = []
        for ok, at, k in zip(valid.tolist(), first.tolist(), n.tolist(), strict=True):
            written = b"".join(map(self.groups.__getitem__, index[at : at + k].tolist())) if ok else b""
            digests.append(hashlib.sha256(written[:-1]).hexdigest() if ok else "")
        text = np.repeat(np.arange(len(texts)), n)
        text, index = text[valid[text]], index[valid[text]]
        many = self.from_pair[index + 1] - self.from_pair[index]
        at = _ranges(self.from_pair[index], many)
        text, pair, links = _merged(np.repeat(text, many), self.pair[at], self.links[at])
        return counts, digests, np.searchsorted(text, np.arange(1, len(texts) + 1)), pair, links


_aligners: dict[int, Aligner] = {}


def _aligner(a: bytes, b: bytes) -> Aligner:
    key = hash((a, b))
    if key not in _aligners:
        _aligners.clear()
        _aligners[key] = Aligner(a, b)
    return _aligners[key]


def _lists(ends: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.concatenate([[0], ends]).astype(np.int32), pa.array(values, pa.int64()))


def _sha(text: str = "text"):
    return F.unhex(F.sha2(F.col(text), 256))


def aligned_texts(docs: DataFrame, a: bytes, b: bytes) -> DataFrame:
    """One row for each distinct text that is not empty: text_sha (256 bits), copies, n_a, n_b, n_groups, n_links,
    groups_sha256, pairs (the distinct id pairs as a * width of B + b) and links (of each pair).

    Copies are added up before and after a shuffle by the full text, so each text is tokenised once, however many
    documents have it. ``docs`` needs a column text; a text is one value in a task, of any length."""
    short_batches(docs.sparkSession)
    shared: Broadcast = docs.sparkSession.sparkContext.broadcast((a, b))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(*shared.value)
        for batch in batches:
            sizes = np.concatenate([[0], np.cumsum(batch.column("n_bytes").to_numpy())])
            for at, to in chunks(sizes):
                part = batch.slice(at, to - at)
                counts, digests, ends, pair, links = aligner.align(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column("text_sha"), part.column("copies"), *(pa.array(c, pa.int64()) for c in counts.T), pa.array(digests, pa.string()), _lists(ends, pair), _lists(ends, links)],
                    ["text_sha", "copies", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "links"],
                )

    texts = docs.select("text").filter(F.length("text") > 0).groupBy("text").agg(F.count("*").alias("copies"))
    return texts.select(_sha().alias("text_sha"), "copies", F.octet_length("text").cast("long").alias("n_bytes"), "text").mapInArrow(
        run, "text_sha binary, copies long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, links array<long>"
    )


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n): how many documents have an id pair linked, each text weighted by its copies."""
    return aligned.select(F.explode("pairs").alias("pair"), "copies").groupBy("pair").agg(F.sum("copies").alias("n"))


def named_pairs(counts: DataFrame, a: bytes, b: bytes) -> DataFrame:
    """(a_id, b_id, a_token, b_token, n): pair counts with the bytes of the tokens, looked up in both vocabularies."""
    spark = counts.sparkSession
    sides = {x: spark.createDataFrame(enumerate(map(bytearray, t.tokens)), f"{x}_id long, {x}_token binary") for x, t in (("a", ByteLevel(a)), ("b", Pieces(b)))}
    width = len(Pieces(b).tokens)
    split = counts.select(F.floor(F.col("pair") / width).alias("a_id"), (F.col("pair") % width).alias("b_id"), "n")
    return split.join(F.broadcast(sides["a"]), "a_id").join(F.broadcast(sides["b"]), "b_id").select("a_id", "b_id", "a_token", "b_token", "n")


def with_counts(aligned: DataFrame, counts: DataFrame, width: int) -> DataFrame:
    """For each aligned text n_best (links whose count is the highest of their A id) and count_sum (over links).

    A pair of at least 1 / FREQUENT of the sum of all counts is looked up in the task: there are at most FREQUENT such
    pairs, and one highest count for each id of A's vocabulary. The texts of any other pair are less than that share,
    so they meet its count in a join without a hot key."""
    spark = counts.sparkSession
    total = counts.agg(F.sum("n")).first()[0] or 0
    often = F.col("n") * FREQUENT >= F.lit(total)
    best = counts.groupBy(F.floor(F.col("pair") / width).cast("long").alias("a_id")).agg(F.max("n").alias("best"))
    known = counts.filter(often).sort("pair").toPandas()
    highest = best.toPandas()
    top = np.zeros(int(highest.a_id.max()) + 1 if len(highest) else 1, np.int64)
    top[highest.a_id.to_numpy(np.int64)] = highest.best.to_numpy(np.int64)
    shared = spark.sparkContext.broadcast((known.pair.to_numpy(np.int64), known.n.to_numpy(np.int64), top))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _aligners.clear()  # this worker's, from the tasks before: that memory is for the next ones
        pairs, counted, top = shared.value
        for batch in batches:
            lists, links = batch.column("pairs"), batch.column("links").flatten().to_numpy()
            size = np.diff(lists.offsets.to_numpy())
            pair, row = lists.flatten().to_numpy(), np.repeat(np.arange(len(size)), size)
            at = np.minimum(np.searchsorted(pairs, pair), max(0, len(pairs) - 1))
            hit = pairs[at] == pair if len(pairs) else np.zeros(len(pair), bool)
            n = np.where(hit, counted[at] if len(pairs) else 0, 0)
            added = lambda x: np.bincount(row, x, len(size)).astype(np.int64)  # noqa: E731  below 2**53
            ends = np.cumsum(added(~hit))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("text_sha", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")),
                 pa.array(added(links * (hit & (n == top[pair // width])))), pa.array(added(links * n)), _lists(ends, pair[~hit]), _lists(ends, links[~hit])],
                ["text_sha", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum", "pairs", "links"],
            )

    looked = landed(aligned.mapInArrow(run, "text_sha binary, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long, pairs array<long>, links array<long>"), "looked-up")
    seldom = counts.filter(~often).withColumn("a_id", F.floor(F.col("pair") / width).cast("long")).join(F.broadcast(best), "a_id").select("pair", "n", (F.col("n") == F.col("best")).alias("is_best"))
    rest = (
        looked.select("text_sha", F.explode(F.arrays_zip("pairs", "links")).alias("x")).select("text_sha", "x.pairs", "x.links").join(seldom, F.col("pairs") == F.col("pair"))
        .groupBy("text_sha").agg(F.sum(F.when(F.col("is_best"), F.col("links")).otherwise(0)).alias("more_best"), F.sum(F.col("links") * F.col("n")).alias("more_sum"))
    )
    plus = lambda x, y: (F.col(x) + F.coalesce(F.col(y), F.lit(0))).cast("long").alias(x)
    return looked.drop("pairs", "links").join(rest, "text_sha", "left").select("text_sha", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", plus("n_best", "more_best"), plus("count_sum", "more_sum"))


def align_tokenizers(docs: DataFrame, a: bytes, b: bytes, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(measures of every document, pair counts of the corpus) of a byte-level tokenizer ``a`` and a piece model ``b``.

    Every row of ``docs`` is a document, also those of one id or of none. Null and empty texts, and texts whose tokens
    do not spell space + text (as those with U+2581), have zeros and the empty string. An empty table gives no rows;
    other columns of any name are not read. Measures are joined to ids by the text's SHA-256, which moves no text."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    aligned = landed(aligned_texts(rows, a, b), "aligned")
    counts = landed(pair_counts(aligned), "pair-counts")
    measures = with_counts(aligned, counts, len(Pieces(b).tokens))
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    some = F.coalesce(F.length("text") > 0, F.lit(False))
    found = rows.filter(some).select("doc_id", _sha().alias("text_sha")).join(landed(measures, "measures"), "text_sha").select("doc_id", *names, "groups_sha256")
    nothing = rows.filter(~some).select("doc_id", *(F.lit(0).cast("long").alias(c) for c in names), F.lit("").alias("groups_sha256"))
    return found.unionByName(nothing), counts


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment measures of all documents between the byte-level vocabulary and the piece model."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return align_tokenizers(docs, model_bytes(spark, VOCABULARY), model_bytes(spark, MODEL))[0]
