"""Passages of over 50 words, however short in bytes, against brute force."""

import random
import re
from collections import Counter

import numpy as np

import corpus_pipeline
from fleetlens.llm import suffix_dedup
from tests.llm.test_operators import brute_repeats, frame

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def brute_passages(texts, words):
    found = [[m.span() for m in WORD.finditer(t)] for t in texts]
    keys = [[tuple(t[a:z] for a, z in w[i : i + words]) for i in range(len(w) - words + 1)] for t, w in zip(texts, found, strict=True)]
    count = Counter(k for row in keys for k in row)
    out = []
    for t, w, row in zip(texts, found, keys, strict=True):
        cover = np.zeros(len(t), bool)
        for i, k in enumerate(row):
            if count[k] > 1:
                cover[w[i][0] : w[i + words - 1][1]] = True
        out.append(cover)
    return out


def test_passages_equal_brute_force(spark):
    rng = random.Random(4)
    parts = [" ".join(rng.choice("abcdé") for _ in range(rng.randrange(3, 30))) for _ in range(8)]
    rows = [(i, rng.choice([" ", "\n", "  "]).join(rng.choice(parts) if rng.random() < 0.5 else " ".join(rng.choice("abcdefghij") for _ in range(9)) for _ in range(rng.randrange(0, 7)))) for i in range(80)]
    rows += [(100, "ab " * 100), (101, ""), (3, rows[3][1]), (102, "one two"), (103, rows[5][1].replace(" ", "\t "))]
    docs = frame(spark, rows).selectExpr("doc_id as k1", "cast(octet_length(text) as bigint) as k2", "text")
    for words in (2, 7, 12):
        spans = {}
        for r in suffix_dedup.repeated_spans(docs, words, suffix_dedup.WORD).collect():
            spans[r.k1, r.k2] = [s.asDict() for s in r.spans]
        for (i, t), cover in zip(rows, brute_passages([t.encode() for _, t in rows], words), strict=True):
            got = np.zeros(len(cover), bool)
            for a, z in suffix_dedup.merged(t.encode(), spans.get((i, len(t.encode()))), suffix_dedup.WORD):
                got[a:z] = True
            assert (got == cover).all(), (words, i)


def test_hot_words_equal_brute_force(spark, monkeypatch):
    rng = random.Random(6)
    text = lambda n: " ".join(rng.choice("abcdefgh") for _ in range(n))
    hot = text(30)
    rows = [(i, f"{text(rng.randrange(1, 12))} {hot if i % 4 else hot[20:]} {text(rng.randrange(1, 12))}") for i in range(60)] + [(90, ""), (91, None), (92, hot)]
    monkeypatch.setattr(suffix_dedup, "HOT_PARTS", 10)
    got = suffix_dedup.without_repeats(frame(spark, rows), 12, suffix_dedup.WORD, with_text=False, whole_characters=False)
    covers = {i: c for (i, _), c in zip(rows, brute_passages([(t or "").encode() for _, t in rows], 12), strict=True)}
    assert {r.doc_id: r.n_removed for r in got.collect()} == {i: int(c.sum()) for i, c in covers.items()}


def test_planted_passages_of_op8(spark, tmp_path):
    """Passages of over 50 words, under and over 400 bytes, in otherwise clean documents: n_passage_bytes has both,
    n_removed has those of 400 bytes, and clean documents have neither."""
    rng = random.Random(12)
    fresh = iter(range(10**6))
    words = lambda n: " ".join(f"u{next(fresh)}x" for _ in range(n))
    short, long = " ".join(rng.choice("abcdefghijklmnop") for _ in range(60)), words(100)
    assert len(short) < 400 < len(long)
    rows = [(i, f"{words(60)} {short if i < 5 else long} {words(60)}" if i < 10 else words(150)) for i in range(20)]
    frame(spark, rows).select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in suffix_dedup.op8_suffix_dedup(spark, str(tmp_path)).collect()}
    want = [t for t in brute_repeats([t.encode() for _, t in rows], 400)]
    assert [tuple(got[i][c] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")) for i in range(20)] == want
    assert [got[i].n_passage_bytes for i in range(20)] == [len(short)] * 5 + [len(long)] * 5 + [0] * 10
    assert [got[i].n_removed >= len(long) for i in range(20)] == [False] * 5 + [True] * 5 + [False] * 10


def test_long_texts_have_the_same_words(monkeypatch):
    rng = random.Random(2)
    data = "".join(rng.choice(["a", "bc", " ", "\n", "wörd" * 5, " x "]) for _ in range(900)).encode()
    whole = suffix_dedup.symbols(np.frombuffer(data, np.uint8), np.array([0, len(data)]), suffix_dedup.WORD)
    for size in (5, 40, 333):
        monkeypatch.setattr(suffix_dedup, "CHUNK_BYTES", size)
        parts = suffix_dedup.symbols(np.frombuffer(data, np.uint8), np.array([0, len(data)]), suffix_dedup.WORD)
        assert (parts[0] == whole[0]).all() and (parts[1] == whole[1]).all()


def test_pipeline_removes_short_passages(spark, data):
    rng = random.Random(9)
    fresh = iter(range(10**6))
    words = lambda n: " ".join(f"u{next(fresh)}x" for _ in range(n))
    over, under = (" ".join(rng.choice("abcdefghijklmnop") for _ in range(n)) for n in (51, 50))
    assert len(over) < 400
    rows = [(i, f"{words(30)} {over} {words(30)}") for i in range(5)] + [(10 + i, f"{words(30)} {under} {words(30)}") for i in range(2)]
    docs = frame(spark, rows).selectExpr("doc_id", "text", "lang", "'s' as source", "cast(length(text) as bigint) as n_chars")
    got = {r.doc_id: r for r in corpus_pipeline.repeated_passages(spark, docs, data).collect()}
    for i, t in rows:
        assert got[i].text == (t.replace(over, "") if i < 10 else t) and got[i].n_chars == len(got[i].text)
