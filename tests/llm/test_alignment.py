"""Cross-tokenizer alignment against a document by document count with the two libraries."""

import hashlib
import random
from collections import Counter
from itertools import accumulate

import pytest

from fleetlens.llm import tokenizer_alignment as ta

SCHEMA = "doc_id long, text string, pairs string, copies string"


@pytest.fixture(scope="module")
def files():
    return tuple(open(p, "rb").read() for p in (ta.VOCABULARY, ta.MODEL))


def alignment(text, a, b, by_a, by_b):
    """[(A ids, B ids)] of a text's groups, cut where both have a token end."""
    if not text:
        return []
    ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    spelled = [by_a[i] for i in ids[0]], [by_b[i] for i in ids[1]]
    if not all(b"".join(s) == (" " + text).encode() for s in spelled):
        return []
    ends = [list(accumulate(map(len, s))) for s in spelled]
    cuts, out, before = sorted(set(ends[0]) & set(ends[1])), [], 0
    at = [0, 0]
    for c in cuts:
        group = []
        for side in (0, 1):
            k = at[side]
            while k < len(ids[side]) and ends[side][k] <= c:
                k += 1
            group.append(ids[side][at[side] : k])
            at[side] = k
        out.append(tuple(group))
    return out


def brute(rows, files):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_str(files[0].decode()), SentencePieceProcessor(model_proto=files[1])
    a.encode_special_tokens = True
    by_a, by_b = ta.ByteLevel(files[0]).tokens, [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in range(b.get_piece_size())]
    docs = [(d, alignment(t, a, b, by_a, by_b)) for d, t in rows]
    counts = Counter(x for _, gs in docs for x in {(i, j) for p, q in gs for i in p for j in q})
    best = {}
    for (i, _), n in counts.items():
        best[i] = max(n, best.get(i, 0))
    out = []
    for d, gs in docs:
        links = [(i, j) for p, q in gs for i in p for j in q]
        written = ";".join(f"{','.join(map(str, p))}|{','.join(map(str, q))}" for p, q in gs)
        out.append((d, sum(len(p) for p, _ in gs), sum(len(q) for _, q in gs), len(gs), len(links), sum(counts[x] == best[x[0]] for x in links), sum(counts[x] for x in links), hashlib.sha256(written.encode()).hexdigest() if gs else ""))
    return out, counts


def texts():
    rng = random.Random(11)
    bits = ["the ", "Straße", " 漢字", "🙂🙃", "\n", "\n\n  ", "\t", "  ", " ", "don't", "x=1;", "ﬁ", "<s>", "</s> ", "<|endoftext|>", "12345", "'ll ", " ", "á", "\x1c", "　b", "…", "AAAAAAAA", "​"]
    out = ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 30))) for _ in range(400)]
    return out + ["", " ", "  lead", "trail  ", "\nfoo", "one", "has ▁ inside", "a" * 3000, "é" * 2001, "no-space" * 500, "nul \x00 byte", "퟿ ", "word " * 4000, "same text", "same text"]


def rows():
    return [(k, t) for k, t in enumerate([*texts(), None])] + [(None, "same text"), (7, "again"), (7, "again"), (7, "other")]


@pytest.mark.parametrize("frequent", [2**17, 1])
def test_equals_brute_force(spark, files, frequent, monkeypatch):
    monkeypatch.setattr(ta, "FREQUENT", frequent)  # 1: no pair is looked up, all are joined
    given = rows()
    df = spark.createDataFrame([(*r, "clash", "clash") for r in given], SCHEMA)
    got, counts = ta.align_tokenizers(df, *files)
    want, pairs = brute(given, files)
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, got.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()), key=key) == sorted(want, key=key)
    assert {(r.a_id, r.b_id): r.n for r in ta.named_pairs(counts, *files).collect()} == pairs
    assert sum(1 for r in want if r[1] == 0) < 30  # most texts are spelled by both


def test_empty_table(spark, files):
    df = spark.createDataFrame([], "doc_id long, text string")
    got, counts = ta.align_tokenizers(df, *files)
    assert got.count() == 0 and counts.count() == 0
    got, _ = ta.align_tokenizers(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"), *files)
    assert sorted((r.doc_id, r.n_links, r.count_sum, r.groups_sha256) for r in got.collect()) == [(1, 0, 0, ""), (2, 0, 0, "")]


def plain(aligned):
    counts, digests, ends, pair, links = aligned
    return counts.tolist(), digests, ends.tolist(), pair.tolist(), links.tolist()


def test_words_and_whole_texts_align_alike(files):
    by_words, whole = ta.Aligner(*files), ta.Aligner(*files)
    whole.by_words = False
    given = [t for t in texts() if t]
    assert by_words.by_words and plain(by_words.align(given)) == plain(whole.align(given))


@pytest.mark.parametrize("limit", [1, 7])
def test_a_group_of_very_many_links(files, monkeypatch, limit):
    given = [t for t in texts() if t]
    want = plain(ta.Aligner(*files).align(given))
    monkeypatch.setattr(ta, "EXPANDED", limit)
    assert plain(ta.Aligner(*files).align(given)) == want


def test_forgotten_words_are_learned_again(files, monkeypatch):
    given = [t for t in texts() if t]
    parts = [given[k : k + 40] for k in range(0, len(given), 40)]
    want = [plain(ta.Aligner(*files).align(p)) for p in parts]
    monkeypatch.setattr(ta, "REMEMBERED", 10)
    aligner = ta.Aligner(*files)
    assert [plain(aligner.align(p)) for p in parts] == want


def test_first_words_stay_when_memory_is_full(files, monkeypatch):
    # a worker that forgets between batches gives what one that remembers all gives, and keeps its first words
    rng = random.Random(8)
    texts = [" ".join("".join(rng.choice("abcdeé中") for _ in range(rng.randrange(1, 9))) for _ in range(40)) for _ in range(60)]
    whole = ta.Aligner(*files)
    want = [whole.align(texts[i : i + 5]) for i in range(0, 60, 5)]
    monkeypatch.setattr(ta, "REMEMBERED", 30_000)
    small = ta.Aligner(*files)
    for i, rows in zip(range(0, 60, 5), want, strict=True):
        for x, y in zip(small.align(texts[i : i + 5]), rows, strict=True):
            assert list(map(str, x)) == list(map(str, y))
    assert len(small.known) < len(whole.known)
    assert set(small.words(texts[0])) <= set(small.known)
