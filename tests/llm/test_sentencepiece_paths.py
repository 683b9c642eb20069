"""Cheapest paths of the composed transducer: both kinds of model against brute force, normaliser arcs, the library."""

import itertools
import random
import struct

import pytest

from fleetlens.llm import sentencepiece_fst as sp


def message(*fields):
    out = b""
    for number, kind, body in fields:
        out += bytes([number << 3 | kind]) + (bytes([len(body)]) if kind == 2 else b"") + body
    return out


def model(pieces, kind, prefix=1, trim=1, escape=1):
    rows = [(1, 2, message((1, 2, p.encode()), (2, 5, struct.pack("<f", s)), (3, 0, bytes([t])))) for p, s, t in [("<unk>", 0.0, 2), *((p, s, 1) for p, s in pieces)]]
    return message(*rows, (2, 2, message((3, 0, bytes([kind])))), (3, 2, message((3, 0, bytes([prefix])), (4, 0, bytes([trim])), (5, 0, bytes([escape])))))


PIECES = [("▁", -1.5), ("a", -2.25), ("b", -2.5), ("▁a", -3.0), ("ab", -3.125), ("ba", -4.75), ("abb", -6.5), ("▁ab", -5.0), ("▁▁", -3.5), ("aba", -6.0)]


def splits(text):
    for cuts in itertools.product([False, True], repeat=max(0, len(text) - 1)):
        at = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(text)]
        yield [text[i:j] for i, j in zip(at, at[1:], strict=False)] if text else []


def normal(text, prefix, trim):
    if trim:
        text = " ".join(x for x in text.split(" ") if x)
    return (" " + text if text and prefix else text).replace(" ", "▁")


@pytest.mark.parametrize(("prefix", "trim"), [(1, 1), (0, 1), (1, 0), (0, 0)])
def test_unigram_equals_all_splits(prefix, trim):
    t = sp.Transducer(model(PIECES, 1, prefix, trim))
    score = dict(PIECES)
    cost = lambda split: sum(-score.get(p, -t.unknown_cost) for p in split)
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choice("ab b a  x▁") for _ in range(rng.randrange(9)))
        ways = [s for s in splits(normal(text, prefix, trim)) if all(p in score or len(p) == 1 for p in s)]
        got = t.encode(text)
        assert sum(t.unknown_cost if i == 0 else -PIECES[i - 1][1] for i in got) == pytest.approx(min(map(cost, ways)))


@pytest.mark.parametrize(("prefix", "trim"), [(1, 1), (0, 0)])
def test_pairs_equal_merging(prefix, trim):
    pieces = [(p, -float(i)) for i, p in enumerate(["ab", "▁a", "ba", "▁ab", "abb", "▁▁", "abab", "bab", "▁", "a", "b"])]
    t, score = sp.Transducer(model(pieces, 2, prefix, trim)), dict(pieces)
    rng = random.Random(3)
    for _ in range(400):
        text = "".join(rng.choice("ab ab ▁") for _ in range(rng.randrange(14)))
        parts = list(normal(text, prefix, trim))
        while True:
            due = max(((score[x + y], -i) for i, (x, y) in enumerate(zip(parts, parts[1:], strict=False)) if x + y in score), default=None)
            if due is None:
                break
            parts[-due[1] : 2 - due[1]] = [parts[-due[1]] + parts[1 - due[1]]]
        assert [pieces[i - 1][0] for i in t.encode(text)] == parts, text
        assert [pieces[i - 1][0] for i in t.cheapest_path(normal(text, prefix, trim))] == parts, text


def test_marks_and_spaces_equal_the_library():
    import sentencepiece

    reference = sentencepiece.SentencePieceProcessor(model_file=sp.MODEL)
    with open(sp.MODEL, "rb") as f:
        t = sp.Transducer(f.read())
    rng = random.Random(1)
    for _ in range(3000):
        text = "".join(rng.choice(["a", "b", " ", "  ", "the", "▁", "é", "漢", "\n", "in", "g", "🎉", "1", " of "]) for _ in range(rng.randrange(14)))
        assert t.encode(text) == list(t.cheapest_path(normal(text, t.prefix, t.trim))) == reference.encode(text), text


def test_clashing_columns_and_long_texts(spark):
    rows = [(1, "a b", [7], 3, True), (2, None, None, None, None), (3, "x" * 300_000 + " y", [], 0, False)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, token_ids array<int>, n_tokens long, round_trip boolean")
    got = {r.doc_id: r for r in sp.encoded(docs, sp.model_bytes(spark)).collect()}
    assert got[2].token_ids == [] and got[2].n_tokens == 0 and all(r.round_trip for r in got.values()) and got[1].token_ids != [7]
    assert got[3].n_tokens == len(got[3].token_ids) > 1000


def test_short_units_are_composed_together(monkeypatch):
    # many tapes at once give what one tape at a time gives, and few are left to be walked one by one
    with open(sp.MODEL, "rb") as f:
        data = f.read()
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab the ing▁▁  \n\té中文🙂́.,0xzq") for _ in range(rng.randrange(60))) for _ in range(2000)] + ["", "x" * 300]
    one, single = sp.Transducer(data), []
    for text in texts:
        units = sp.UNIT.findall(text)
        single.append([i for k, u in enumerate(units) for i in one.shortest_path(u, sp.INSIDE if k else sp.START)])
    t, walked = sp.Transducer(data), []
    walk = t._finite_path
    monkeypatch.setattr(t, "_finite_path", lambda tape: walked.append(tape) or walk(tape))
    assert t.encode_all(texts) == single
    assert len(walked) < 100


@pytest.mark.parametrize(("prefix", "trim"), [(1, 1), (0, 0)])
def test_batches_equal_cheapest_paths(prefix, trim):
    # pieces whose own merges do not give them, a character that is no piece, and tapes without any piece
    pieces = [(p, -float(i)) for i, p in enumerate(["ab", "▁a", "ba", "bac", "abb", "abab", "bab", "▁", "a", "b"])]
    t = sp.Transducer(model(pieces, 2, prefix, trim))
    rng = random.Random(6)
    units = ["".join(rng.choice("abbac") for _ in range(rng.randrange(1, 12))) for _ in range(600)]
    assert t._composed(units) == [t._finite_path(t._tape(u, sp.INSIDE)) for u in units]
