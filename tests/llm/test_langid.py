"""Language labels against a plain word-by-word version; texts without letters; texts in pieces."""

import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetlens.llm import langid
from tests.llm.test_operators import frame

WORDLESS = ["🙂 🙂 🙂 🙂", "。 、 。 、", "× ÷ × ÷", "٣ ٤ ٥ ٦", "123 456 !!!", "́ ́ ́", "€ £ ¥ «»", "", None]
LETTERED = ["a", "ß", "漢", "ת", "один", "ñ 🙂", "ΑΒΓ", "٣ ا", "ꙮ", "𐐷"]


@pytest.fixture(scope="module")
def model(spark, data):
    return langid.fit(spark.read.parquet(f"{data}/documents.parquet"), F.lit(True))


def brute(text, model, penalty):
    """(language, score) by dictionaries of one word at a time."""
    raw = []
    for c in text or "":
        kind = unicodedata.category(c)[0]
        low = c.lower()
        raw.append((low if len(low) == 1 and len(low.encode()) == len(c.encode()) and ord(c) < 0x800 and (ord(c) < 0x80) == (ord(low) < 0x80) else c) if kind in "LM" else " " * len(c.encode()))
    held = "".join(raw).encode()
    words, k, at = [], len(model["langs"]), 0
    for w in held.split(b" "):
        if any(unicodedata.category(c)[0] == "L" for c in w.decode()):
            scores = np.zeros(k)
            lo, hi = max(0, at - 1), min(len(held), at + len(w) + 1)
            for width, table in zip(langid.GRAMS, model["tables"], strict=True):
                own = np.frombuffer(held[lo:hi], np.uint8)
                scores += table[langid.gram_ids(own, width)].sum(axis=0)
            first = max(int(langid.SCRIPT_OF[c.encode()[0]]) for c in w.decode() if unicodedata.category(c)[0] == "L")
            words.append((scores + np.where(model["writes"][first], 0, langid.BARRED), len(w)))
        at += len(w) + 1
    if not words:
        return "und", 0.0
    value, back = words[0][0].copy(), []
    for s, _ in words[1:]:
        moves = value[None, :] - penalty * (1 - np.eye(k))
        back.append(moves.argmax(axis=1))
        value = moves.max(axis=1) + s
    state = [int(value.argmax())]
    for b in reversed(back):
        state.append(int(b[state[-1]]))
    weight = np.zeros(k)
    for (_, n), s in zip(words, reversed(state), strict=True):
        weight[s] += n
    return model["langs"][int(weight.argmax())], weight.max() / weight.sum()


def test_equals_plain_version(spark, data, model):
    docs = spark.read.parquet(f"{data}/documents.parquet").orderBy("doc_id").limit(120)
    texts = [r.text for r in docs.collect()] + WORDLESS + LETTERED
    got = {r.doc_id: r for r in langid.labelled(frame(spark, list(enumerate(texts))), model).collect()}
    for i, t in enumerate(texts):
        lang, score = brute(t, model, langid.SWITCH_PENALTY)
        assert got[i].lang_pred == lang and got[i].score == pytest.approx(score, abs=1e-6), (i, (t or "")[:60])
    plain = langid.labelled(frame(spark, list(enumerate(texts))), model, with_spans=False)
    assert "lang_spans" not in plain.columns and {r.doc_id: r.lang_pred for r in plain.collect()} == {i: r.lang_pred for i, r in got.items()}


def test_without_letters_is_und(spark, model):
    got = {r.doc_id: r for r in langid.labelled(frame(spark, list(enumerate(WORDLESS + LETTERED))), model).collect()}
    for i in range(len(WORDLESS)):
        assert (got[i].lang_pred, got[i].score, got[i].lang_spans) == ("und", 0.0, [])
    for i in range(len(WORDLESS), len(got)):
        assert got[i].lang_pred in model["langs"] and got[i].score > 0


@pytest.mark.parametrize("limit", [40, 97, 1000])
def test_pieces_give_the_same_words(spark, data, model, limit, monkeypatch):
    texts = [r.text.encode() for r in spark.read.parquet(f"{data}/documents.parquet").limit(30).collect()] + [b"", "über straße élan".encode() * 1, "один два три четыре".encode() * 9]
    offsets = np.cumsum([0, *map(len, texts)])
    whole = np.frombuffer(b"".join(texts), np.uint8)
    want = langid._labels(whole, offsets, model, 12.0, True)
    plain = langid.pieces
    monkeypatch.setattr(langid, "pieces", lambda d, o: plain(d, o, limit))
    got = langid._labels(whole, offsets, model, 12.0, True)
    assert got[0] == want[0] and np.allclose(got[1], want[1]) and got[2] == want[2]
    runs = np.frombuffer(("漢字" * 300).encode(), np.uint8)
    assert sum(len(p) for p, _, _ in plain(runs, np.array([0, len(runs)]), limit)) == len(runs)
    assert all(bytes(p).decode() for p, _, _ in plain(runs, np.array([0, len(runs)]), limit))
