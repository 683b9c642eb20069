"""Large groups of near copies with shared edits, against brute force."""

import random

import pytest

from fleetlens.llm import jaccard
from tests.llm.test_operators import brute_components, frame


@pytest.mark.parametrize(("seed", "n", "percent"), [(3, 3, 90), (5, 5, 80)])
def test_shared_edits_equal_brute_force(spark, seed, n, percent):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for size in (50, 100, 150):
        base = [rng.choice(vocabulary) for _ in range(size)]
        edits = [(rng.randrange(size), rng.choice(vocabulary)) for _ in range(12)]
        for _ in range(120):
            copy = list(base)
            for _ in range(rng.choice([1, 2, 2, 3, 4, 5])):
                at, word = rng.choice(edits) if rng.random() < 0.7 else (rng.randrange(size), f"n{rng.randrange(9999)}")
                copy[at] = word
            rows.append((len(rows), " ".join(copy)))
    want = {d: c for d, _, c in brute_components(rows, n, percent)}
    assert {r.doc_id: r.component_id for r in jaccard.jaccard_components(frame(spark, rows), n, percent).collect()} == want


def test_second_hubs_spare_pairs(spark, monkeypatch):
    """200 copies that share one edit each with a third of the others are joined by a few links each, not by pairs."""
    rng = random.Random(1)
    base = [f"w{i}" for i in range(150)]
    rows = [(0, " ".join(base))]
    for i in range(1, 200):
        copy = list(base)
        for at in (20 * (i % 3) + 5, 90):
            copy[at] = f"e{at}"
        for at in rng.sample(range(100, 150, 4), i % 4):
            copy[at] = f"r{at}"
        rows.append((i, " ".join(copy)))
    made = []
    plain = jaccard.landed

    def counted(df, name):
        out = plain(df, name)
        made.append((name, out.count()))
        return out

    monkeypatch.setattr(jaccard, "landed", counted)
    want = {d: c for d, _, c in brute_components(rows, 3, 90)}
    assert {r.doc_id: r.component_id for r in jaccard.jaccard_components(frame(spark, rows), 3, 90).collect()} == want
    assert sum(n for name, n in made if name == "cousins") <= 8 * len(rows)


def test_steps_leave_no_tables_and_shuffles(spark, monkeypatch):
    """What a step landed goes when nothing reads it any more, and shuffles are dropped between steps."""
    rng = random.Random(4)
    base = [f"w{rng.randrange(300)}" for _ in range(80)]
    rows = [(i, " ".join(base[:20] + [f"n{rng.randrange(9)}"] + base[21 : 70 + rng.randrange(3)])) for i in range(60)]
    land, names, held = jaccard.landed, {}, []

    def noted(df, name):
        out = land(df, name)
        names.setdefault(name, []).append(out.landed_at)
        return out

    release = jaccard.released
    monkeypatch.setattr(jaccard, "landed", noted)
    monkeypatch.setattr(jaccard, "released", lambda s, *tables: (held.append(len(names)), release(s, *tables)))
    found = {r.doc_id: r.component_id for r in jaccard.jaccard_components(frame(spark, rows)).collect()}
    assert found == {d: c for d, _, c in brute_components(rows, 3, 90)}
    path = spark._jvm.org.apache.hadoop.fs.Path
    there = lambda p: path(p).getFileSystem(spark._jsc.hadoopConfiguration()).exists(path(p))
    assert [p for name in ("frequent", "heavy", "shared", "star", "pairs", "crowd", "open") for p in names[name] if there(p)] == []
    assert len(held) >= 9
