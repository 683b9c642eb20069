"""A passage in many contexts: no task gets all fragments of its anchors."""

import random

import pyarrow as pa

from fleetlens.llm import suffix_dedup
from tests.llm.test_operators import brute_repeats, frame


def test_hot_anchors_equal_brute_force(spark, monkeypatch):
    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    hot, warm = text(90), text(60)
    rows = [(i, text(rng.randrange(40)) + rng.choice([hot, hot[20:], hot[:70] + warm]) + text(rng.randrange(40))) for i in range(120)]
    rows += [(200 + i, rows[i][1]) for i in range(5)] + [(300, text(200)), (301, warm + text(9)), (302, None)]
    tasks = spark.sparkContext.accumulator(0)
    plain = suffix_dedup._sort_columns

    def counted(length, unit):
        inner = plain(length, unit)

        def run(batches):
            n = 0
            held = []
            for b in batches:
                held.append(b)
                for x in b.column(0).value_counts():
                    n = max(n, x["counts"].as_py())
            tasks.add(n > 10)
            yield from inner(iter(held))

        return run

    monkeypatch.setattr(suffix_dedup, "HOT_PARTS", 10)
    monkeypatch.setattr(suffix_dedup, "_sort_columns", counted)
    got = suffix_dedup.without_repeats(frame(spark, rows), 40, with_text=False, whole_characters=False).select("n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(tuple(r) for r in got) == sorted(brute_repeats([(t or "").encode() for _, t in rows], 40))
    assert tasks.value == 0


def test_a_text_that_comes_again_is_cut_once():
    wanted = [{"anchor": 1, "f1": 2, "f2": 3, "n": 2, "off": 0, "width": 1, "start": 0, "size": 4}]
    b = pa.RecordBatch.from_pydict({"k1": [7, 7, 8], "k2": [1, 1, 1], "text": ["abcdef"] * 3, "wanted": [wanted] * 3})
    assert sum(x.num_rows for x in suffix_dedup._cut("byte")(iter([b, b.slice(2)]))) == 2
