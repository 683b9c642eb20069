"""Gaps between sets of transaction ids against sets of numbers."""

import random

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import gtid
from tests.test_telemetry import one


@pytest.mark.parametrize(("text", "want"), [("A:1-5:7, b:3", [("a", 1, 5), ("a", 7, 7), ("b", 3, 3)]), ("", []), (None, []), ("a", []), ("a:x:5-2:9-", []), (":1-2", []), ("a:1-2,\n a:2-4", [("a", 1, 2), ("a", 2, 4)])])
def test_intervals(spark, text, want):
    assert [tuple(x) for x in one(spark, gtid.gtid_intervals(F.lit(text).cast("string")))] == want


def test_gaps_equal_sets(spark):
    rng = random.Random(3)

    def random_set():
        parts = [(rng.choice("ab"), rng.randrange(1, 40)) for _ in range(rng.randrange(5))]
        parts = [(u, lo, lo + rng.choice([0, 0, 1, 5, 30])) for u, lo in parts]
        return ",".join(f"{u}:{lo}-{hi}" if hi > lo else f"{u}:{lo}" for u, lo, hi in parts), {(u, x) for u, lo, hi in parts for x in range(lo, hi + 1)}

    rows, want = [(None, "a:1-9", "a:3")], {None: {("a", x) for x in range(1, 10)} - {("a", 3)}}
    for i in range(150):
        (s, has), (r, had) = random_set(), random_set()
        rows.append((i, s, r))
        want[i] = has - had
    got = gtid.gtid_gap(spark.createDataFrame(rows, "id long, s string, r string"), ["id"], "s", "r").collect()
    assert len(got) == len(rows) and {r.id: r.missing for r in got} == {k: len(v) for k, v in want.items()}
    for r in got:
        spelled = {(u, x) for part in r.gap.split(",") if part for u, *runs in [part.split(":")] for run in runs for x in range(int(run.split("-")[0]), int(run.split("-")[-1]) + 1)}
        assert spelled == want[r.id]
    assert {r.id: r.gap for r in got}[None] == "a:1-2:4-9"
    far = spark.createDataFrame([(1, "a:1-9000000000000", "a:1-8999999999999")], "id long, s string, r string")
    assert gtid.gtid_gap(far, ["id"], "s", "r").first().gap == "a:9000000000000"
