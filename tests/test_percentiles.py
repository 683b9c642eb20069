"""Percentiles of merged histograms against sorted samples, and columns of conditions."""

import math
import random

from pyspark.sql import functions as F

from fleetlens.operators import percentiles as pc
from fleetlens.plans import explain
from tests.test_telemetry import values


def test_buckets_hold_their_values(spark):
    rng = random.Random(4)
    numbers = [*range(300), *(2**k + d for k in range(6, 62) for d in (-1, 0, 1)), *(rng.randrange(2 ** rng.randrange(1, 62)) for _ in range(500))]
    low, high = pc.bounds_of(F.col("b"))
    rows = spark.createDataFrame([(x,) for x in numbers], "x long").withColumn("b", pc.bucket_of(F.col("x"))).withColumn("low", low).withColumn("high", high).collect()
    assert all(r.low <= r.x <= r.high and (r.high - r.low + 1) * pc.PARTS <= max(r.low, pc.PARTS) for r in rows)
    assert all(r.low == r.high for r in rows if r.x < 2 * pc.PARTS)
    by_value = sorted((r.x, r.b) for r in rows)
    assert [b for _, b in by_value] == sorted(b for _, b in by_value)
    none = spark.createDataFrame([(None,), (-5,)], "x long")
    assert [r.b for r in none.select(pc.bucket_of(F.col("x")).alias("b")).collect()] == [None, None]


def test_percentiles_within_the_bound(spark):
    rng = random.Random(8)
    rows = [(k, h, int(rng.lognormvariate(12, 3)) if k != "c" else h) for k, size in (("a", 3000), ("b", 7), ("c", 40)) for h in [rng.randrange(5) for _ in range(size)]]
    df = spark.createDataFrame([*rows, ("d", 1, None)], "k string, hour int, v long")
    got = pc.percentiles(pc.merged(pc.histogram(df, ["k", "hour"], "v"), ["k"]), ["k"], (0.0, 0.5, 0.95, 0.99, 1.0)).collect()
    assert len(got) == 15
    for r in got:
        held = sorted(v for k, _, v in rows if k == r.k)
        exact = held[max(1, math.ceil(r.share * len(held))) - 1]
        assert r.n == len(held) and abs(r.value - exact) <= pc.RELATIVE_ERROR * exact


def test_columns_of_conditions(spark):
    plan = '{"query_block":{"nested_loop":[{"table":{"table_name":"t","attached_condition":"%s"}},{"table":{"table_name":"u"}}]}}'
    rows = [("p", 1, plan % "((`s`.`t`.`a` = 'it''s `no`') and (`s`.`u`.`b` = `s` . `t` . `c`) and (`d` > 1) and (`t`.`a` < 2))"), ("q", 2, "broken {"), ("r", 3, plan % "(1 = 0)")]
    df = spark.createDataFrame(rows, "digest string, ts long, plan_json string")
    assert values(explain.condition_columns(df), "digest", "table_name", "column_name") == [("p", "t", "a"), ("p", "t", "c"), ("p", "t", "d")]
    indexes = spark.createDataFrame([("t", "a", 1), ("t", "c", 2), ("u", "d", 1)], "table_name string, column_name string, seq_in_index int")
    assert values(explain.unindexed_conditions(df, indexes), "column_name") == [("c",), ("d",)]
