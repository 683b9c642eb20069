"""Trailing windows against plain sums, and the table of deltas by day."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import deltas, trailing
from fleetlens.sources import delta_table
from tests.test_telemetry import T0, at, digests, log, values

SAMPLES = "server_id long, name string, ts timestamp, n long"


@pytest.mark.parametrize("window", [50, 3600, 100_000])
def test_trailing_sums_over_days_and_between_polls(spark, window):
    """Samples on polls and between them, gaps of days, polls without samples, samples behind the last poll."""
    rng = random.Random(window)
    polls = {(s, t) for s in (1, 2) for t in rng.sample(range(0, 260_000, 40), 120)}
    samples = [(rng.choice([1, 2, 3]), rng.choice("ab"), rng.choice([t, t + 7, t + 90_000]), rng.randrange(9)) for t in rng.sample(range(0, 260_000, 40), 150)]
    samples += samples[:5]
    df = spark.createDataFrame([(s, k, at(t), n) for s, k, t, n in samples] + [(None, "a", T0, 1), (1, "a", None, 1)], SAMPLES)
    known = spark.createDataFrame([(s, at(t)) for s, t in polls] + [(None, T0)], "server_id long, poll_ts timestamp")
    got = {(r.server_id, r.name, r.poll_ts): r.n for r in trailing.trailing(df, known, ["server_id", "name"], ["n"], window, "ts").collect()}
    want = {}
    for s, p in polls:
        for k in "ab":
            inside = [n for s2, k2, t, n in samples if (s2, k2) == (s, k) and p - window <= t <= p]
            if inside:
                want[s, k, at(p)] = sum(inside)
    assert got == want and want
    assert trailing.trailing(df.filter("false"), known, ["server_id", "name"], ["n"], window, "ts").count() == 0
    assert trailing.trailing(df, known.filter("false"), ["server_id", "name"], ["n"], window, "ts").count() == 0


def test_load_by_group_as_of_adds_up(spark):
    """As many executing sessions of each group as ticks: the groups' loads add up to the sessions a tick."""
    rows = [(1, at(i), u, True) for i in range(5) for u in ("u1", "u2", "")]
    df = spark.createDataFrame(rows, "server_id long, ts timestamp, user_name string, executing boolean")
    got = trailing.load_by_group_as_of(df, log(spark, 1, 4), "user_name", 60)
    assert values(got, "poll_ts", "name", "observations", "ticks", "aas") == [(at(s), u, s + 1, s + 1, 1.0) for s in (1, 4) for u in ("(unknown)", "u1", "u2")]


def random_polls(seed):
    rng, count, rows, polls = random.Random(seed), {}, [], []
    for s in range(0, 6 * 86_400, 10_000):
        if 2 * 86_400 <= s < 3 * 86_400:  # a day without polls
            continue
        if rng.random() < 0.9:
            polls.append(s)
        for d in "abc":
            if rng.random() < 0.7:
                count[d] = max(1, count.get(d, 5) + rng.choice([0, 1, 5, 5, -4]))
                rows.append((s, d, count[d], count[d] * 7, count[d]))
    return rows, polls


@pytest.mark.parametrize("seed", [3, 4])
def test_days_are_added_one_by_one(spark, tmp_path, seed):
    rows, polls = random_polls(seed)
    all_rows, known = digests(spark, *rows), log(spark, *polls)
    days = [T0.date() + dt.timedelta(days=d) for d in range(6)]
    first = F.to_date("poll_ts") <= F.lit(days[0])
    path = str(tmp_path)
    delta_table.build(known.filter(first), all_rows.filter(first), path)
    for day in [*days[1:], days[4], days[5]]:  # the last two are mended
        delta_table.add_day(spark, known, all_rows, path, day)
    names = ("digest", "poll_ts", "exec_delta", "timer_delta", "interval_ns")
    assert values(spark.read.parquet(f"{path}/deltas"), *names) == values(deltas.digest_deltas(known, all_rows), *names)


def test_only_the_days_asked_for_are_read(spark, tmp_path):
    rows, polls = random_polls(5)
    delta_table.build(log(spark, *polls), digests(spark, *rows), str(tmp_path))
    some = delta_table.deltas_between(spark, str(tmp_path), dt.date(2024, 1, 2), dt.date(2024, 1, 2))
    assert {r.poll_ts.date() for r in some.collect()} == {dt.date(2024, 1, 2)}
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "day" not in some.columns
