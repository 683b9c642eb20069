"""Chains and cycles of lock graphs against plain enumeration, and on queues whose paths cannot be listed."""

import random
import time
from collections import Counter, defaultdict

import pytest

from fleetlens.operators import issues, locks
from tests.test_telemetry import LOCKS, T0


def graph_of(edges):
    graph = defaultdict(list)
    for a, b, w in sorted(edges):
        graph[a].append((b, w))
    return dict(graph)


def listed(graph):
    """[(path, longest wait)] by recursion."""

    def walk(path, most):
        if path[-1] not in graph:
            yield path, most
        for b, w in graph.get(path[-1], []):
            if b in path:
                yield [*path, b], max(most, w)
            else:
                yield from walk([*path, b], max(most, w))

    waiters = {b for x in graph.values() for b, _ in x}
    return [c for root in graph if root not in waiters for c in walk([root], 0)]


def rings(graph):
    def walk(start, path):
        for b, _ in graph.get(path[-1], []):
            if b == start:
                yield path
            elif b > start and b not in path:
                yield from walk(start, [*path, b])

    return [p for s in graph for p in walk(s, [s])]


def random_graphs(n=300):
    rng = random.Random(17)
    for _ in range(n):
        size, edges = rng.randrange(2, 9), {}
        for _ in range(rng.randrange(1, 14)):
            edges[rng.randrange(size), rng.randrange(size)] = rng.choice([0, 5, 20])
        if rng.random() < 0.5:  # a root and a leaf outside
            edges[100, rng.randrange(size)] = 1
            edges[rng.randrange(size), 200] = 30
        yield graph_of([(a, b, w) for (a, b), w in edges.items()])


@pytest.mark.parametrize("critical", [1, 2, 4])
def test_totals_equal_the_listed_chains(critical):
    for graph in random_graphs():
        chains = listed(graph)
        assert sorted(locks._chains(graph)) == sorted(chains)
        want = defaultdict(list)
        for path, wait in chains:
            want[path[0], path[-1]].append((len(path), wait, path))
        got = {(r[0], r[1]): r[2:] for r in locks._totals(10, critical)(graph)}
        assert got.keys() == want.keys()
        for key, found in want.items():
            number, hard, depth, wait, path = got[key]
            assert (int(number), int(hard)) == (len(found), sum(n >= critical or w > 10 for n, w, _ in found))
            assert depth == max(n for n, *_ in found) == len(path) and wait == max(w for _, w, _ in found) and path in [p for *_, p in found]


def test_cycles_equal_plain_enumeration():
    for graph in random_graphs():
        got = [p for _, p in locks._cycles(graph)]
        assert Counter(map(tuple, got)) == Counter(map(tuple, rings(graph))) and all(p[0] == min(p) for p in got)
        groups = list(locks._groups(graph))
        inside = {v for p in got for v in p}
        assert sum(n for _, n, _, _ in groups) == len(inside)
        for start, _, _, path in groups:
            through = [p for p in got if p[0] == start]
            assert path in got and len(path) == min(map(len, through))


def queue(n):
    """Each session waits for all before it."""
    return [(1, T0, a, b, 1) for a in range(n) for b in range(a + 1, n)]


def test_a_queue_is_counted_and_not_walked(spark):
    df = spark.createDataFrame(queue(40), LOCKS)
    (r,) = locks.chain_totals(df).collect()
    assert (r.root_blocker, r.leaf, int(r.chains), int(r.critical_chains), r.depth, r.severity, r.path) == (0, 39, 2**38, 2**38 - 39, 40, 2, list(range(40)))
    assert len(list(zip(range(5000), locks._chains(graph_of([q[2:] for q in queue(40)]))))) == 5000  # lazily


def test_a_thousand_sessions(spark):
    graph = graph_of([q[2:] for q in queue(1000)])
    began = time.perf_counter()
    assert list(locks._cycles(graph)) == [] and list(locks._groups(graph)) == []
    assert time.perf_counter() - began < 2
    text = "lock_table string, waiting_query string, blocking_query string, waiting_user string, waiting_host string, blocking_user string, blocking_host string"
    df = spark.createDataFrame(queue(1000), LOCKS)
    df = df.selectExpr("*", *(f"'x' AS {c.split()[0]}" for c in text.split(", ")))
    found = issues.chain_issues(locks.chain_text(locks.chain_totals(df), locks.sessions_of(df))).unionByName(issues.cycle_issues(locks.cycle_groups(df))).collect()
    assert len(found) == 1 and int(found[0].details["chains"]) == 2**998 and found[0].severity == 2


def test_a_deadlock_inside_a_chain(spark):
    df = spark.createDataFrame([(1, T0, 1, 2, 5), (1, T0, 2, 3, 5), (1, T0, 3, 2, 5), (1, T0, 3, 4, 5), (2, T0, 3, 4, 99_999)], LOCKS)
    got = sorted((r.server_id, r.root_blocker, r.leaf, r.chains, r.path, r.severity) for r in locks.chain_totals(df).collect())
    assert got == [(1, 1, 2, "1", [1, 2, 3, 2], 2), (1, 1, 4, "1", [1, 2, 3, 4], 2), (2, 3, 4, "1", [3, 4], 2)]
    assert [(r.start, r.participants, r.edges, r.path) for r in locks.cycle_groups(df).collect()] == [(2, 2, 2, [2, 3])]
    assert locks.chain_totals(df.filter("false")).count() == 0 and locks.cycle_groups(df.filter("false")).count() == 0
