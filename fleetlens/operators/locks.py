"""Lock-wait chains, cycles and trees over edge tables (server_id, snapshot_ts, blocking_pid, waiting_pid, ...).

One snapshot of one server is one graph: its edges are between sessions that are connected at that instant. Graphs are
read one after another from sorted batches, and what is found in one goes out in batches as it is found. Paths and
cycles can be exponentially many (a queue in which each session waits for all before it has 2**(n-2) chains), so
there are `chain_totals` and `cycle_groups` too, whose work is that of the edges. Issues are those that are listed."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.functions.format import truncate_text

SNAPSHOT = ["server_id", "snapshot_ts"]
Graph = dict[int, list[tuple[int, int]]]
#: Session ids in the paths of one output batch.
BATCH_IDS = 50_000


def edges_of(lock_waits: DataFrame) -> DataFrame:
    """(server_id, snapshot_ts, a, b, wait_ms): who blocks whom, each once with its longest wait (0 if there is none)."""
    wait = F.col("wait_ms") if "wait_ms" in lock_waits.columns else F.lit(0)
    rows = lock_waits.select(*SNAPSHOT, F.col("blocking_pid").cast("long").alias("a"), F.col("waiting_pid").cast("long").alias("b"), F.coalesce(wait, F.lit(0)).cast("long").alias("wait_ms"))
    return rows.filter("a is not null and b is not null").groupBy(*SNAPSHOT, "a", "b").agg(F.max("wait_ms").alias("wait_ms"))


def _by_snapshot(lock_waits: DataFrame, walk: Callable[[Graph], Iterator[tuple]], columns: str) -> DataFrame:
    """The rows that ``walk`` makes of each snapshot's graph (waiters with their waits by blocker, in order of id), in
    batches that go out while ``walk`` runs. Edges are shuffled once, by snapshot."""
    fields = [c.split() for c in columns.split(", ")]
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<bigint>": pa.list_(pa.int64())}

    def edges(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (server, at), rows in groupby(edges(batches), key=lambda r: r[:2]):
            graph: Graph = defaultdict(list)
            for _, _, a, b, wait in rows:
                graph[a].append((b, wait))
            held, ids = [], 0
            for row in walk(dict(graph)):
                held.append(row)
                ids += max((len(v) for v in row if isinstance(v, list)), default=1)
                if ids >= BATCH_IDS:
                    yield batch_of(server, at, held)
                    held, ids = [], 0
            if held:
                yield batch_of(server, at, held)

    def batch_of(server: object, at: object, held: list[tuple]) -> pa.RecordBatch:
        found = [pa.array(v, kinds[k]) for v, (_, k) in zip(zip(*held, strict=True), fields, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([server] * len(held), pa.int64()), pa.array([at] * len(held), pa.int64()), *found], ["server_id", "snapshot_us", *(n for n, _ in fields)])

    spread = lock_waits.repartition(*SNAPSHOT)
    given = edges_of(spread).select("server_id", F.unix_micros("snapshot_ts").alias("snapshot_us"), "a", "b", "wait_ms").sortWithinPartitions("server_id", "snapshot_us", "a", "b")
    out = given.mapInArrow(run, f"server_id bigint, snapshot_us bigint, {columns}")
    return out.select("server_id", F.timestamp_micros("snapshot_us").alias("snapshot_ts"), *(n for n, _ in fields))


def _roots(graph: Graph) -> list[int]:
    return sorted(set(graph) - {b for waits in graph.values() for b, _ in waits})


def _chains(graph: Graph) -> Iterator[tuple]:
    """(path, longest wait) of every chain, each when it is found; only the path at hand is held."""
    for root in _roots(graph):
        path, on_path, longest, ways = [root], {root}, [0], [iter(graph[root])]
        while ways:
            for b, wait in ways[-1]:
                most = max(longest[-1], wait)
                if b in on_path or b not in graph:
                    yield [*path, b], most
                    continue
                path.append(b)
                on_path.add(b)
                longest.append(most)
                ways.append(iter(graph[b]))
                break
            else:
                ways.pop()
                longest.pop()
                on_path.discard(path.pop())


def _components(nodes: Iterable[int], following: Callable[[int], Iterable[int]]) -> Iterator[list[int]]:
    """Strongly connected components, each after all that it leads to (Tarjan's, without recursion)."""
    number: dict[int, int] = {}
    low: dict[int, int] = {}
    stack: list[int] = []
    on_stack: set[int] = set()
    for start in nodes:
        if start in number:
            continue
        walk = [(start, iter(following(start)))]
        number[start] = low[start] = len(number)
        stack.append(start)
        on_stack.add(start)
        while walk:
            v, rest = walk[-1]
            for w in rest:
                if w not in number:
                    number[w] = low[w] = len(number)
                    stack.append(w)
                    on_stack.add(w)
                    walk.append((w, iter(following(w))))
                    break
                if w in on_stack:
                    low[v] = min(low[v], number[w])
            else:
                walk.pop()
                if walk:
                    low[walk[-1][0]] = min(low[walk[-1][0]], low[v])
                if low[v] == number[v]:
                    part = _cut(stack, v)
                    on_stack.difference_update(part)
                    yield part


def _cut(stack: list[int], v: int) -> list[int]:
    """Take the top of the stack down to v off it."""
    part = [stack.pop()]
    while part[-1] != v:
        part.append(stack.pop())
    return part


def _adjacent(graph: Graph) -> dict[int, list[int]]:
    return {a: sorted({b for b, _ in waits}) for a, waits in graph.items()}


def _tangles(nodes: Iterable[int], following: Callable[[int], Iterable[int]]) -> Iterator[set[int]]:
    """The components that hold a cycle."""
    for part in _components(nodes, following):
        if len(part) > 1 or part[0] in following(part[0]):
            yield set(part)


def _circuits(start: int, inside: set[int], following: dict[int, list[int]]) -> Iterator[list[int]]:
    """The elementary cycles through ``start`` within a component (Johnson's): a node from which ``start`` was not reached
    stays blocked until one that it leads to is free again, so no dead end is entered twice."""
    path, blocked, after = [start], {start}, defaultdict(set)
    ways, closed = [iter(following.get(start, ()))], [False]
    while ways:
        for b in ways[-1]:
            if b == start:
                closed[-1] = True
                yield list(path)
            elif b in inside and b not in blocked:
                path.append(b)
                blocked.add(b)
                ways.append(iter(following.get(b, ())))
                closed.append(False)
                break
        else:
            ways.pop()
            v = path.pop()
            if closed.pop():
                free = [v]
                while free:
                    u = free.pop()
                    if u in blocked:
                        blocked.discard(u)
                        free += after.pop(u, ())
                if closed:
                    closed[-1] = True
            else:
                for b in following.get(v, ()):
                    if b in inside:
                        after[b].add(v)


def _cycles(graph: Graph) -> Iterator[tuple]:
    """(least node, path) of each elementary cycle: those through the least node of a component, then the rest of it."""
    following = _adjacent(graph)
    left = list(_tangles(sorted(following), lambda v: following.get(v, ())))
    while left:
        inside = left.pop()
        start = min(inside)
        for path in _circuits(start, inside, following):
            yield start, path
        inside.discard(start)
        left += _tangles(sorted(inside), lambda v: [b for b in following.get(v, ()) if b in inside])  # noqa: B023  used up in this round


def _groups(graph: Graph) -> Iterator[tuple]:
    """(least node, nodes, edges, a shortest cycle through the least node) of each component that holds a cycle."""
    following = _adjacent(graph)
    for inside in _tangles(sorted(following), lambda v: following.get(v, ())):
        start = min(inside)
        before: dict[int, int] = {}
        level, closing = [start], None
        while closing is None:
            reached = []
            for v in level:
                for b in following[v]:
                    if b == start:
                        closing = v
                        break
                    if b in inside and b not in before:
                        before[b] = v
                        reached.append(b)
                if closing is not None:
                    break
            level = reached
        path = [closing]
        while path[-1] != start:
            path.append(before[path[-1]])
        yield start, len(inside), sum(b in inside for v in inside for b in following[v]), path[::-1]


class _Ways:
    """Chains from one root to a place: how many, how many of few nodes and short waits (by nodes), the most nodes, the
    longest wait, and the last step of the longest chain."""

    __slots__ = ("few", "longest", "number", "step", "wait")

    def __init__(self, shortest: int):
        self.number, self.few, self.longest, self.wait, self.step = 0, [0] * shortest, 0, 0, None

    def add(self, number: int, few: list[int], longest: int, wait: int, step: tuple) -> None:
        self.number += number
        self.few = [x + y for x, y in zip(self.few, few, strict=True)]
        if longest > self.longest:
            self.longest, self.step = longest, step
        self.wait = max(self.wait, wait)


def _inner(entry: int, inside: set[int], graph: Graph) -> Iterator[tuple[list[int], list[int], int | None]]:
    """(path, its waits, node that closes it or None) of every simple path from ``entry`` within a component."""
    stack = [([entry], [])]
    while stack:
        path, waits = stack.pop()
        yield path, waits, None
        for b, wait in reversed(graph[path[-1]]):
            if b in path:
                yield path, [*waits, wait], b
            elif b in inside:
                stack.append(([*path, b], [*waits, wait]))


def _totals(threshold_ms: int, critical_nodes: int) -> Callable[[Graph], Iterator[tuple]]:
    """(root, leaf, chains, critical ones, depth, longest wait, a longest path) for each root and end of its chains."""

    def walk(graph: Graph) -> Iterator[tuple]:
        following = _adjacent(graph)
        order = list(_components(sorted(following), lambda v: following.get(v, ())))[::-1]
        part = {v: set(c) for c in order if len(c) > 1 or c[0] in following.get(c[0], ()) for v in c}
        shortest = critical_nodes - 1

        def shifted(few: list[int], nodes: int, wait: int) -> list[int]:
            return [0] * min(nodes, shortest) + few[: max(0, shortest - nodes)] if wait <= threshold_ms else [0] * shortest

        for root in _roots(graph):
            at: dict[int, _Ways] = {root: _Ways(shortest)}
            at[root].add(1, [1, *[0] * (shortest - 1)] if shortest else [], 1, 0, ())
            ends: dict[int, _Ways] = {}

            def go(to: dict[int, _Ways], node: int, ways: _Ways, entry: int, inner: list[int], wait: int) -> None:
                nodes = len(inner)
                to.setdefault(node, _Ways(shortest)).add(ways.number, shifted(ways.few, nodes, wait), ways.longest + nodes, max(ways.wait, wait), (entry, inner))  # noqa: B023

            for component in order:
                for entry in sorted(v for v in component if v in at):
                    ways = at[entry]
                    inside = part.get(entry)
                    if inside is None:
                        if entry not in graph:
                            ends[entry] = ways
                        for b, wait in graph.get(entry, ()):
                            go(at, b, ways, entry, [entry], wait)
                        continue
                    for path, waits, closing in _inner(entry, inside, graph):
                        most = max(waits, default=0)
                        if closing is not None:
                            go(ends, closing, ways, entry, path, most)
                            continue
                        for b, wait in graph[path[-1]]:
                            if b not in inside:
                                go(at, b, ways, entry, path, max(most, wait))
            for leaf in sorted(ends):
                ways, path = ends[leaf], [leaf]
                step = ways.step
                while step:
                    path += step[1][::-1]
                    step = at[step[0]].step
                yield root, leaf, str(ways.number), str(ways.number - sum(ways.few)), ways.longest, ways.wait, path[::-1]

    return walk


def _tree(graph: Graph) -> Iterator[tuple]:
    longest: dict[int, int] = defaultdict(int)
    for waits in graph.values():
        for b, wait in waits:
            longest[b] = max(longest[b], wait)
    level = {root: [root] for root in _roots(graph)}
    seen = set(level)
    while level:
        following: dict[int, list[int]] = {}
        for pid in sorted(level, key=level.__getitem__):
            path = level[pid]
            yield pid, len(path) - 1, path[0], path, longest[pid]
            for b, _ in graph.get(pid, []):
                if b not in seen and b not in following:
                    following[b] = [*path, b]
        seen |= set(following)
        level = following


def _severity(nodes: Column, wait_threshold_ms: int, critical_nodes: int) -> Column:
    return F.when((nodes >= critical_nodes) | (F.col("max_wait_ms") > wait_threshold_ms), 2).otherwise(1)


def lock_chains(lock_waits: DataFrame, wait_threshold_ms: int = 10_000, critical_nodes: int = 4) -> DataFrame:
    """Every path of a snapshot from a root (blocks, does not wait) to where it ends, of any length; a repeated node
    ends a path and is in it. CRITICAL from ``critical_nodes`` on or with a wait over the threshold."""
    paths = _by_snapshot(lock_waits, _chains, "path array<bigint>, max_wait_ms bigint")
    return paths.select(*SNAPSHOT, F.col("path")[0].alias("root_blocker"), "path", F.size("path").alias("depth"), "max_wait_ms", _severity(F.size("path"), wait_threshold_ms, critical_nodes).alias("severity"))


def chain_totals(lock_waits: DataFrame, wait_threshold_ms: int = 10_000, critical_nodes: int = 4) -> DataFrame:
    """What `lock_chains` would list, by root and end: the exact number of chains and of CRITICAL ones (as decimal text, as
    they may have hundreds of digits), depth and wait of the greatest, the highest severity, and a longest path.

    Numbers are summed along the edges of the condensed graph, so the work for a root is that of the edges; only inside
    a deadlock (a strongly connected component) are paths walked one by one."""
    rows = _by_snapshot(lock_waits, _totals(wait_threshold_ms, critical_nodes), "root_blocker bigint, leaf bigint, chains string, critical_chains string, depth int, max_wait_ms bigint, path array<bigint>")
    return rows.select(*SNAPSHOT, "root_blocker", "leaf", "chains", "critical_chains", "path", "depth", "max_wait_ms", F.when(F.col("critical_chains") != "0", 2).otherwise(1).alias("severity"))


def lock_cycles(lock_waits: DataFrame) -> DataFrame:
    """Each elementary cycle of a snapshot once, from its smallest node."""
    return _by_snapshot(lock_waits, _cycles, "start bigint, path array<bigint>").select(*SNAPSHOT, "start", "path", F.size("path").alias("participants"), F.lit(2).alias("severity"))


def cycle_groups(lock_waits: DataFrame) -> DataFrame:
    """The sessions of a snapshot that wait for each other: each strongly connected group once, with its size, its edges
    and a shortest cycle through its smallest node. A group of as many edges as sessions is one cycle."""
    return _by_snapshot(lock_waits, _groups, "start bigint, participants int, edges int, path array<bigint>").withColumn("severity", F.lit(2))


def sessions_of(lock_waits: DataFrame) -> DataFrame:
    """(server_id, snapshot_ts, pid, user_name, host, lock_table, query) of every session in the graph: as a waiter, or,
    if it waits for nothing, as a blocker. Of several edges of a session the one with the greatest values counts."""
    side = lambda p, waits: lock_waits.select(*SNAPSHOT, F.col(f"{p}_pid").alias("pid"), F.struct(F.lit(waits).alias("waits"), F.col(f"{p}_user").alias("user_name"), F.col(f"{p}_host").alias("host"), "lock_table", F.col(f"{p}_query").alias("query")).alias("s"))
    return side("waiting", 1).unionByName(side("blocking", 0)).groupBy(*SNAPSHOT, "pid").agg(F.max("s").alias("s")).select(*SNAPSHOT, "pid", "s.user_name", "s.host", "s.lock_table", "s.query")


def chain_text(chains: DataFrame, sessions: DataFrame) -> DataFrame:
    """Add chain_text, 'PID:1(u@h) table [query] -> ...', root_query, blocked_queries and the first waiter's lock_table.
    ``sessions`` has server_id, snapshot_ts, pid, user_name, host, lock_table, query."""
    who = F.when((F.coalesce("user_name", F.lit("")) != "") | (F.coalesce("host", F.lit("")) != ""), F.format_string("(%s@%s)", "user_name", "host")).otherwise("")
    query = truncate_text(F.col("query"), 50)
    label = F.concat(F.lit("PID:"), F.col("pid").cast("string"), who, F.coalesce(F.concat(F.lit(" "), "lock_table"), F.lit("")), F.coalesce(F.concat(F.lit(" ["), query, F.lit("]")), F.lit("")))
    steps = chains.select(*SNAPSHOT, "path", F.posexplode("path").alias("n", "pid")).join(sessions, [*SNAPSHOT, "pid"], "left")
    parts = steps.groupBy(*SNAPSHOT, "path").agg(F.array_sort(F.collect_list(F.struct("n", label.alias("label"), F.coalesce(query, F.lit("")).alias("query"), F.coalesce("lock_table", F.lit("")).alias("lock_table")))).alias("s"))
    later = F.slice(F.col("s"), F.lit(2), F.size("s"))
    texts = parts.select(
        *SNAPSHOT, "path", F.array_join(F.transform("s", lambda x: x["label"]), " -> ").alias("chain_text"), F.col("s")[0]["query"].alias("root_query"),
        F.array_join(F.filter(F.transform(later, lambda x: x["query"]), lambda q: q != ""), ", ").alias("blocked_queries"), F.try_element_at("s", F.lit(2))["lock_table"].alias("lock_table"),
    )
    return chains.join(texts, [*SNAPSHOT, "path"])


def lock_tree(lock_waits: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Each pid of a snapshot once, at its least depth below a root, by its least path; the longest wait over its edges."""
    rows = _by_snapshot(lock_waits, _tree, "pid bigint, depth int, root bigint, path array<bigint>, wait_ms bigint")
    return rows if max_depth is None else rows.filter(F.col("depth") <= max_depth)


def tree_report(lock_waits: DataFrame, transactions: DataFrame, processes: DataFrame, participants: DataFrame) -> DataFrame:
    """The lock tree as it is read: roots by the age of their transactions downwards (none last), each above what waits for
    it, then the deadlock's ``participants`` (server_id, snapshot_ts, pid) that are not in the tree and not 0, without depth.

    The query is the transaction's, else the process list's, else that of an edge it waits on, else of one it blocks; '' if none is known."""
    key = [*SNAPSHOT, "pid"]
    tree = lock_tree(lock_waits).select(*key, "depth", "root", "path", "wait_ms")
    trx = transactions.groupBy(*key).agg(F.max(F.struct("age_s", F.col("query").alias("trx_query"))).alias("t")).select(*key, "t.*")
    procs = processes.groupBy(*key).agg(F.max(F.struct("time_s", "info")).alias("p")).select(*key, "p.info")
    side = lambda p, waits: lock_waits.select(*SNAPSHOT, F.col(f"{p}_pid").alias("pid"), F.struct(F.lit(waits).alias("waits"), F.col(f"{p}_query").alias("query")).alias("e"))
    texts = side("waiting", 1).unionByName(side("blocking", 0)).filter("e.query <> ''").groupBy(*key).agg(F.max("e").alias("e")).select(*key, F.col("e.query").alias("edge_query"))
    rows = tree.unionByName(participants.filter("pid <> 0").select(*key).distinct().join(tree, key, "left_anti"), allowMissingColumns=True)
    rows = rows.join(trx.select(*SNAPSHOT, F.col("pid").alias("root"), F.col("age_s").alias("root_age_s")), [*SNAPSHOT, "root"], "left")
    rows = rows.join(trx, key, "left").join(procs, key, "left").join(texts, key, "left")
    query = F.coalesce(*(F.nullif(c, F.lit("")) for c in ("trx_query", "info", "edge_query")), F.lit(""))
    place = F.row_number().over(Window.partitionBy(*SNAPSHOT).orderBy(F.col("root").isNull(), F.desc_nulls_last("root_age_s"), "root", "path", "pid"))
    return rows.select(*key, place.alias("place"), "depth", "root", "path", F.coalesce("wait_ms", F.lit(0).cast("long")).alias("wait_ms"), "age_s", query.alias("query"))


def top_waiters(lock_waits: DataFrame, shown: int = 5) -> DataFrame:
    """The first waiters of each blocker and how many more there are."""
    by = Window.partitionBy(*SNAPSHOT, "a")
    rows = edges_of(lock_waits).withColumn("place", F.row_number().over(by.orderBy(F.desc("wait_ms"), "b"))).withColumn("more", F.greatest(F.count("*").over(by) - shown, F.lit(0)))
    return rows.filter(F.col("place") <= shown).select(*SNAPSHOT, F.col("a").alias("blocking_pid"), F.col("b").alias("waiting_pid"), "wait_ms", "place", "more")
