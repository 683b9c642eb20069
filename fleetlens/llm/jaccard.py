"""Exact n-gram Jaccard join with vertical partitioning of the global n-gram order."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fleetlens.llm.common import U64, chunks, landed, mixed, released, short_batches, unburdened, utf8, word_hashes
from fleetlens.llm.graph import components

FRAGMENTS = 5
HEAVY_AT_LEAST = 8
HEAVY_MOST = 2**17
TOP = U64(1) << U64(63)


def gram_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(63-bit n-gram hashes, sorted and distinct in each document; first place of each document and the end)."""
    word, doc = word_hashes(data, offsets)
    docs = len(offsets) - 1
    counts = np.bincount(doc, minlength=docs)
    firsts = np.concatenate([[0], np.cumsum(counts)])
    m = max(0, len(word) - n + 1)
    gram, own = np.zeros(m, np.uint64), np.ones(m, bool)
    for k in range(n):
        gram = gram * U64(0x9E3779B97F4A7C15) + word[k : k + m]
    if m:
        own = doc[:m] == doc[n - 1 : n - 1 + m]
    gram, at = mixed(gram[own]), doc[:m][own]
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        whole = np.zeros(len(short), np.uint64)
        for k in range(n - 1):
            has = counts[short] > k
            whole[has] = whole[has] * U64(0x9E3779B97F4A7C15) + word[firsts[short[has]] + k]
        whole = mixed(whole + counts[short].astype(np.uint64))
        gram, at = np.concatenate([gram, whole]), np.concatenate([at, short])
    gram >>= U64(1)
    order = np.lexsort((gram, at))
    gram, at = gram[order], at[order]
    if len(gram):
        new = np.concatenate([[True], (gram[1:] != gram[:-1]) | (at[1:] != at[:-1])])
        gram, at = gram[new], at[new]
    return gram, np.searchsorted(at, np.arange(docs + 1))


def _set_ids(gram: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """One 64-bit id for each distinct set."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(gram * U64(0xD6E8FEB86659FD93) + U64(1)))])
    return mixed((total[firsts[1:]] - total[firsts[:-1]]) * U64(31) + np.diff(firsts).astype(np.uint64)).view(np.int64)


class GlobalOrder:
    """The global order of n-grams: counted and rare ones by hash, then the frequent ones by frequency, then the rest.

    Counted is the part of the hash range that prefixes come from: a prefix has about (100 - percent) % of a set, and
    half as much again covers what frequent n-grams leave free. Frequent n-grams carry the top bit."""

    def __init__(self, percent: int):
        self.counted = np.uint64(min(1.0, 1.5 * (100 - percent) / 100 + 0.03) * 2.0**63)
        self.heavy, self.level = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def with_heavy(self, grams: np.ndarray, counts: np.ndarray) -> GlobalOrder:
        order = np.argsort(grams)
        self.heavy, self.level = grams[order].astype(np.uint64), 1 + np.log2(np.maximum(counts[order], 1)).astype(np.int64)
        return self

    def __call__(self, gram: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(n-grams of each set in the order, their fragments: 0 rare, 1 frequent, then equal ranges of the rest)."""
        level = np.where(gram < self.counted, 0, 100)
        if len(self.heavy):
            at = np.minimum(np.searchsorted(self.heavy, gram), len(self.heavy) - 1)
            known = self.heavy[at] == gram
            level = np.where(known, self.level[at], level)
        doc = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
        order = np.lexsort((gram, level, doc))
        gram, level = gram[order], level[order]
        ranges = (gram >> U64(43)) * U64(FRAGMENTS - 2) >> U64(20)
        part = np.where(level == 0, 0, np.where(level < 100, 1, 2 + ranges.astype(np.int64)))
        return np.where((level > 0) & (level < 100), gram | TOP, gram), part


def _scan_sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = utf8(b.column(1))
            for i, j in chunks(offsets):
                gram, firsts = gram_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], n)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(np.diff(firsts), pa.int64()), pa.array(_set_ids(gram, firsts))], ["id", "n", "sid"])

    return run


def _scan_counts(n: int, most: np.uint64):
    """(g, n): in how many of a batch's texts each n-gram of the counted range occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = utf8(b.column(0))
            grams = [np.zeros(0, np.uint64)]
            for i, j in chunks(offsets):
                gram, _ = gram_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], n)
                grams.append(gram[gram < most])
            value, count = np.unique(np.concatenate(grams), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(value.astype(np.int64)), pa.array(count.astype(np.int32))], ["g", "n"])

    return run


def _scan_prefixes(n: int, percent: int, order: GlobalOrder):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = utf8(b.column(0))
            for i, j in chunks(offsets):
                gram, firsts = gram_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], n)
                sid, size = _set_ids(gram, firsts), np.diff(firsts)
                gram, _ = order(gram, firsts)
                length = np.where(size > 0, size - (percent * size + 99) // 100 + 1, 0)
                take = np.arange(len(gram)) - np.repeat(firsts[:-1], size) < np.repeat(length, size)
                lists = pa.LargeListArray.from_arrays(np.concatenate([[0], np.cumsum(length)]), pa.array(gram[take].view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(sid), pa.array(size, pa.int64()), lists.cast(pa.list_(pa.int64()))], ["sid", "n", "prefix"])

    return run


def _scan_fragments(n: int, order: GlobalOrder):
    """(sid, want, centers, fragment, grams) of the wanted sets; rows that repeat one after another count once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = object(), set()
        for b in batches:
            keys, sids = b.column(0).to_pylist(), b.column(2).to_pylist()
            data, offsets = utf8(b.column(1))
            for i, j in chunks(offsets):
                gram, firsts = gram_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], n)
                sid = _set_ids(gram, firsts)
                gram, part = order(gram, firsts)
                rows, fragments, starts, ends = [], [], [], []
                for d in range(j - i):
                    if keys[i + d] != last:
                        last, seen = keys[i + d], set()
                    if sids[i + d] != sid[d] or sid[d] in seen:
                        continue
                    seen.add(sid[d])
                    at, to = firsts[d], firsts[d + 1]
                    cuts = at + np.searchsorted(part[at:to], np.arange(FRAGMENTS + 1))
                    rows += [i + d] * FRAGMENTS
                    fragments += range(FRAGMENTS)
                    starts += cuts[:-1].tolist()
                    ends += cuts[1:].tolist()
                if not rows:
                    continue
                grams = pa.array([gram[s:e].view(np.int64) for s, e in zip(starts, ends, strict=True)], pa.list_(pa.int64()))
                pick = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(2).take(pick), b.column(3).take(pick), b.column(4).take(pick), pa.array(fragments, pa.int32()), grams], ["sid", "center", "centers", "fragment", "grams"])

    return run


def _by_fragment(texts: DataFrame, keys: DataFrame, pairs: DataFrame, n: int, order: GlobalOrder) -> DataFrame:
    """(a, b, fragment, grams of b, center_grams of a) for every pair (a, b) and fragment of the global order."""
    members = pairs.groupBy(F.col("b").alias("sid")).agg(F.collect_set("a").alias("centers"))
    centers = pairs.select(F.col("a").alias("sid")).distinct().withColumn("center", F.lit(True))
    want = members.join(centers, "sid", "full").join(keys, "sid").select("key", "sid", F.coalesce("center", F.lit(False)).alias("center"), F.coalesce("centers", F.array().cast("array<bigint>")).alias("centers"))
    held = texts.join(want.hint("merge"), "key").select("key", "text", "sid", "center", "centers")
    fragments = held.mapInArrow(unburdened(_scan_fragments(n, order)), "sid long, center boolean, centers array<long>, fragment int, grams array<long>")
    left = fragments.select(F.explode("centers").alias("a"), F.col("sid").alias("b"), "fragment", "grams")
    right = fragments.filter("center").select(F.col("sid").alias("a"), "fragment", F.col("grams").alias("center_grams"))
    return left.join(right.hint("merge"), ["a", "fragment"])


def _overlaps(texts: DataFrame, keys: DataFrame, pairs: DataFrame, n: int, order: GlobalOrder) -> DataFrame:
    """pairs with their overlap: counted fragment by fragment and summed."""
    partial = _by_fragment(texts, keys, pairs, n, order).select("a", "b", F.size(F.array_intersect("grams", "center_grams")).alias("overlap"))
    return pairs.join(partial.groupBy("a", "b").agg(F.sum("overlap").alias("overlap")), ["a", "b"])


def _cousins(crowd: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between nodes of one hub and different components, which join all such components that are linked.

    ``crowd`` has hub a, node b, its size nb, its label and the hub's (main), and the n-grams that either of a and b
    has alone (apart). What two nodes share of these gives their exact overlap, so no text is read again. In each group
    of nodes with one rare difference all are first held against one of them, the second hub, round by round while that
    joins components; only what is then still of different components meets pairwise."""
    apart_at_most = lambda m, n: F.floor((m + n) * (100 - percent) / (100 + percent))
    each = crowd.select("a", "b", "nb", F.size("apart").alias("d"), F.explode("apart").alias("g"))
    often = each.groupBy("a", "g").agg(F.count("*").alias("often")).filter("often > 1")
    rarest = F.row_number().over(Window.partitionBy("a", "b").orderBy("often", "g"))
    most = apart_at_most(F.col("nb"), F.floor(F.col("nb") * 100 / percent)) + 1
    rare = landed(each.join(often, ["a", "g"], "left").withColumn("place", rarest).filter((F.col("place") <= most) & F.col("often").isNotNull()).drop("often"), "rare")
    labels = landed(crowd.select("a", "b", "label", "main"), "crowd-labels")
    names = ("b", "nb", "d", "place", "label")
    side = lambda rows, s: rows.withColumnsRenamed({c: f"{c}_{s}" for c in names})
    enough = 2 * (1 + F.least(F.col("d_x") - F.col("place_x"), F.col("d_y") - F.col("place_y"))) >= F.col("d_x") + F.col("d_y") - apart_at_most(F.col("nb_x"), F.col("nb_y"))
    fit = (F.col("label_x") != F.col("label_y")) & (100 * F.least("nb_x", "nb_y") >= percent * F.greatest("nb_x", "nb_y")) & enough

    def linked(pairs: DataFrame) -> DataFrame:
        pairs = pairs.select("b_x", "b_y", "nb_x", "nb_y", "label_x", "label_y").distinct()
        own = lambda s: crowd.select(F.col("b").alias(f"b_{s}"), F.col("apart").alias(f"apart_{s}"))
        both = pairs.join(own("x"), "b_x").join(own("y"), "b_y")
        differ = F.size("apart_x") + F.size("apart_y") - 2 * F.size(F.array_intersect("apart_x", "apart_y"))
        total = F.col("nb_x") + F.col("nb_y")
        return both.filter((100 + percent) * (total - differ) >= 2 * percent * total).select(F.col("b_x").alias("a"), F.col("b_y").alias("b"), "label_x", "label_y")

    links = []
    while True:
        at = rare.join(labels, ["a", "b"])
        mixed_groups = at.groupBy("a", "g").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("a", "g")
        live = landed(at.join(mixed_groups, ["a", "g"]), "crowd-live")
        second = live.groupBy("a", "g").agg(F.min(F.struct(F.col("d").alias("near"), F.col("place").alias("early"), *names)).alias("hub")).select("a", "g", *(F.col(f"hub.{c}").alias(f"{c}_y") for c in names))
        got = landed(linked(side(live.drop("main"), "x").join(second, ["a", "g"]).filter(fit)), "cousins")
        before = live.select("label").distinct().count()
        if not got.limit(1).count():
            break
        links.append(got.select("a", "b"))
        joined = landed(components(got, "label_x", "label_y").select(F.col("node").alias("label"), F.col("label").alias("to")), "joined-labels")
        for c in ("label", "main"):
            labels = labels.join(joined.withColumnRenamed("label", c), c, "left").withColumn(c, F.coalesce("to", c)).drop("to")
        labels = landed(labels.select("a", "b", "label", "main"), "crowd-labels")
        if 10 * joined.filter("label <> to").count() < before:
            live = landed(rare.join(labels, ["a", "b"]), "crowd-live")
            break
    minor = side(live.filter("label <> main").drop("main"), "x")
    major = F.col("label_y") == F.col("main")
    rest = linked(minor.join(side(live, "y"), ["a", "g"]).filter(fit & (major | (F.col("b_x") < F.col("b_y")))))
    return reduce(DataFrame.unionByName, links, rest.select("a", "b"))


def jaccard_components(docs: DataFrame, n: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles and component_id of every row: the components of links 100 * intersection >= percent * union.

    A set is the distinct word n-grams (ASCII lower case, words between white-space bytes); with fewer words it is the
    whole sequence as one n-gram, without words or text it is empty and linked with nothing. N-grams are 63-bit hashes.

    1. Rows of equal sets are one node. 2. The global order of n-grams has rare ones first; the HEAVY_MOST most
    frequent ones are known by their exact counts over all texts (see GlobalOrder). 3. Nodes that reach the threshold share an n-gram of their prefixes in that order, and share more of
    them the longer the prefixes are (see `slack`). Each n-gram's nodes are first paired with its hub only: the node whose prefix is shared most (the
    original of near copies, as a rule). Each node is checked against the hub of highest rank that it is like; what is linked so
    becomes components. 4. Two nodes x and y of one hub h that are in different components: one, say x, does not reach
    the threshold with h. If both share nothing of what sets them apart from h (n-grams of h that both lack, n-grams
    of both that h lacks), J(x, y) <= J(x, h), so they are not linked. What sets x and y apart is the symmetric
    difference of these two sets of differences, and linked nodes differ in at most n (1 - t) / t n-grams; so linked
    nodes share one of that many, and one more, of each node's rarest differences, at places that leave enough. Groups
    of nodes with one such difference get a second hub each, as in step 3 (see `_cousins`). 5. Pairs of different hubs and components
    that share prefix n-grams and fit are checked like step 3. So no link between components is lost, while a group of
    m near copies costs m pairs and not m * m. 6. Pairs are checked by vertical partitioning: the order is cut into
    fragments, each fragment's overlap is counted by itself and the counts are summed.

    Null ids are rows like any other (component_id null if no linked row has an id); repeated ids and rows are
    allowed; component_id is the smallest id reached. Other columns are ignored. An empty table gives no rows."""
    spark = docs.sparkSession
    short_batches(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = landed(texts.mapInArrow(unburdened(_scan_sets(n)), "id long, n long, sid long"), "sets")
    order = GlobalOrder(percent)
    often = texts.select("text").mapInArrow(unburdened(_scan_counts(n, order.counted)), "g long, n int").groupBy("g").agg(F.sum("n").alias("n")).filter(F.col("n") >= HEAVY_AT_LEAST).orderBy(F.desc("n"), "g").limit(HEAVY_MOST)
    often = landed(often, "frequent")  # a collected plan would keep its shuffle's files
    frequent = often.toPandas()  # at most HEAVY_MOST pairs of numbers
    order.with_heavy(frequent["g"].to_numpy(np.int64), frequent["n"].to_numpy(np.int64))
    released(spark, often)  # here and below: the disk need not have the shuffles of two steps at a time

    length = lambda c: F.col(c) - F.floor((percent * F.col(c) + 99) / 100).cast("long") + 1
    prefixes = texts.select("text").mapInArrow(unburdened(_scan_prefixes(n, percent, order)), "sid long, n long, prefix array<long>").filter("n > 0").dropDuplicates(["sid"])
    grams = prefixes.select("sid", "n", F.posexplode("prefix").alias("place", "g"))
    light, heavy = grams.filter("g >= 0"), landed(grams.filter("g < 0"), "heavy")
    released(spark)
    light = light.withColumn("size", F.count("*").over(Window.partitionBy("g"))).filter("size > 1")
    sizes = heavy.groupBy("g").agg(F.count("*").alias("size")).filter("size > 1")
    common = heavy.join(F.broadcast(sizes), "g")  # one row for each of at most HEAVY_MOST n-grams
    shared = landed(light.unionByName(common.select(*light.columns)), "shared")
    released(spark, heavy)
    rank = shared.groupBy("sid", "n").agg(F.sum("size").alias("rank")).select("sid", (F.col("rank") / length("n")).alias("rank"))
    hubs = shared.join(rank, "sid").groupBy("g").agg(F.max(F.struct("rank", "sid", "n")).alias("hub"))

    required = lambda m, n: F.floor((percent * (m + n) + 99 + percent) / (100 + percent)).cast("long")

    def slack(m: Column, n: Column) -> Column:
        """Two sets of these sizes that reach the threshold share one n-gram of their first size - required + 1, and
        k + 1 of their first size - required + 1 + k; a third of what the longer prefix has beyond that is taken as k."""
        longest = F.greatest(m - F.floor((percent * m + 99) / 100), n - F.floor((percent * n + 99) / 100))
        return F.floor(F.greatest(longest - F.greatest(m, n) + required(m, n), F.lit(0)) / 3).cast("long")

    def early(place: str, size: str, other: str) -> Column:
        m, n = F.col(size), F.col(other)
        return F.col(place) <= m - required(m, n) + slack(m, n)

    key = F.coalesce(F.col("id"), F.xxhash64("text"))
    nodes = rows.filter("n > 0 and id is not null").groupBy("sid").agg(F.min("id").alias("key"))
    if rows.filter("id is null and n > 0").limit(1).count():
        nodes = texts.select(key.alias("id"), "text").mapInArrow(unburdened(_scan_sets(n)), "id long, n long, sid long").filter("n > 0").groupBy("sid").agg(F.min("id").alias("key"))
    keyed = texts.select(key.alias("key"), "text")

    star = shared.join(hubs, "g").filter("sid <> hub.sid").groupBy(F.col("hub.sid").alias("a"), F.col("sid").alias("b"), F.col("hub.n").alias("na"), F.col("n").alias("nb")).agg(F.count("*").alias("met"), F.max("hub.rank").alias("rank"))
    star = star.filter((4 * F.col("met") >= F.least(length("na"), length("nb"))) & (2 * F.least("na", "nb") >= F.greatest("na", "nb")))
    star = star.withColumn("like", F.floor(4 * F.col("met") / F.least(length("na"), length("nb"))))
    star = landed(star.groupBy("b").agg(F.max(F.struct("like", "rank", F.col("a"), "na", "nb")).alias("best")).select("best.a", "b", "best.na", "best.nb"), "pairs")
    released(spark)
    linked = (100 + percent) * F.col("overlap") >= percent * (F.col("na") + F.col("nb"))
    checked = star
    star = landed(_overlaps(keyed, nodes, checked, n, order).filter(2 * F.col("overlap") >= F.greatest("na", "nb")), "star")
    released(spark, checked)
    links = landed(star.filter(linked).select("a", "b"), "links")
    found = components(links).withColumnRenamed("node", "sid")

    # pairs of one hub, by what sets them apart from it
    here = star.join(found.withColumnRenamed("sid", "b"), "b", "left").withColumn("label", F.coalesce("label", "b"))
    here = here.join(found.select(F.col("sid").alias("a"), F.col("label").alias("main")), "a", "left").withColumn("main", F.coalesce("main", "a"))
    loose = here.filter("label <> main").select("a").distinct()
    crowd = here.join(loose, "a").select("a", "b", "nb", "label", "main")
    apart = F.concat(F.array_except("center_grams", "grams"), F.array_except("grams", "center_grams"))
    apart = _by_fragment(keyed, nodes, crowd.select("a", "b"), n, order).groupBy("a", "b").agg(F.flatten(F.collect_list(apart)).alias("apart"))
    crowd = landed(crowd.join(apart, ["a", "b"]), "crowd")
    released(spark)
    cousins = landed(_cousins(crowd, percent), "links")
    released(spark, crowd)
    if cousins.limit(1).count():
        links = landed(links.unionByName(cousins), "links")
        found = components(links).withColumnRenamed("node", "sid")

    # pairs of different hubs, by the prefix n-grams they share
    hub_of = star.select(F.col("b").alias("sid"), F.col("a").alias("hub"))
    placed = shared.join(found, "sid", "left").join(hub_of, "sid", "left").withColumn("label", F.coalesce("label", "sid")).withColumn("hub", F.coalesce("hub", "sid"))
    parts = placed.groupBy("g", "label").agg(F.count("*").alias("size"), F.min("hub").alias("low"), F.max("hub").alias("high"))
    split = parts.groupBy("g").agg(F.max_by("label", F.struct("size", "label")).alias("main"), F.count("*").alias("parts"), F.min("low").alias("low"), F.max("high").alias("high")).filter("parts > 1 and low <> high").select("g", "main")
    open_rows = landed(placed.join(split, "g"), "open")
    released(spark, shared, star)
    minor = open_rows.filter("label <> main").select("g", F.col("sid").alias("x"), F.col("n").alias("nx"), F.col("label").alias("lx"), F.col("hub").alias("hx"), F.col("place").alias("px"))
    pairs = minor.join(open_rows.select("g", "sid", "n", "label", "hub", "place", (F.col("label") == F.col("main")).alias("major")), "g")
    like = (100 * F.least("nx", "n") >= percent * F.greatest("nx", "n")) & early("px", "nx", "n") & early("place", "n", "nx")
    pairs = pairs.filter((F.col("lx") != F.col("label")) & (F.col("hx") != F.col("hub")) & (F.col("major") | (F.col("x") < F.col("sid"))) & like)
    first = F.col("x") < F.col("sid")
    pairs = pairs.select(F.least("x", "sid").alias("a"), F.greatest("x", "sid").alias("b"), F.when(first, F.col("nx")).otherwise(F.col("n")).alias("na"), F.when(first, F.col("n")).otherwise(F.col("nx")).alias("nb"))
    enough = F.col("met") >= slack(F.col("na"), F.col("nb")) + 1
    remaining = landed(pairs.groupBy("a", "b", "na", "nb").agg(F.count("*").alias("met")).filter(enough).select("a", "b", "na", "nb"), "pairs")
    released(spark, open_rows)
    more = landed(_overlaps(keyed, nodes, remaining, n, order).filter(linked).select("a", "b"), "links")
    released(spark, remaining)
    if more.limit(1).count():
        found = components(links.unionByName(more)).withColumnRenamed("node", "sid")

    least = rows.filter("n > 0").groupBy("sid").agg(F.min("id").alias("first"), F.count("*").alias("copies")).join(found, "sid", "left")
    least = least.filter("copies > 1 or label is not null").withColumn("label", F.coalesce("label", "sid"))
    smallest = least.groupBy("label").agg(F.min("first").alias("component_id"))
    to = least.join(smallest, "label").select("sid", "component_id")
    out = rows.select("id", "n", F.when(F.col("n") > 0, F.col("sid")).alias("sid")).join(to, "sid", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set sizes and components of all documents at 3 words and 0.9; nulls, repeats and empty tables as in `jaccard_components`."""
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), 3, 90)
