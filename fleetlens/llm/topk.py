"""Exact top-k inner products by no-random-access aggregation over sorted component lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetlens.llm.common import landed, shared_path

ROUNDS = (1 / 16, 1 / 4, 1.0)


def sorted_access_topk(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, k: int, floor: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places in ``rows``, scores) of the k best rows of each query, itself left out; ties go to the smaller id.

    Every component has one list of rows sorted by value, read from its high end by queries with a positive component
    and from its low end by those with a negative one. Each round reads all lists down to the next depth. A row's lower
    bound is the sum of what was read of it plus the worst value still possible in each list it was not met in (the
    list's far end); its upper bound takes the value at the reading head instead. A row that was met nowhere is bounded
    by the heads alone. A query stops when no row outside its k best can still reach the k-th lower bound; the rows
    that remain get their final scores. ``floor`` has a score for each query that its k best reach already: rows that
    cannot reach it are outsiders too, and if the list heads alone stay below it, nothing is read for the query.
    All sums are of integers below 2**53, so they are exact."""
    n, dims = rows.shape
    low_first = np.argsort(rows, axis=0, kind="stable")
    rank_low = np.empty((n, dims), np.int64)
    np.put_along_axis(rank_low, low_first, np.arange(n)[:, None], axis=0)
    ordered = np.take_along_axis(rows, low_first, axis=0)
    rank_high = n - 1 - rank_low
    plus, minus = np.maximum(queries, 0), np.minimum(queries, 0)
    worst = plus @ ordered[0] + minus @ ordered[-1]
    floor = np.full(len(queries), -np.inf) if floor is None else floor
    none = np.zeros(0, np.int64), np.zeros(0)
    live = np.flatnonzero(plus @ ordered[-1] + minus @ ordered[0] >= floor)
    lower = np.repeat(worst[:, None], n, axis=1)
    out: list = [none] * len(queries)
    if not len(live):
        return out
    read = 0
    base = rows - ordered[0], rows - ordered[-1]
    for part in ROUNDS:
        depth = min(n, max(k + 1, int(np.ceil(n * part))))
        new_high, new_low = (rank_high >= read) & (rank_high < depth), (rank_low >= read) & (rank_low < depth)
        lower[live] += plus[live] @ np.where(new_high, base[0], 0).T + minus[live] @ np.where(new_low, base[1], 0).T
        read = depth
        gap = plus[live] @ np.where(rank_high < depth, 0, ordered[n - depth] - ordered[0]).T + minus[live] @ np.where(rank_low < depth, 0, ordered[depth - 1] - ordered[-1]).T
        done = np.zeros(len(live), bool)
        for j, q in enumerate(live):
            own = row_ids == query_ids[q]
            sure = np.where(own, -np.inf, lower[q])
            kth = max(floor[q], np.partition(sure, n - k)[n - k] if n > k else -np.inf)
            may = np.flatnonzero((lower[q] + gap[j] >= kth) & ~own)
            if depth == n or len(may) <= max(4 * k, n // 64):
                scores = rows[may] @ queries[q]
                best = np.lexsort((row_ids[may], -scores))[:k]
                out[q] = may[best], scores[best]
                done[j] = True
        live = live[~done]
        if not len(live):
            break
    return out


def _blocks(rows_per_block: int):
    """Pack (id, v) rows into blocks of whole matrices, one output row for each."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        count = 0

        def blocks(end: bool):
            nonlocal held, count
            ids, values = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            at = 0
            while len(ids) - at >= rows_per_block or (end and at < len(ids)):
                to = min(len(ids), at + rows_per_block)
                yield pa.RecordBatch.from_pydict({"dims": pa.array([values.shape[1]], pa.int32()), "ids": [ids[at:to].tobytes()], "vectors": [values[at:to].tobytes()]})
                at = to
            held, count = [(ids[at:], values[at:])], len(ids) - at

        width = None
        for b in batches:
            lists, ids = b.column(1), b.column(0).to_numpy(zero_copy_only=False)
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], np.cumsum(sizes)])
            for d in np.unique(sizes):
                pick = np.flatnonzero(sizes == d)
                if width not in (None, d):
                    if count:
                        yield from blocks(True)
                    held, count = [], 0
                width = d
                held.append((ids[pick], flat[starts[pick][:, None] + np.arange(d)].reshape(len(pick), d)))
                count += len(pick)
                if count >= rows_per_block:
                    yield from blocks(False)
        if count:
            yield from blocks(True)

    return pack


def _search(dims: int, query_ids: np.ndarray, queries: np.ndarray, k: int):
    """The k best rows of each query in a task's blocks; what the best so far reach bounds the search of the next block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, scores = np.full((len(queries), k), np.iinfo(np.int64).max), np.full((len(queries), k), -np.inf)
        wanted = queries.astype(float)
        for b in batches:
            for row in range(b.num_rows):
                if b.column(0)[row].as_py() != dims:
                    continue
                own = np.frombuffer(b.column(1)[row].as_buffer(), np.int64)
                vectors = np.frombuffer(b.column(2)[row].as_buffer(), np.int64).reshape(-1, dims).astype(float)
                for q, (at, found) in enumerate(sorted_access_topk(wanted, query_ids, vectors, own, k, scores[:, -1])):
                    if len(at):
                        all_ids, all_scores = np.concatenate([ids[q], own[at]]), np.concatenate([scores[q], found])
                        best = np.lexsort((all_ids, -all_scores))[:k]
                        ids[q], scores[q] = all_ids[best], all_scores[best]
        q, place = np.nonzero(np.isfinite(scores))
        yield pa.RecordBatch.from_pydict({"query_id": query_ids[q], "vec_id": ids[q, place], "score": scores[q, place].astype(np.int64)})

    return run


def _batches(asked: DataFrame, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimensions, ids, vectors) of at most ``most`` queries each; the driver holds a batch and one partition's blocks."""
    held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    for row in asked.toLocalIterator():
        dims = row["dims"]
        mine = held.setdefault(dims, [])
        mine.append((np.frombuffer(bytes(row["ids"]), np.int64), np.frombuffer(bytes(row["vectors"]), np.int64).reshape(-1, dims)))
        if sum(len(x[0]) for x in mine) > most - most // 4:
            yield dims, np.concatenate([x[0] for x in mine]), np.concatenate([x[1] for x in mine])
            del held[dims]
    for dims, mine in held.items():
        yield dims, np.concatenate([x[0] for x in mine]), np.concatenate([x[1] for x in mine])


def topk_inner_products(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "id", vector_col: str = "v", rows_per_block: int = 8192, queries_per_batch: int = 1024) -> DataFrame:
    """The k rows of highest inner product for every query row, over all rows but the query's own.

    ``vectors`` has a long id and an array<long>. Rows are cut into blocks, which stay where they are; the queries come
    in batches of at most ``queries_per_batch``, each sent to all blocks (so many vectors is all that a task or the
    driver holds of them). A task reads its blocks one after another and carries each query's bound from block to
    block. Within a block the search is exact, so the k best of all tasks are the answer; what is shuffled is k rows a
    query and task. Null ids or vectors take no part; vectors only meet vectors of their own length; an empty table
    gives no rows; a query with fewer than k partners gets all. A repeated id never answers its own query, and repeated
    query rows get one answer. Other columns are ignored. Returns query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    use = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<bigint>").alias("v"), is_query.alias("is_q")).filter("id is not null and v is not null and size(v) > 0 and not exists(v, x -> x is null)")
    schema = "dims int, ids binary, vectors binary"
    data = landed(use.select("id", "v").mapInArrow(_blocks(rows_per_block), schema), "topk-rows")
    asked = landed(use.filter("is_q").select("id", "v").distinct().mapInArrow(_blocks(queries_per_batch // 4), schema), "topk-queries")
    path = shared_path(spark, "topk-found")
    kinds = "query_id long, vec_id long, score long"
    spark.createDataFrame([], kinds).write.parquet(path)
    for dims, ids, batch in _batches(asked, queries_per_batch):
        data.mapInArrow(_search(dims, ids, batch, k), kinds).write.mode("append").parquet(path)
    found = spark.read.schema(kinds).parquet(path)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best partners of every vector whose vec_id is divisible by 50."""
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    sound = "embedding is not null and not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('infinity'))"
    scaled = table.filter(sound).select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * 256)).alias("v"))
    return topk_inner_products(scaled, F.col("id") % 50 == 0, 5, "vec_id", "v")
