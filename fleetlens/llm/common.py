"""Helpers shared by the training-data operators: shared tables, Arrow byte views and vectorised string hashes."""

from __future__ import annotations

import atexit
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Hashable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

CHUNK_BYTES = 500_000
U64 = np.uint64


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor shares: ``spark.checkpoint.dir``; a temporary one is set only where none is and one machine
    does all the work (tests). A cluster has to name one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="fleetlens-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver's Python ends."""
    path = f"{shared_dir(spark)}/fleetlens-{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session may be gone already; the folder is scratch space
        pass


def landed(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as Parquet in the shared folder and read it back."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.landed_at = path
    return out


def released(spark: SparkSession, *tables: DataFrame) -> None:
    """Remove landed tables that nothing reads any more, and let Spark drop the shuffle files of finished jobs: it does
    so when the driver's JVM collects their owners, which else may not happen before the disks are full."""
    for t in tables:
        _remove(spark, t.landed_at)
    spark._jvm.System.gc()


def short_batches(spark: SparkSession, rows: int = 2_000) -> None:
    """Arrow batches of at most ``rows`` rows in this session: texts are long, and both sides hold a batch whole."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


_held: dict = {}


def held[T](key: Hashable, make: Callable[[], T]) -> T:
    """What a Python worker keeps from task to task, made when it is first asked for; one thing at a time."""
    if key not in _held:
        let_go()
        _held[key] = make()
    return _held[key]


def let_go() -> None:
    """Free what this Python worker keeps."""
    if _held:
        _held.clear()
        gc.collect()  # parts of a model may know each other
        pa.default_memory_pool().release_unused()


def unburdened(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run`` in a worker that keeps nothing: Spark hands workers on from stage to stage, with all that they keep."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        yield from run(batches)

    return scan


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes each; a longer row is alone."""
    n, at = len(offsets) - 1, 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        to = min(n, max(at + 1, to))
        yield at, to
        at = to


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that every output bit depends on every input bit."""
    x = x ^ (x >> U64(31))
    x = x * U64(0x7FB5D329728EA185)
    x = x ^ (x >> U64(27))
    x = x * U64(0x81DADEF4BC2DD44D)
    return x ^ (x >> U64(33))


class SpanHash:
    """64-bit hashes of any spans of a byte array, from one running sum.

    Each byte stands for a random 64-bit value (64-bit items, as hashes of words, for themselves) and each place for a
    power of an odd base modulo 2**64, so a span's hash is a difference of two running sums times an inverse power."""

    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, data: np.ndarray, seed: int = 1):
        rng = np.random.default_rng(seed)
        table = rng.integers(0, 2**64, 256, dtype=np.uint64)
        base = int(rng.integers(2**61, 2**63)) * 2 + 1
        n = len(data) + 1
        held = self._powers.get(seed)
        if held is None or len(held[0]) < n:
            size = max(n, CHUNK_BYTES + 2)
            up, down = np.full(size, base % 2**64, np.uint64), np.full(size, pow(base, -1, 2**64), np.uint64)
            up[0] = down[0] = 1
            held = (np.multiply.accumulate(up), np.multiply.accumulate(down))
            if size <= 8 * CHUNK_BYTES:
                self._powers[seed] = held
        self._inverse = held[1]
        self._sums = np.zeros(n, np.uint64)
        np.cumsum((data if data.dtype == np.uint64 else table[data]) * held[0][: n - 1], out=self._sums[1:])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self._sums[end] - self._sums[start]) * self._inverse[start])

    def windows(self, width: int) -> np.ndarray:
        """The unmixed hashes of all spans of one width."""
        n = len(self._sums) - width
        if n <= 0:
            return np.zeros(0, np.uint64)
        return (self._sums[width:] - self._sums[:n]) * self._inverse[:n]


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of every run of non-space bytes that does not cross a document's end."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    word = ~SPACE[data]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    inner = offsets[1:-1][offsets[1:-1] < len(data)]
    begins[inner] = word[inner]
    ends = word.copy()
    ends[:-1] &= ~word[1:]
    last = inner - 1
    last = last[last >= 0]
    ends[last] = word[last]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of each word, A-Z lower-cased."""
    start, end, doc = word_spans(data, offsets)
    if not len(start):
        return np.zeros(0, np.uint64), doc
    return SpanHash(LOWER[data]).spans(start, end), doc
