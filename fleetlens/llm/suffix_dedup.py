"""Removal of long passages that occur more than once, by column-wise construction of sorted suffix columns."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm.common import CHUNK_BYTES, SPACE, U64, SpanHash, chunks, landed, mixed, released, short_batches, unburdened, utf8, word_spans

MIN_BYTES = 400
PASSAGE_WORDS = 51
PIECE = 1_000_000
PLACE_BITS = 24
ROUND_ROWS = 20_000
HOT_PARTS = 20_000
FILLED = 4096
BYTE, WORD = "byte", "word"


def symbols(data: np.ndarray, offsets: np.ndarray, unit: str) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, offsets) of texts: their bytes, or a 64-bit hash of each run of bytes that are no white space."""
    if unit == BYTE:
        return data, offsets
    values, docs, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    while at < len(data):  # one piece, but for a very long text
        end = min(len(data), at + 2 * CHUNK_BYTES)
        if end < len(data):  # cut at white space; a longer word stays whole
            space = np.flatnonzero(SPACE[data[at:end]])
            end = at + int(space[-1]) + 1 if len(space) else end + int(np.argmax(SPACE[data[end:]])) if SPACE[data[end:]].any() else len(data)
        inner = np.clip(offsets, at, end) - at
        start, stop, doc = word_spans(data[at:end], inner)
        if len(start):
            values.append(SpanHash(data[at:end], 2).spans(start, stop))
            docs.append(doc)
        at = end
    return np.concatenate(values), np.searchsorted(np.concatenate(docs), np.arange(len(offsets)))


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    out = x
    while size * 2 <= width:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    return np.minimum(out[: len(x) - width + 1], out[width - size : len(x) - size + 1]) if size < width else out


def anchored_runs(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(document, first start, number of further starts, anchor's place, anchor's hash, two hashes of the fragment).

    Every window of ``length`` symbols has as anchor its leftmost substring of ``length // 3`` symbols with the least
    hash, so equal windows have equal anchors at equal distances. A run is of consecutive window starts with one
    anchor; its fragment is all symbols of its windows."""
    core = max(1, length // 3)
    none = (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),) * 3
    n = len(data)
    if n < length:
        return none
    one, two = SpanHash(data, 1), SpanHash(data, 2)
    h = mixed(one.windows(core))
    low = U64((1 << PLACE_BITS) - 1)
    least = _sliding_min((h & ~low) | np.arange(len(h), dtype=np.uint64), length - core + 1)
    place = (least & low).astype(np.int64)
    edge = np.zeros(n + 1, np.int8)
    long = np.flatnonzero(np.diff(offsets) >= length)
    edge[offsets[long]] += 1
    edge[offsets[long + 1] - length + 1] -= 1
    valid = np.cumsum(edge[: len(place)], dtype=np.int8).astype(bool)
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (place[1:] != place[:-1])
    # a document of exactly ``length`` symbols may be next to another one's first window
    new[offsets[long]] = True
    start = np.flatnonzero(new)
    if not len(start):
        return none
    closes = np.flatnonzero(valid & np.concatenate([new[1:] | ~valid[1:], [True]]))
    doc = np.searchsorted(offsets, start, "right") - 1
    end = closes + length
    return doc, start, closes - start, place[start], h[place[start]], one.spans(start, end), two.spans(start, end)


def _scan(length: int, unit: str):
    names = ["k1", "k2", "start", "width", "off", "anchor", "f1", "f2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = utf8(b.column(2))
            k1, k2 = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
            for i, j in chunks(offsets):
                part, own = symbols(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], unit)
                pieces = [(part, own, 0)]
                if j == i + 1 and len(part) > PIECE:  # a longer text goes in overlapping pieces: a cut only splits runs
                    pieces = [(part[at : at + PIECE + length - 1], np.array([0, len(part[at : at + PIECE + length - 1])]), at) for at in range(0, len(part) - length + 1, PIECE)]
                for values, offs, base in pieces:
                    doc, start, width, place, anchor, f1, f2 = anchored_runs(values, offs, length)
                    if len(doc):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(k1[i + doc]), pa.array(k2[i + doc]), pa.array(start - offs[doc] + base), pa.array(width.astype(np.int32)), pa.array((place - start).astype(np.int32)), *(pa.array(x.view(np.int64)) for x in (anchor, f1, f2))], names
                        )

    return run


def column_round(column: np.ndarray, order: np.ndarray, prefix: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Insert one symbol per document in front of its suffix: the suffixes' new order and their common prefixes.

    ``order`` has the documents by suffix, group after group; ``prefix[i]`` is the length of the common prefix of the
    suffixes at places i - 1 and i. The inserted symbols in that order are this round's part of the collection's
    Burrows-Wheeler transform. A stable sort of it keeps equal symbols in suffix order, so two neighbours of one symbol
    share one symbol more than the least common prefix between their old places."""
    bwt = column[order]
    by = np.argsort(bwt, kind="stable")
    by = by[np.argsort(group[by], kind="stable")]
    bwt = bwt[by]
    same = np.flatnonzero((bwt[1:] == bwt[:-1]) & (group[1:] == group[:-1])) + 1
    out = np.zeros(len(prefix), np.int32)
    if len(same):
        ranges = np.stack([by[same - 1] + 1, by[same] + 1], 1).ravel()
        out[same] = np.minimum.reduceat(prefix, ranges)[::2] + 1
    return order[by], out


def _columns(fragments: list[np.ndarray], off: np.ndarray, left: int, right: int) -> np.ndarray:
    """The fragments side by side, one row per distance from their anchors; what lies outside one is padding."""
    kinds = 256 if fragments[0].dtype == np.uint8 else 0
    if not kinds:  # words: small numbers for the hashes
        sizes = np.cumsum([len(f) for f in fragments])[:-1]
        values, ids = np.unique(np.concatenate(fragments), return_inverse=True)
        kinds, fragments = len(values), np.split(ids, sizes)
    columns = np.empty((left + right, len(fragments)), np.uint16 if kinds < 2**16 - 2 else np.int32)
    for at in range(0, len(fragments), FILLED):
        rows = np.full((min(FILLED, len(fragments) - at), left + right), kinds, columns.dtype)
        for i, fragment in enumerate(fragments[at : at + FILLED]):
            first = left - int(off[at + i])
            rows[i, :first] = kinds + 1
            rows[i, first : first + len(fragment)] = fragment
        columns[:, at : at + FILLED] = rows.T
    return columns


def repeated_starts(group: np.ndarray, off: np.ndarray, width: np.ndarray, fragments: list[np.ndarray], length: int) -> tuple[np.ndarray, np.ndarray]:
    """(fragment, start) of every start whose ``length`` symbols also start in another fragment of its group.

    The fragments of a group are aligned at their anchor: a string can only equal another at the same distance from
    it, so each column's suffixes need comparing with each other alone. The columns are read once, from the last to the
    first, one symbol per document and round. A fragment has less than 2 * length symbols, so a round over ROUND_ROWS
    fragments of 400-byte windows holds about 40 MB."""
    n = len(fragments)
    left, right = int(off.max()), int((width + length - off).max())
    columns = _columns(fragments, off, left, right)
    order, prefix = np.arange(n), np.zeros(n + 1, np.int32)
    slim = np.cumsum(np.concatenate([[0], group[1:] != group[:-1]]))
    slim = slim.astype(np.uint16 if slim[-1] < 65536 else np.int64)
    found_at, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for c in range(left + right - 1, -1, -1):
        order, prefix = column_round(columns[c], order, prefix, slim)
        if c > left + right - length:
            continue
        hit = prefix >= length
        at = order[np.flatnonzero(hit[:-1] | hit[1:])]
        start = c - left + off[at]
        ok = (start >= 0) & (start <= width[at])
        found_at.append(at[ok])
        found.append(start[ok])
    return np.concatenate(found_at), np.concatenate(found)


def _runs(at: np.ndarray, start: np.ndarray, n: int) -> list[list[dict]]:
    out: list[list[dict]] = [[] for _ in range(n)]
    if len(at):
        order = np.lexsort((start, at))
        at, start = at[order], start[order]
        new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)]))
        last = np.append(new[1:], len(at)) - 1
        for i, s, e in zip(at[new].tolist(), start[new].tolist(), start[last].tolist(), strict=True):
            out[i].append({"first": s, "last": e})
    return out


def _sort_columns(length: int, unit: str):
    """Whole anchor groups, sorted by anchor, gathered into rounds of about ROUND_ROWS fragments."""
    kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))

    def done(b: pa.RecordBatch) -> pa.RecordBatch:
        group, off, width = (b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 3, 4))
        fragments = [np.frombuffer(x.as_buffer(), np.uint8 if unit == BYTE else np.uint64) for x in b.column(5)]
        at, start = repeated_starts(group, off, width, fragments, length)
        return pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array(_runs(at, start, b.num_rows), kind)], ["f1", "f2", "runs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) < ROUND_ROWS:
                continue
            whole = pa.Table.from_batches(held).combine_chunks()
            anchors = whole.column(0).to_numpy()
            cut = int(np.searchsorted(anchors, anchors[-1]))
            if cut:
                yield done(whole.slice(0, cut).combine_chunks().to_batches()[0])
            held = whole.slice(cut).to_batches()
        if held and sum(x.num_rows for x in held):
            yield done(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    return run


def _wanted(b: pa.RecordBatch, last: list[tuple], unit: str) -> Iterator[tuple[np.ndarray, list[dict]]]:
    """(symbols, wanted fragments) of the rows (k1, k2, text, wanted), sorted by key; a text that comes again is left out."""
    for i in range(b.num_rows):
        key = b.column(0)[i].as_py(), b.column(1)[i].as_py()
        if key != last[0]:
            last[0] = key
            yield symbols(*utf8(b.column(2).slice(i, 1)), unit)[0], b.column(3)[i].as_py()


def _cut(unit: str):
    """The wanted fragments' symbols."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = [()]
        for b in batches:
            rows, size = [], 0
            for values, wanted in _wanted(b, last, unit):
                for w in wanted:
                    rows.append({k: w[k] for k in ("anchor", "f1", "f2", "off", "width")} | {"bytes": values[w["start"] : w["start"] + w["size"]].tobytes()})
                    size += len(rows[-1]["bytes"])
                if size > 4_000_000:
                    yield pa.RecordBatch.from_pylist(rows, _FRAGMENT)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, _FRAGMENT)

    return run


def _hot_windows(length: int, unit: str):
    """Every window of the wanted fragments, by two hashes."""
    names = ["h1", "h2", "f1", "f2", "n", "start"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = [()]
        for b in batches:
            for values, wanted in _wanted(b, last, unit):
                for w in wanted:
                    own = values[w["start"] : w["start"] + w["size"]]
                    start = np.arange(w["width"] + 1)
                    h = [pa.array(SpanHash(own, seed).spans(start, start + length).view(np.int64)) for seed in (1, 2)]
                    yield pa.RecordBatch.from_arrays([*h, *(pa.array(np.full(len(start), w[k], np.int64)) for k in ("f1", "f2", "n")), pa.array(start.astype(np.int32))], names)

    return run


def _hot_runs(held: DataFrame, length: int, unit: str) -> DataFrame:
    """(f1, f2, runs) of the fragments of anchors that have too many for one task: windows are dealt out by their hashes.

    All windows of a fragment hold its anchor, so its repeated ones cover one span, given as one run."""
    windows = landed(held.mapInArrow(unburdened(_hot_windows(length, unit)), "h1 long, h2 long, f1 long, f2 long, n long, start int"), "hot-windows")
    again = landed(windows.groupBy("h1", "h2").agg(F.sum("n").alias("n")).filter("n > 1").select("h1", "h2"), "hot-repeats")
    found = windows.filter("n = 1").join(again, ["h1", "h2"]).groupBy("f1", "f2").agg(F.min("start").alias("first"), F.max("start").alias("last"))
    return found.select("f1", "f2", F.array(F.struct("first", "last")).alias("runs"))


_FRAGMENT = pa.schema([("anchor", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("off", pa.int32()), ("width", pa.int32()), ("bytes", pa.binary())])


def repeated_spans(texts: DataFrame, length: int, unit: str = BYTE) -> DataFrame:
    """(k1, k2, spans) of the texts (k1, k2, text) with symbols covered by ``length`` symbols that start elsewhere too.
    Spans count in symbols: bytes, or words between white space.

    1. Windows are grouped by anchor; an anchor that occurs once has no repeated window. 2. Equal fragments are one
    document of the collection with a count; a fragment that occurs twice is repeated as a whole. 3. The other
    fragments of an anchor are compared by the column rounds, those of an anchor with more than HOT_PARTS by the hashes
    of their windows. 4. Repeated starts go back to all places of a fragment."""
    # scanned twice: what a scan finds is half the input's size, more than the shuffle that both uses need
    found = texts.mapInArrow(unburdened(_scan(length, unit)), "k1 long, k2 long, start long, width int, off int, anchor long, f1 long, f2 long")
    # landed, so that the join has a shuffle on either side and a hot anchor's rows can be dealt out
    twice = landed(found.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor"), "repeated-anchors")
    shared = landed(found.join(twice, "anchor"), "shared-anchors")
    released(texts.sparkSession, twice)
    distinct = landed(
        shared.groupBy("anchor", "f1", "f2").agg(F.count("*").alias("n"), F.min("off").alias("off"), F.min("width").alias("width"), F.min(F.struct("k1", "k2", "start")).alias("at")), "fragments"
    )
    groups = landed(distinct.groupBy("anchor").agg(F.count("*").alias("parts"), F.min("n").alias("least")).filter("parts > 1 and least = 1"), "anchor-groups")
    released(texts.sparkSession)
    hot = F.col("parts") > HOT_PARTS

    def held(anchors: DataFrame) -> DataFrame:
        compared = distinct.join(anchors.select("anchor"), "anchor")
        wanted = compared.groupBy("at.k1", "at.k2").agg(F.collect_list(F.struct("anchor", "f1", "f2", "n", "off", "width", F.col("at.start").alias("start"), (F.col("width") + length).alias("size"))).alias("wanted"))
        return texts.join(wanted.hint("merge"), ["k1", "k2"]).select("k1", "k2", "text", "wanted")

    cut = landed(held(groups.filter(~hot)).mapInArrow(unburdened(_cut(unit)), "anchor long, f1 long, f2 long, off int, width int, bytes binary"), "fragment-texts")
    released(texts.sparkSession)
    fragments = cut.repartition("anchor").sortWithinPartitions("anchor", "f1", "f2").select("anchor", "f1", "f2", "off", "width", "bytes")
    runs = fragments.mapInArrow(unburdened(_sort_columns(length, unit)), "f1 long, f2 long, runs array<struct<first: int, last: int>>").filter("size(runs) > 0")
    if groups.filter(hot).limit(1).count():
        runs = runs.unionByName(_hot_runs(held(groups.filter(hot)), length, unit))
    runs = runs.groupBy("f1", "f2").agg(F.max("runs").alias("runs"))
    whole = F.array(F.struct(F.lit(0).alias("first"), F.col("width").alias("last")))
    repeated = distinct.select("f1", "f2", "n", "width").join(runs, ["f1", "f2"], "left")
    # landed, so that a hot fragment's places can be dealt out
    repeated = landed(repeated.select("f1", "f2", F.when(F.col("n") > 1, whole).otherwise(F.col("runs")).alias("runs")).filter("runs is not null"), "repeated-fragments")
    places = shared.select("k1", "k2", "start", "f1", "f2").distinct().join(repeated, ["f1", "f2"]).select("k1", "k2", "start", F.explode("runs").alias("run"))
    spans = places.select("k1", "k2", (F.col("start") + F.col("run.first")).alias("first"), (F.col("start") + F.col("run.last") + length).alias("end"))
    out = landed(spans.groupBy("k1", "k2").agg(F.collect_list(F.struct("first", "end")).alias("spans")), "spans")
    released(texts.sparkSession, shared, distinct, groups, cut, repeated)
    return out


def merged(text: bytes, spans: list[dict] | None, unit: str) -> list[list[int]]:
    """The maximal runs of bytes that the spans cover."""
    pairs = sorted((x["first"], x["end"]) for x in spans or ())
    if pairs and unit == WORD:
        start, end, _ = word_spans(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        pairs = [(int(start[a]), int(end[z - 1])) for a, z in pairs]
    out: list[list[int]] = []
    for a, z in pairs:
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], z)
        else:
            out.append([a, z])
    return out


def _kept(text: bytes, runs: list[list[int]], whole_characters: bool) -> tuple[bytes, int]:
    """(bytes that stay, bytes removed)."""
    if whole_characters:
        for m in runs:
            while m[0] < m[1] and text[m[0]] & 0xC0 == 0x80:
                m[0] += 1
            while m[1] > m[0] and m[1] < len(text) and text[m[1]] & 0xC0 == 0x80:
                m[1] -= 1
    at, parts, removed = 0, [], 0
    for a, z in runs:
        parts.append(text[at:a])
        removed += z - a
        at = z
    parts.append(text[at:])
    return b"".join(parts), removed


def without_repeats(docs: DataFrame, length: int = MIN_BYTES, unit: str = BYTE, text_col: str = "text", with_text: bool = True, whole_characters: bool = True, passage_words: int | None = None) -> DataFrame:
    """Add n_bytes, n_removed, n_spans, kept_sha256 and (``with_text``) kept_text to ``docs``.

    Removed is every byte of the UTF-8 text that is covered by ``length`` bytes (or by ``length`` words and the white
    space between them, whatever it is) that also start anywhere else in the table, the same text included; matches
    never cross texts. With ``whole_characters`` the removed runs shrink to whole characters, so that what is left is
    text. With ``passage_words`` the column n_passage_bytes counts the bytes that passages of so many words cover which
    start elsewhere too; they are not removed. Null texts are empty. Repeated rows are copies of each other; every row
    gets a row. Columns of these names are replaced. An empty table gives no rows."""
    short_batches(docs.sparkSession)
    names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept_text"] if with_text else []), *(["n_passage_bytes"] if passage_words else [])]
    kept = [c for c in docs.columns if c not in names]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keys = F.xxhash64(text).alias("k1"), (F.crc32(text.cast("binary")) + F.octet_length(text).cast("long") * F.lit(2**32)).alias("k2")
    texts = docs.select(*keys, text.alias("text"))
    spans = repeated_spans(texts, length, unit)
    if passage_words:
        words = repeated_spans(texts, passage_words, WORD).withColumnRenamed("spans", "passages")
        spans = spans.join(words, ["k1", "k2"], "full")
    else:
        spans = spans.withColumn("passages", F.lit(None).cast("array<struct<first: bigint, end: bigint>>"))
    spans = spans.withColumnsRenamed({"k1": "__k1", "k2": "__k2", "spans": "__spans", "passages": "__passages"})
    rows = docs.select(*kept, *(k.alias(f"__{n}") for k, n in zip(keys, ("k1", "k2"), strict=True)), text.alias("__text"))
    joined = rows.join(spans.hint("merge"), ["__k1", "__k2"], "left").select(*kept, "__text", "__spans", "__passages")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, found, passages = b.column(b.num_columns - 3).cast(pa.binary()), b.column(b.num_columns - 2), b.column(b.num_columns - 1)
            out: dict[str, list] = {n: [] for n in names}
            for i in range(b.num_rows):
                t = texts[i].as_py()
                runs = merged(t, found[i].as_py(), unit)
                left, removed = _kept(t, runs, whole_characters)
                row = {"n_bytes": len(t), "n_removed": removed, "n_spans": len(runs), "kept_sha256": hashlib.sha256(left).hexdigest(), "kept_text": left.decode("utf-8", "replace") if with_text else ""}
                row["n_passage_bytes"] = sum(z - a for a, z in merged(t, passages[i].as_py(), WORD))
                for n in names:
                    out[n].append(row[n])
            made = [pa.array(out[n], pa.string() if n in ("kept_sha256", "kept_text") else pa.int64()) for n in names]
            yield pa.RecordBatch.from_arrays([*b.columns[:-3], *made], [*b.schema.names[:-3], *names])

    head = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in joined.schema.fields[:-3])
    return joined.mapInArrow(unburdened(run), head + ", ".join(f"{n} {'string' if n in ('kept_sha256', 'kept_text') else 'long'}" for n in names))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated strings of 400 bytes in every document, and the bytes of passages of over 50 words that repeat."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = without_repeats(docs, MIN_BYTES, with_text=False, whole_characters=False, passage_words=PASSAGE_WORDS)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_bytes")
