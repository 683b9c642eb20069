"""WARC archives: writing with segmented records and chunked transfer framing, and reading back with reassembly."""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetlens.llm.common import landed, shared_path

SEGMENT_BYTES = 8192
CHUNK = 4096
SALTS = 16
BUNDLE = 1 << 20
#: A gzip member without content; it closes each bundle of members, as text lines need something between them.
EMPTY_MEMBER = gzip.compress(b"", mtime=0)
DATE = "2024-01-01T00:00:00Z"
NAMESPACE = uuid.UUID("6f9619ff-8b86-d011-b42d-00c04fc964ff")
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """The payload in chunked transfer framing."""
    out = []
    for at in range(0, len(payload), size):
        part = payload[at : at + size]
        out += [b"%x\r\n" % len(part), part, b"\r\n"]
    return b"".join([*out, b"0\r\n\r\n"])


def dechunked(body: bytes) -> bytes:
    """The payload of a chunked body; extensions and trailers are ignored. ValueError if the framing is broken."""
    out, at = [], 0
    while True:
        line = body.find(b"\r\n", at)
        if line < 0:
            raise ValueError("chunk size line is missing")
        size = int(body[at:line].split(b";")[0], 16)
        if size == 0:
            return b"".join(out)
        part = body[line + 2 : line + 2 + size]
        if len(part) != size or body[line + 2 + size : line + 4 + size] != b"\r\n":
            raise ValueError("chunk is cut short")
        out.append(part)
        at = line + 4 + size


def http_payload(block: bytes) -> bytes:
    """The payload of an HTTP response block, its transfer coding undone."""
    head, gap, body = block.partition(b"\r\n\r\n")
    if not gap:
        return b""
    return dechunked(body) if re.search(rb"(?im)^transfer-encoding:[ \t]*chunked[ \t]*\r?$", head) else body


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id, digest: str, copy: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{page_id}|{digest}|{copy}')}>"


def _head(fields: list[tuple[str, object]]) -> bytes:
    clean = (f"{k}: {re.sub(r'[\r\n]+', ' ', str(v))}\r\n" for k, v in fields if v is not None)
    return ("WARC/1.1\r\n" + "".join(clean) + "\r\n").encode()


def page_records(page_id, url: str | None, payload: bytes, copy: int, keeper, is_revisit: bool, segment: int) -> Iterator[bytes]:
    """The WARC records of one page, each without the two line ends that close it."""
    digest = base32_sha1(payload)
    own = record_id(page_id, digest, copy)
    common = [("WARC-Date", DATE), ("WARC-Target-URI", url), ("X-Page-ID", page_id)]
    kind = ("Content-Type", "application/http; msgtype=response")
    if is_revisit:
        block = HTTP.replace(b"Transfer-Encoding: chunked\r\n", b"")
        yield _head([("WARC-Type", "revisit"), ("WARC-Record-ID", own), *common, ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Refers-To", record_id(keeper, digest, 1)), kind, ("Content-Length", len(block))]) + block
        return
    block = HTTP + chunked(payload)
    parts = [block[at : at + segment] for at in range(0, len(block), segment)]
    first = [("WARC-Type", "response"), ("WARC-Record-ID", own), *common, ("WARC-Payload-Digest", f"sha1:{digest}"), kind]
    if len(parts) > 1:
        first.append(("WARC-Segment-Number", 1))
    yield _head([*first, ("Content-Length", len(parts[0]))]) + parts[0]
    for n, part in enumerate(parts[1:], 2):
        total = len(block) if n == len(parts) else None
        yield _head([("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{own}|{n}')}>"), *common, ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", n), ("WARC-Segment-Total-Length", total), ("Content-Length", len(part))]) + part


def member(record: bytes) -> bytes:
    """A record with the two line ends that close it as a gzip member of its own, so that a reader can start at it."""
    return gzip.compress(record + b"\r\n\r\n", 6, mtime=0)


def write_archives(pages: DataFrame, path: str, segment_bytes: int = SEGMENT_BYTES, file_bytes: int = 64 << 20) -> None:
    """Write one response or revisit per row of ``pages`` (page_id, url, html) as WARC files under ``path``.

    Each record is a gzip member. Members are written in bundles that are closed when they reach BUNDLE bytes, and a file
    holds as many bundles as ``file_bytes`` has BUNDLEs, so its size does not depend on how long the pages are: a member is
    a segment, so a file exceeds ``file_bytes`` by one segment a bundle at most.

    Of rows with equal payloads the one with the largest page_id is the response and the others revisit it. Rows that
    repeat that page_id with that payload are responses too. A null page_id is smaller than any other; if all are null,
    all are responses. Null html is an empty payload. Blocks of over ``segment_bytes`` are cut into continuations.
    The rows of a payload are salted by page_id, so a payload shared by a third of the pages is written by many tasks."""
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("salt", F.coalesce(F.pmod(F.col("page_id"), F.lit(SALTS)), F.lit(0)).cast("int"))
    shared = pages.select(F.col("page_id").cast("long"), F.sha1(F.coalesce(F.col("html").cast("binary"), F.lit(b""))).alias("digest")).groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n"))
    shared = shared.filter("n > 1 and keeper is not null").drop("n").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    marked = rows.join(shared, ["digest", "salt"], "left").withColumn("revisit", F.coalesce(~F.col("page_id").eqNullSafe(F.col("keeper")) & F.col("keeper").isNotNull(), F.lit(False)))
    marked = marked.withColumn("copy", F.row_number().over(Window.partitionBy("digest", "salt", "page_id").orderBy("url")))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle = bytearray()
        for b in batches:
            for page_id, url, payload, copy, keeper, revisit in zip(*b.columns, strict=True):
                for r in page_records(page_id.as_py(), url.as_py(), payload.as_py(), copy.as_py(), keeper.as_py(), revisit.as_py(), segment_bytes):
                    bundle += member(r)
                    if len(bundle) >= BUNDLE:
                        yield pa.RecordBatch.from_pydict({"members": pa.array([bytes(bundle)], pa.binary())})
                        bundle.clear()
        if bundle:
            yield pa.RecordBatch.from_pydict({"members": pa.array([bytes(bundle)], pa.binary())})

    members = marked.select("page_id", "url", "payload", "copy", "keeper", "revisit").mapInArrow(pack, "members binary")
    lines = members.select(F.col("members").cast("string")).write.option("encoding", "iso-8859-1").option("lineSep", EMPTY_MEMBER.decode("iso-8859-1"))
    lines.option("compression", "none").option("maxRecordsPerFile", max(1, file_bytes // BUNDLE)).text(path)


def parsed_records(stream: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields with lower-cased names, block) of each record of an uncompressed WARC byte stream."""
    held, stream = b"", iter(stream)

    def more() -> bool:
        nonlocal held
        part = next(stream, None)
        held += part or b""
        return part is not None

    while True:
        held = held.lstrip(b"\r\n")
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not more():
                if held.strip(b"\r\n"):
                    raise ValueError("WARC header is cut short")
                return
            held = held.lstrip(b"\r\n")
        version, *lines = held[:end].decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"not a WARC record: {version[:40]!r}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = int(fields["content-length"])
        while len(held) < end + 4 + size:
            if not more():
                raise ValueError("WARC block is cut short")
        yield fields, held[end + 4 : end + 4 + size]
        held = held[end + 4 + size :]


def _gunzipped(content: bytes, step: int = 1 << 13) -> Iterator[bytes]:
    """The content of gzip members; short steps, as what a step holds beyond a member's end is copied."""
    at, view = 0, memoryview(content)
    while at < len(content):
        unzip = zlib.decompressobj(31)
        while at < len(content) and not unzip.eof:
            part = view[at : at + step]
            got = unzip.decompress(part)
            at += len(part) - len(unzip.unused_data)
            if got:
                yield got


RAW = "record_id string, type string, page_id long, uri string, digest string, refers_to string, number int, total long, block binary, payload_bytes long, payload binary"
META = ("record_id", "type", "page_id", "uri", "digest", "refers_to")


def _checked(block: bytes, said: str | None) -> bytes:
    payload = http_payload(block)
    if said != f"sha1:{base32_sha1(payload)}":
        raise ValueError(f"payload does not have the digest {said}")
    return payload


def _parse(with_payload: bool):
    """Records of archive files; whole responses are decoded and checked at once, segments keep their blocks."""
    names = [x.split()[0] for x in RAW.split(", ")]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.binary()]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                rows, size = [], 0
                for f, block in parsed_records(_gunzipped(content.as_py())):
                    number = lambda k, f=f: int(f[k]) if k in f else None
                    kind, part, payload = f["warc-type"], number("warc-segment-number"), None
                    if kind == "response" and part is None:
                        payload = _checked(block, f.get("warc-payload-digest"))
                    rows.append((
                        f.get("warc-segment-origin-id", f["warc-record-id"]), kind, number("x-page-id"), f.get("warc-target-uri"), f.get("warc-payload-digest"), f.get("warc-refers-to"), part, number("warc-segment-total-length"),
                        block if part else None, None if payload is None else len(payload), payload if with_payload else None,
                    ))
                    size += len(block)
                    if size > 4_000_000:
                        yield batch(rows)
                        rows, size = [], 0
                if rows:
                    yield batch(rows)

    return run


def _decode(with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            payloads = [_checked(block, said) for said, block in zip(b.column(4).to_pylist(), b.column(6).to_pylist(), strict=True)]
            sizes = pa.array([len(p) for p in payloads], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:6], sizes, pa.array(payloads if with_payload else [None] * len(payloads), pa.binary())], [*META, "payload_bytes", "payload"])

    return run


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """The records of the gzipped WARC files under ``path``: record_id, type, page_id, uri, digest, refers_to,
    payload_bytes, payload (null without ``with_payload``, and for revisits).

    Continuations are grouped by origin identifier and put in order of segment number. A missing or repeated number, or
    a length other than the last segment's total, raises an error; so do broken chunk framing and a payload that does
    not have its digest. One group holds one record's segments."""
    raw = landed(spark.read.format("binaryFile").load(path).select("content").mapInArrow(_parse(with_payload), RAW), "warc-records")
    plain = raw.filter("number is null").select(*META, "payload_bytes", "payload")
    first = F.col("type") != "continuation"
    parts = raw.filter("number is not null").groupBy("record_id").agg(
        *(F.max(F.when(first, F.col(c))).alias(c) for c in META[1:]), F.max("total").alias("total"), F.sort_array(F.collect_list(F.struct("number", "block"))).alias("parts")
    )
    joined = parts.withColumn("block", F.unhex(F.expr("array_join(transform(parts, x -> hex(x.block)), '')")))
    sound = F.expr("transform(parts, x -> x.number) = sequence(1, size(parts))") & (F.octet_length("block") == F.col("total"))
    fault = F.raise_error(F.concat(F.lit("segments are missing or do not add up: "), F.col("record_id")))
    joined = joined.withColumn("block", F.when(F.coalesce(sound, F.lit(False)), F.col("block")).otherwise(fault))
    kinds = "record_id string, type string, page_id long, uri string, digest string, refers_to string, payload_bytes long, payload binary"
    return plain.unionByName(joined.select(*META, "block").mapInArrow(_decode(with_payload), kinds))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the pages as archives, read them back and resolve revisits to the responses they refer to."""
    path = shared_path(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    got = landed(read_archives(spark, path, with_payload=False).drop("payload", "uri"), "warc-read")
    responses = got.filter("type = 'response'")
    again = got.filter("type = 'revisit'").withColumn("salt", F.coalesce(F.pmod(F.col("page_id"), F.lit(SALTS)), F.lit(0)).cast("int"))
    to = again.select("refers_to").distinct().join(responses.select(F.col("record_id").alias("refers_to"), F.col("page_id").alias("to_page"), F.col("payload_bytes").alias("to_bytes")), "refers_to")
    to = to.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    again = again.join(to, ["refers_to", "salt"], "left").select("page_id", F.col("to_bytes").alias("payload_bytes"), "digest", "type", "to_page")
    both = responses.select("page_id", "payload_bytes", "digest", "type", F.lit(None).cast("long").alias("to_page")).unionByName(again)
    return both.select("page_id", "payload_bytes", F.expr("substring(digest, 6)").alias("payload_digest"), F.col("type").alias("record_type"), F.col("to_page").alias("refers_to"))
