"""WARC records in seekable Zstandard bundles.

Records are grouped into frames that decompress on their own; a bundle ends with a
seek table in a skippable frame (the public seekable format), and an index maps
each record to (frame, offset in the frame). A bundle is one row of a table in
shared storage, so Spark's committer makes each bundle appear once and whole even
when executors are lost, and any store that Spark can write will do. ``write_index``
makes one sorted table of all records' places, ``export_files`` writes the bundles as
.warc.zst files, and ``read_files`` reads such files back by their seek tables.
"""

from __future__ import annotations

import base64
import hashlib
import os
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import materialize
from ._words import flat

FRAME_BYTES, BUNDLE_BYTES, LEVEL, MIN_BYTES = 256 << 10, 4 << 20, 3, 0
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
DATE = "1970-01-01T00:00:00Z"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: The table of repeated digests is broadcast up to so many rows, and joined by shuffle beyond.
BROADCAST_ROWS = 200_000
_RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
_BUNDLE = "bundle string, archive binary, record_ids array<long>, frames array<int>, offsets array<int>"


class BundleWriter:
    """Collects records; finish() gives the archive and each record's place."""

    def __init__(self, frame_bytes: int = FRAME_BYTES, level: int = LEVEL) -> None:
        self.frame_bytes, self.coder = frame_bytes, zstandard.ZstdCompressor(level=level)
        self.parts: list[bytes] = []
        self.sizes: list[tuple[int, int]] = []
        self.open: list[bytes] = []
        self.open_bytes = self.bytes = 0
        self.ids: list[int | None] = []
        self.frames: list[int] = []
        self.offsets: list[int] = []

    def add(self, record_id: int | None, record: bytes) -> None:
        self.ids.append(record_id)
        self.frames.append(len(self.parts))
        self.offsets.append(self.open_bytes)
        self.open.append(record)
        self.open_bytes += len(record)
        self.bytes += len(record)
        if self.open_bytes >= self.frame_bytes:
            self._close()

    def _close(self) -> None:
        if self.open:
            packed = self.coder.compress(b"".join(self.open))
            self.parts.append(packed)
            self.sizes.append((len(packed), self.open_bytes))
            self.open, self.open_bytes = [], 0

    def finish(self) -> bytes:
        self._close()
        entries = b"".join(struct.pack("<II", *x) for x in self.sizes)
        footer = struct.pack("<IBI", len(self.sizes), 0, SEEKABLE)
        return b"".join([*self.parts, struct.pack("<II", SKIPPABLE, len(entries) + len(footer)), entries, footer])


class BundleReader:
    """Reads frames of an archive by its seek table."""

    def __init__(self, archive: bytes) -> None:
        count, _, magic = struct.unpack("<IBI", archive[-9:])
        if magic != SEEKABLE:
            raise ValueError("no seek table")
        table = np.frombuffer(archive, "<u4", 2 * count, len(archive) - 9 - 8 * count).reshape(-1, 2)
        if struct.unpack_from("<II", archive, len(archive) - 17 - 8 * count) != (SKIPPABLE, 9 + 8 * count):
            raise ValueError("broken seek table")
        self.archive, self.sizes = archive, table[:, 1].tolist()
        self.starts = np.concatenate([[0], np.cumsum(table[:, 0].astype(np.int64))]).tolist()
        self.coder = zstandard.ZstdDecompressor()

    def frame(self, k: int) -> bytes:
        return self.coder.decompress(self.archive[self.starts[k] : self.starts[k + 1]], max_output_size=self.sizes[k])

    def record(self, k: int, offset: int) -> bytes:
        """The record at an offset of frame k; no other frame is decompressed."""
        return record_at(self.frame(k), offset)[0]


def record_at(data: bytes, offset: int) -> tuple[bytes, int]:
    head = data.index(b"\r\n\r\n", offset) + 4
    length = int(fields(data[offset:head])[b"Content-Length"])
    end = head + length + 4
    return data[offset:end], end


def fields(head: bytes) -> dict[bytes, bytes]:
    return dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:] if b": " in x)


def record_uuid(*key: object) -> str:
    return str(uuid.uuid5(uuid.NAMESPACE_URL, "page:" + ":".join(map(str, key))))


def make_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, record_id: str | None = None, refers_id: str | None = None) -> bytes:
    """A response record, or (with refers_to) a revisit record without payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    uri = "".join(c if c > " " else "%%%02X" % ord(c) for c in url or "")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:uuid:{record_id or record_uuid(page_id, digest)}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is not None:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        if refers_id is not None:
            head.append(f"WARC-Refers-To: <urn:uuid:{refers_id}>")
        head.append(f"X-Refers-To-Page: {refers_to}")
    if page_id is not None:
        head.append(f"X-Page: {page_id}")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    task, writer, made, nth = TaskContext.get().partitionId(), BundleWriter(), 0, 0

    def bundle() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([f"{task:06d}-{made:06d}"]), pa.array([writer.finish()], pa.binary()), pa.array([writer.ids], pa.list_(pa.int64())), pa.array([writer.frames], pa.list_(pa.int32())), pa.array([writer.offsets], pa.list_(pa.int32()))], ["bundle", "archive", "record_ids", "frames", "offsets"])

    for b in batches:
        offsets, body, _ = flat(b["html"])
        body = memoryview(body)
        at = offsets.tolist()
        for i, (page, url, last, tops, large) in enumerate(zip(*(b[c].to_pylist() for c in ("page_id", "url", "last", "tops", "large")), strict=True)):
            payload = bytes(body[at[i] : at[i + 1]])
            digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
            to = last if last is not None and last != page else None
            # a response that no other record can be taken for is named by its content, any other one by its place
            alone = to is None and page is not None and large and (tops is None or tops == 1)
            name = record_uuid(page, digest) if alone else record_uuid(page, digest, task, nth)
            nth += 1
            writer.add(page, make_record(page, url, payload, digest, to, name, record_uuid(last, digest) if tops == 1 else None))
            if writer.bytes >= BUNDLE_BYTES:
                yield bundle()
                writer, made = BundleWriter(), made + 1
    if writer.ids:
        yield bundle()


def write_bundles(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """The written table of bundles: bundle, archive, record_ids, frames, offsets.

    Of records with equal payloads of at least min_bytes bytes, that with the largest
    page_id is the response and others revisit it. A null html is empty; a null
    page_id is smaller than any; rows that repeat the largest page_id are all
    responses. Every record has an identifier of its own; a revisit names its response's
    unless there are several. An empty table gives no bundles; further columns are
    ignored.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.sha1(html).alias("key"), (F.octet_length(html) >= min_bytes).alias("large"))
    counts = rows.where("large").groupBy("key", "page_id").agg(F.count("*").alias("n"))
    counts = counts.groupBy("key").agg(F.max("page_id").alias("last"), F.max_by("n", F.coalesce(F.col("page_id"), F.lit(-(1 << 63)))).alias("tops"), F.sum("n").alias("all"))
    repeated = materialize(counts.where("all > 1").drop("all"), "repeated")
    if repeated.count() <= BROADCAST_ROWS:
        repeated = F.broadcast(repeated)
    joined = rows.join(repeated, "key", "left").select("page_id", "url", "html", F.when(F.col("large"), F.col("last")).alias("last"), F.when(F.col("large"), F.col("tops")).alias("tops"), "large")
    return materialize(joined.mapInArrow(_pack, _BUNDLE), "bundles")


def write_index(bundles: DataFrame) -> DataFrame:
    """The written table (record_id, bundle, frame, offset) of all records, sorted by record_id, so a search reads few row groups."""
    places = bundles.select("bundle", F.explode(F.arrays_zip("record_ids", "frames", "offsets")).alias("p"))
    places = places.select(F.col("p.record_ids").alias("record_id"), "bundle", F.col("p.frames").alias("frame"), F.col("p.offsets").alias("offset"))
    return materialize(places.repartitionByRange("record_id").sortWithinPartitions("record_id"), "index")


def export_files(bundles: DataFrame, folder: str) -> DataFrame:
    """(path, n_bytes) of each bundle, written as a .warc.zst file to a folder that all executors reach by a file path.

    A file appears under its name when it is whole; a task that runs again writes the same.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(folder, exist_ok=True)
        for b in batches:
            paths = []
            for name, archive in zip(b["bundle"].to_pylist(), b["archive"].to_pylist(), strict=True):
                paths.append(os.path.join(folder, f"{name}.warc.zst"))
                part = f"{paths[-1]}.{uuid.uuid4().hex}"
                with open(part, "wb") as f:
                    f.write(archive)
                os.replace(part, paths[-1])
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array([os.path.getsize(p) for p in paths], pa.int64())], ["path", "n_bytes"])

    return materialize(bundles.select("bundle", "archive").mapInArrow(write, "path string, n_bytes long"), "files")


def _parse(record: bytes) -> tuple[int | None, int, str, str, int | None]:
    """(page, payload bytes, digest, type, page referred to) of a record, checked against its digest."""
    head, _, rest = record.partition(b"\r\n\r\n")
    f = fields(head)
    http, _, payload = rest[: int(f[b"Content-Length"])].partition(b"\r\n\r\n")
    size, digest, kind = int(fields(http)[b"Content-Length"]), f[b"WARC-Payload-Digest"].removeprefix(b"sha1:").decode(), f[b"WARC-Type"].decode()
    if kind == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError("a record does not match its digest")
    page, to = f.get(b"X-Page"), f.get(b"X-Refers-To-Page")
    return None if page is None else int(page), size, digest, kind, None if to is None else int(to)


def _batch(out: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*out, strict=True)) or [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """By the places in the index."""
    for b in batches:
        for k in range(b.num_rows):
            reader, out, held, frame = BundleReader(b["archive"][k].as_py()), [], -1, b""
            for n, offset in zip(b["frames"][k].as_py(), b["offsets"][k].as_py(), strict=True):
                if n != held:
                    held, frame = n, reader.frame(n)
                out.append(_parse(record_at(frame, offset)[0]))
            yield _batch(out)


def _unpack_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Frame by frame, record by record, by the seek table alone."""
    for b in batches:
        for archive in b["content"].to_pylist():
            reader = BundleReader(archive)
            for n in range(len(reader.sizes)):
                frame, at, out = reader.frame(n), 0, []
                while at < len(frame):
                    record, at = record_at(frame, at)
                    out.append(_parse(record))
                yield _batch(out)


def read_bundles(bundles: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record, checked against its digest.

    An empty table of bundles gives no rows; a record that does not match its digest raises ValueError.
    """
    return bundles.select("archive", "frames", "offsets").mapInArrow(_unpack, _RECORD)


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of ``read_bundles`` from the .warc.zst files of a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).select("content").mapInArrow(_unpack_whole, _RECORD)


def find_record(bundles: DataFrame, record_id: int, index: DataFrame | None = None) -> bytes | None:
    """A record by its page_id (any of several; None if there is none): its place is found by the index, then one frame is decompressed."""
    wanted = F.lit(record_id).cast("long")
    places = index.where(F.col("record_id") == wanted) if index is not None else bundles.where(F.array_contains("record_ids", wanted)).select("bundle", F.array_position("record_ids", wanted).alias("k"), "frames", "offsets").select("bundle", F.get("frames", F.col("k").cast("int") - 1).alias("frame"), F.get("offsets", F.col("k").cast("int") - 1).alias("offset"))
    for place in places.limit(1).collect():
        row = bundles.where(F.col("bundle") == place["bundle"]).select("archive").first()
        return BundleReader(bytes(row["archive"])).record(place["frame"], place["offset"])
    return None


#: The rows of read_bundles(write_bundles(pages)) in DuckDB.
SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, h, max(page_id) OVER (PARTITION BY h) AS last,
  list_aggregate(list_transform(range(0, 8), lambda i: list_aggregate(list_transform([15, 10, 5, 0], lambda s: substr('{ALPHABET}', ((('0x' || substr(h, 5 * i::INT + 1, 5))::BIGINT >> s) & 31)::INT + 1, 1)), 'string_agg', '')), 'string_agg', '') AS payload_digest FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id IS DISTINCT FROM last AND last IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM last THEN last END AS refers_to FROM d
"""
