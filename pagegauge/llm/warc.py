"""WARC archives in seekable Zstandard bundles.

A bundle is a series of independent frames, each with whole records, and ends with a skippable frame that holds the seek
table of the public seekable format: compressed and raw size of each frame. Where a frame starts is the sum of the sizes
before it, so an index needs only bundle, frame and the offset inside the frame to reach a record.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagegauge.llm.common import scratch, stored

FRAME_BYTES = 1 << 20
BUNDLE_BYTES = 64 << 20
LEVEL = 3
# The table has no capture time; WARC demands one.
DATE = "1970-01-01T00:00:00Z"
# Fixed values of the formats.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
IDENTICAL_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_INDEX = "page_id bigint, record_id string, bundle string, frame int, frame_start bigint, frame_bytes bigint, offset bigint, length bigint"
_RECORDS = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, target string, record_id string, payload binary"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, payload_digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{payload_digest}')}>"


def _uri(url: str | None) -> str:
    """The url without characters that would end a header line."""
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url or "") or "urn:none"


def _record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    lines = [f"{k}: {v}" for k, v in [*headers, ("Content-Length", len(block))] if v is not None]
    return "\r\n".join(["WARC/1.1", *lines, "", ""]).encode() + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response with the payload, or a revisit of the page ``refers_to`` that has an equal one."""
    sha = digest(payload)
    common = [
        ("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(page_id, sha)), ("WARC-Date", DATE),
        ("WARC-Target-URI", _uri(url)), ("WARC-Payload-Digest", f"sha1:{sha}"), ("WARC-Page-ID", page_id), ("WARC-Payload-Length", len(payload)),
    ]
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    kind = ("Content-Type", "application/http; msgtype=response")
    if refers_to is None:
        return _record([*common, kind], head + payload)
    linked = [("WARC-Profile", IDENTICAL_PAYLOAD), ("WARC-Refers-To", record_id(refers_to, sha)), ("WARC-Refers-To-Page-ID", refers_to)]
    return _record([*common, *linked, kind], head)


def parse_records(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of a frame."""
    at = 0
    while at < len(raw):
        end = raw.index(b"\r\n\r\n", at)
        first, *lines = raw[at:end].decode().split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        headers = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        size = int(headers["content-length"])
        yield headers, raw[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The skippable frame that closes a bundle, from (compressed, raw) sizes."""
    body = b"".join(struct.pack("<II", *f) for f in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE_MAGIC)
    return struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body


def read_seek_table(file) -> list[tuple[int, int]]:
    """(start, compressed size) of each frame of an open bundle."""
    size = file.size()
    count, flags, magic = struct.unpack("<IBI", file.read_at(9, size - 9))
    if magic != SEEKABLE_MAGIC:
        raise ValueError("the bundle has no seek table")
    width = 12 if flags & 0x80 else 8
    table = file.read_at(count * width, size - 9 - count * width)
    sizes = [struct.unpack_from("<I", table, i * width)[0] for i in range(count)]
    starts = [0]
    for s in sizes:
        starts.append(starts[-1] + s)
    return list(zip(starts, sizes, strict=False))


class _Bundle:
    """One bundle in the making, written under a name of its own and renamed when it is whole."""

    def __init__(self, folder: str, name: str) -> None:
        self.fs, root = pafs.FileSystem.from_uri(folder)
        self.fs.create_dir(root, recursive=True)
        self.name, self.path = name, f"{root}/{name}"
        self.draft = f"{root}/.{name}.{uuid.uuid4().hex}"
        self.out, self.start, self.pending = self.fs.open_output_stream(self.draft), 0, 0
        self.frames: list[tuple[int, int]] = []
        self.records: list[bytes] = []
        self.entries: list[tuple] = []
        self.ids: list[tuple] = []
        self.packer = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True)
        info = b"software: pagegauge\r\nformat: WARC File Format 1.1\r\n"
        self.add(None, _record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")], info))
        self.flush()

    def add(self, ident: tuple | None, record: bytes) -> None:
        self.records.append(record)
        self.ids.append(ident)
        self.pending += len(record)
        if self.pending >= FRAME_BYTES:
            self.flush()

    def flush(self) -> None:
        if not self.records:
            return
        raw = b"".join(self.records)
        packed = self.packer.compress(raw)
        at = 0
        for ident, record in zip(self.ids, self.records, strict=True):
            if ident is not None:
                self.entries.append((*ident, self.name, len(self.frames), self.start, len(packed), at, len(record)))
            at += len(record)
        self.out.write(packed)
        self.frames.append((len(packed), len(raw)))
        self.start += len(packed)
        self.records, self.ids, self.pending = [], [], 0

    def close(self) -> list[tuple]:
        self.flush()
        self.out.write(seek_table(self.frames))
        self.out.close()
        self.fs.move(self.draft, self.path)
        return self.entries


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Writes one record per page into bundles in ``folder`` and returns their index (stored).

    ``folder`` must be one that all executors share. Of pages with equal payloads the one with the largest page_id is a
    response and the others revisit it; rows that share the largest id are all responses, and so are equal payloads
    without any id. Null payloads are empty. A repeated attempt of a task writes the same bundles again.
    """
    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("sha", F.sha1("payload"))
    heads = rows.select("page_id", "sha", F.octet_length("payload").alias("n"))
    largest = heads.groupBy("sha", "n").agg(F.max("page_id").alias("last"), F.count("*").alias("records")).where("records > 1 and last is not null")
    # Only ids and hashes meet by payload; the payloads themselves are joined by page.
    revisits = (
        heads.join(largest, ["sha", "n"]).where(~F.col("page_id").eqNullSafe(F.col("last")))
        .select(F.col("page_id").alias("r_id"), F.col("sha").alias("r_sha"), F.col("last").alias("refers_to")).distinct()
    )
    same = F.col("page_id").eqNullSafe(F.col("r_id")) & (F.col("sha") == F.col("r_sha"))
    typed = rows.join(revisits, same, "left").select("page_id", "url", "payload", "refers_to")

    def run(batches):
        part, serial, bundle = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            done = []
            for page_id, url, payload, refers_to in zip(*batch.columns, strict=True):
                if bundle is None:
                    bundle = _Bundle(folder, f"pages-{part:06d}-{serial:04d}.warc.zst")
                number = page_id.as_py()
                record = page_record(number, url.as_py(), payload.as_py(), refers_to.as_py())
                bundle.add((number, next(parse_records(record))[0]["warc-record-id"]), record)
                if bundle.start >= BUNDLE_BYTES:
                    done += bundle.close()
                    bundle, serial = None, serial + 1
            if done:
                yield _batch(done, _INDEX)
        if bundle is not None:
            yield _batch(bundle.close(), _INDEX)

    return stored(typed.sortWithinPartitions("page_id", F.xxhash64("payload")).mapInArrow(run, _INDEX), "warc-index")


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def _row(headers: dict[str, str], block: bytes) -> tuple:
    number = lambda name: int(headers[name]) if name in headers else None
    sha, kind = headers["warc-payload-digest"].removeprefix("sha1:"), headers["warc-type"]
    payload, size = None, number("warc-payload-length")
    if kind == "response":
        payload = block[block.index(b"\r\n\r\n") + 4 :]
        if digest(payload) != sha or len(payload) != size:
            raise ValueError(f"the payload of {headers['warc-record-id']} does not match its digest")
    return (number("warc-page-id"), size, sha, kind, number("warc-refers-to-page-id"), headers["warc-target-uri"], headers["warc-record-id"], payload)


def _read(rows: DataFrame, folder: str, one: bool) -> DataFrame:
    """Records of whole bundles, or of single places (bundle, frame, offset, length)."""

    def run(batches):
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            fs, root = pafs.FileSystem.from_uri(folder)
            for place in batch.to_pylist():
                with fs.open_input_file(f"{root}/{place['bundle']}") as file:
                    frames = read_seek_table(file)
                    for start, size in [frames[place["frame"]]] if one else frames:
                        raw = unpack.decompress(file.read_at(size, start))
                        if one:
                            raw = raw[place["offset"] : place["offset"] + place["length"]]
                        found = [_row(h, b) for h, b in parse_records(raw) if h["warc-type"] != "warcinfo"]
                        if found:
                            yield _batch(found, _RECORDS)

    return rows.mapInArrow(run, _RECORDS)


def read(spark: SparkSession, index: DataFrame, folder: str) -> DataFrame:
    """All records of the bundles that an index names, read frame by frame and checked against their digests."""
    bundles = index.select("bundle").distinct()
    return _read(bundles.repartition("bundle"), folder, False)


def fetch(index: DataFrame, folder: str) -> DataFrame:
    """The records of the given index rows only: one frame is read per row."""
    return _read(index.select("bundle", "frame", "offset", "length"), folder, True)


def round_trip(pages: DataFrame) -> DataFrame:
    """One row (page_id, payload_bytes, payload_digest, record_type, refers_to) per page, from the archives written."""
    spark = pages.sparkSession
    folder = scratch(spark, "warc")
    return read(spark, write(pages, folder), folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
