"""Web archives as seekable Zstandard bundles, written and read by Spark tasks.

A bundle is a WARC file whose records lie in independent Zstandard frames; a skippable frame at its
end holds the seek table of the seekable format. An index table, committed by Spark, names for each
frame its bundle and for each record its place inside the decompressed frame, so that one record
costs one frame to read. Each attempt of a task writes bundles of its own name: what a lost or
repeated attempt leaves behind is in no index.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.storage import materialize, shared_dir

# The seekable format's numbers and the texts of archive records.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC, WITH_CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 0x80
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_URN = "urn:page:"
EPOCH = "1970-01-01T00:00:00Z"


@dataclass(frozen=True)
class Layout:
    """``least_payload``: smaller payloads are never revisits. The rest is physical."""

    least_payload: int = 1000
    frame_bytes: int = 1 << 20
    frame_records: int = 2048
    bundle_bytes: int = 256 << 20
    level: int = 3


_RECORD = pa.struct([("page_id", pa.int64()), ("offset", pa.int64()), ("length", pa.int64())])
INDEX = (
    "bundle string, frame int, compressed_offset bigint, compressed_bytes bigint, frame_bytes bigint, "
    "records array<struct<page_id:bigint,offset:bigint,length:bigint>>"
)
_INDEX = pa.schema(
    [
        ("bundle", pa.string()),
        ("frame", pa.int32()),
        ("compressed_offset", pa.int64()),
        ("compressed_bytes", pa.int64()),
        ("frame_bytes", pa.int64()),
        ("records", pa.list_(_RECORD)),
    ]
)


def file_system(folder: str) -> tuple[pafs.FileSystem, str]:
    if "://" in folder or folder.startswith("file:"):
        return pafs.FileSystem.from_uri(folder)
    return pafs.LocalFileSystem(), folder


def record_urn(page_id: int | None) -> str:
    return f"<{RECORD_URN}{'' if page_id is None else page_id}>"


def urn_page(urn: str | None) -> int | None:
    number = (urn or "").strip("<>").removeprefix(RECORD_URN)
    return int(number) if number else None


def warc_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One record; a revisit keeps the HTTP header and leaves the payload to the response."""
    block = (
        f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    ).encode()
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    if not revisit:
        block += payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_urn(page_id)}",
        f"WARC-Date: {EPOCH}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        target = target_uri(url)
        lines.append(f"WARC-Target-URI: {target}")
        if target != url:
            lines.append(f"{SOURCE_URL}: {quote(url, safe=_URL_SAFE)}")
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_urn(refers_to)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


# A field of its own for a URL that no header can hold as it is: with blanks, say. Unquoting gives it back.
SOURCE_URL = "X-Source-URL"
# All printable ASCII but the escape sign itself.
_URL_SAFE = "".join(chr(c) for c in range(33, 127) if chr(c) != "%")
_STRAY_PERCENT = re.compile(r"%(?![0-9A-Fa-f]{2})")


def target_uri(url: str) -> str:
    """The URL as any reader takes it: escapes that it has stay, and what else needs one gets it."""
    return quote(_STRAY_PERCENT.sub("%25", url), safe=_URL_SAFE + "%")


def parse_record(raw: bytes) -> dict:
    """The fields of a record; ``payload`` is None in a revisit."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("no archive record at this offset")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.split(b": ")[1]) for x in http.split(b"\r\n") if x.startswith(b"Content-Length"))
    revisit = fields["WARC-Type"] == "revisit"
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    if not revisit and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"damaged payload in {fields['WARC-Record-ID']}")
    source = fields.get(SOURCE_URL)
    return {
        "page_id": urn_page(fields["WARC-Record-ID"]),
        "url": fields.get("WARC-Target-URI") if source is None else unquote(source),
        "record_type": fields["WARC-Type"],
        "refers_to": urn_page(fields.get("WARC-Refers-To")),
        "payload_bytes": size,
        "payload_digest": digest,
        "payload": None if revisit else payload,
    }


@dataclass
class BundleWriter:
    """Writes the records of one task into bundles and yields an index row for each frame."""

    folder: str
    layout: Layout
    rows: list[dict] = field(default_factory=list)
    buffer: bytearray = field(default_factory=bytearray)
    records: list[dict] = field(default_factory=list)
    out: object = None

    def _open(self) -> None:
        system, root = file_system(self.folder)
        system.create_dir(root, recursive=True)
        self.bundle = f"{uuid.uuid4().hex}.warc.zst"
        self.out = system.open_output_stream(f"{root}/{self.bundle}", compression=None)
        self.table: list[tuple[int, int, int]] = []
        self.written = 0

    def add(self, page_id: int | None, record: bytes) -> None:
        self.records.append({"page_id": page_id, "offset": len(self.buffer), "length": len(record)})
        self.buffer += record
        if len(self.buffer) >= self.layout.frame_bytes or len(self.records) >= self.layout.frame_records:
            self._end_frame()

    def _end_frame(self) -> None:
        if not self.records:
            return
        if self.out is None:
            self._open()
        raw = bytes(self.buffer)
        packed = zstandard.ZstdCompressor(level=self.layout.level).compress(raw)
        self.out.write(packed)
        self.rows.append(
            {
                "bundle": self.bundle,
                "frame": len(self.table),
                "compressed_offset": self.written,
                "compressed_bytes": len(packed),
                "frame_bytes": len(raw),
                "records": self.records,
            }
        )
        self.table.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.written += len(packed)
        self.buffer, self.records = bytearray(), []
        if self.written >= self.layout.bundle_bytes:
            self.end_bundle()

    def end_bundle(self) -> None:
        self._end_frame()
        if self.out is not None:
            entries = b"".join(struct.pack("<III", *entry) for entry in self.table)
            footer = struct.pack("<IBI", len(self.table), WITH_CHECKSUMS, SEEKABLE_MAGIC)
            self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(entries) + len(footer)) + entries + footer)
            self.out.close()
            self.out = None

    def taken(self) -> Iterator[pa.RecordBatch]:
        rows, self.rows = self.rows, []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_INDEX)


class BundleReader:
    """Reads single frames of a bundle by its seek table."""

    def __init__(self, folder: str, bundle: str):
        system, root = file_system(folder)
        self.file = system.open_input_file(f"{root}/{bundle}")
        size = self.file.size()
        count, flags, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEKABLE_MAGIC or flags != WITH_CHECKSUMS:
            raise ValueError(f"{bundle} has no seek table")
        table = self.file.read_at(12 * count, size - 9 - 12 * count)
        self.starts, self.entries, at = [], list(struct.iter_unpack("<III", table)), 0
        for packed, _, _ in self.entries:
            self.starts.append(at)
            at += packed

    def frame(self, number: int) -> bytes:
        packed, size, checksum = self.entries[number]
        raw = zstandard.ZstdDecompressor().decompress(
            self.file.read_at(packed, self.starts[number]), max_output_size=size
        )
        if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != checksum:
            raise ValueError("damaged frame")
        return raw

    def close(self) -> None:
        self.file.close()


def find_revisits(pages: DataFrame, layout: Layout = Layout(), html: str = "html") -> DataFrame:
    """(page_id, payload_key, refers_to) of the pages that are revisits.

    Of equal payloads of at least ``least_payload`` bytes the one with the largest page_id is the
    response (every row that has it), the others are revisits; a null page_id is smaller than any.
    Only digests are shuffled; a payload that occurs once takes no part in the join.
    """
    digests = pages.select("page_id", F.sha2(html, 256).alias("payload_key")).where(
        F.octet_length(html) >= layout.least_payload
    )
    groups = (
        digests.groupBy("payload_key")
        .agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("_rows"))
        .where(F.col("_rows") > 1)
        .drop("_rows")
    )
    older = F.col("page_id").isNull() | (F.col("page_id") < F.col("refers_to"))
    found = digests.join(groups, "payload_key").where(F.col("refers_to").isNotNull() & older)
    return found.select("page_id", "payload_key", "refers_to").distinct()


def write_archives(pages: DataFrame, folder: str, layout: Layout = Layout()) -> DataFrame:
    """Write one record per row of ``pages`` (page_id, url, html) and return the stored index of frames.

    The payload is the html in UTF-8; null html is an empty payload, a null url gives no target, and
    a null page_id a record without a number. Repeated rows are records of their own; rows that share a
    page_id share the name of their records. Other columns are not written. An empty table gives an index without rows.
    """
    revisits = find_revisits(pages, layout).select(
        F.col("page_id").alias("_page"), F.col("payload_key").alias("_key"), "refers_to"
    )
    keyed = pages.select("page_id", "url", "html", F.sha2("html", 256).alias("payload_key"))
    match = F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("payload_key") == F.col("_key"))
    # Building the hash table from the narrow side spares a sort of the pages.
    planned = keyed.join(revisits.hint("shuffle_hash"), match, "left").select(
        "page_id", "url", "html", "refers_to"
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = BundleWriter(folder, layout)
        for batch in batches:
            for page_id, url, html, refers_to in zip(*[batch.column(k) for k in range(4)]):
                page_id, refers_to = page_id.as_py(), refers_to.as_py()
                payload = (html.as_py() or "").encode()
                record = warc_record(page_id, url.as_py(), payload, refers_to, refers_to is not None)
                writer.add(page_id, record)
            yield from writer.taken()
        writer.end_bundle()
        yield from writer.taken()

    return materialize(planned.mapInArrow(write, INDEX), "archive-index")


RECORDS = (
    "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, "
    "payload_digest string, payload binary"
)
_RECORDS = pa.schema(
    [
        ("page_id", pa.int64()),
        ("url", pa.string()),
        ("record_type", pa.string()),
        ("refers_to", pa.int64()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("payload", pa.binary()),
    ]
)
FRAMES_PER_TASK = 32


def read_records(index: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records that ``index`` lists, read from the bundles frame by frame.

    Give it the whole index, or rows of it with fewer ``records`` (``lookup``) for some records only.
    Every payload is checked against its digest. ``payloads=False`` leaves them out of the result.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, reader = None, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["bundle"] != name:
                    if reader:
                        reader.close()
                    name, reader = row["bundle"], BundleReader(folder, row["bundle"])
                raw = reader.frame(row["frame"])
                found = [parse_record(raw[r["offset"] : r["offset"] + r["length"]]) for r in row["records"]]
                if not payloads:
                    found = [f | {"payload": None} for f in found]
                yield pa.RecordBatch.from_pylist(found, schema=_RECORDS)

    tasks = max(int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")), index.count() // FRAMES_PER_TASK)
    spread = index.repartition(tasks, "bundle", "frame").sortWithinPartitions("bundle", "frame")
    return spread.mapInArrow(read, RECORDS)


def lookup(index: DataFrame, page_ids: DataFrame) -> DataFrame:
    """The part of the index that holds the records of ``page_ids`` (column page_id)."""
    places = index.withColumn("record", F.explode("records")).drop("records")
    wanted = places.join(page_ids.select("page_id").distinct(), F.col("record.page_id") == F.col("page_id"), "left_semi")
    return wanted.groupBy("bundle", "frame", "compressed_offset", "compressed_bytes", "frame_bytes").agg(
        F.collect_list("record").alias("records")
    )


def archive_folder(pages: DataFrame) -> str:
    """A new folder for archives in the shared folder of the session."""
    return f"{shared_dir(pages.sparkSession).rstrip('/')}/archives-{uuid.uuid4().hex}"
