"""WARC archives as seekable Zstandard bundles.

A bundle is one file: independent frames, each with some records; a skippable frame with
the bundle's index (record identifier, frame, offset inside the frame, length); and the
footer seek table of the public seekable format. One record is found by the index and read
by unpacking one frame.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_folder, table, written

#: Raw bytes of a frame and of a bundle. A record above either has one to itself.
FRAME, BUNDLE = 1 << 18, 32 << 20
#: Fixed values of the public formats: magic numbers, and the profile of a revisit.
SEEK_MAGIC, SEEK_FRAME, INDEX_FRAME = 0x8F92EAB1, 0x184D2A5E, 0x184D2A50
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: WARC-Date of records whose pages have no time.
DATE = "2024-01-01T00:00:00Z"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _head(first: str, lines: list[tuple[str, str]]) -> bytes:
    return "\r\n".join([first, *(f"{k}: {v}" for k, v in lines), "", ""]).encode()


def record(page_id: int | None, url: str | None, html: str | None, first_id: int | None, revisit: bool) -> bytes:
    """One record. A revisit keeps the HTTP header, with the payload's length, and no payload."""
    payload = (html or "").encode()
    block = _head("HTTP/1.1 200 OK", [
        ("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))
    ])
    target = "".join(c if c > " " else f"%{ord(c):02X}" for c in url or "about:blank")
    lines = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<urn:page:{page_id}>"),
        ("WARC-Date", DATE), ("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha1:{digest_of(payload)}"),
    ]
    if revisit:
        lines += [("WARC-Refers-To", f"<urn:page:{first_id}>"), ("WARC-Profile", PROFILE)]
    else:
        block += payload
    lines += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return _head("WARC/1.1", lines) + block + b"\r\n\r\n"


def _headers(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, body = data.partition(b"\r\n\r\n")
    lines = (line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return {k.lower(): v for k, v in lines}, body


def _urn(value: str | None) -> int | None:
    text = value[len("<urn:page:"):-1] if value else "None"
    return None if text == "None" else int(text)


def parse(data: bytes) -> dict:
    """A record's fields; the digest of a response is worked out anew and must be the stated one."""
    head, rest = _headers(data)
    block = rest[:int(head["content-length"])]
    http, payload = _headers(block)
    digest = head["warc-payload-digest"].removeprefix("sha1:")
    revisit = head["warc-type"] == "revisit"
    size = int(http["content-length"]) if revisit else len(payload)
    if not revisit and (digest_of(payload) != digest or size != int(http["content-length"])):
        raise ValueError(f"damaged record {head['warc-record-id']}")
    return {
        "page_id": _urn(head["warc-record-id"]), "record_type": head["warc-type"],
        "refers_to": _urn(head.get("warc-refers-to")), "payload_bytes": size, "payload_digest": digest,
        "url": head["warc-target-uri"], "payload": None if revisit else payload,
    }


class Bundle:
    """Frames of a bundle under construction."""

    def __init__(self, level: int = 3, frame: int = FRAME):
        self.pack, self.frame = zstandard.ZstdCompressor(level=level, write_checksum=True), frame
        self.parts, self.sizes, self.index = [], [], []
        self.open, self.filled, self.raw = [], 0, 0

    def add(self, name: int | None, data: bytes) -> None:
        if self.filled and self.filled + len(data) > self.frame:
            self._close()
        self.index.append((name, len(self.sizes), self.filled, len(data)))
        self.open.append(data)
        self.filled += len(data)
        self.raw += len(data)

    def _close(self) -> None:
        packed = self.pack.compress(b"".join(self.open))
        self.parts.append(packed)
        self.sizes.append((len(packed), self.filled))
        self.open, self.filled = [], 0

    def finish(self) -> bytes:
        if self.open:
            self._close()
        body = zstandard.compress(json.dumps(self.index).encode())
        self.parts.append(struct.pack("<II", INDEX_FRAME, len(body)) + body)
        self.sizes.append((len(body) + 8, 0))
        entries = b"".join(struct.pack("<II", *s) for s in self.sizes)
        foot = struct.pack("<IBI", len(self.sizes), 0, SEEK_MAGIC)
        return b"".join([*self.parts, struct.pack("<II", SEEK_FRAME, len(entries) + 9), entries, foot])


class SeekableReader:
    """Frames and index of a finished bundle, found from its end."""

    def __init__(self, data: bytes):
        n, flags, magic = struct.unpack("<IBI", data[-9:])
        if magic != SEEK_MAGIC or flags & 0x7F:
            raise ValueError("no seek table at the end")
        self.data, self.starts, at = data, [], 0
        for i in range(n):
            packed, _ = struct.unpack_from("<II", data, len(data) - 9 - 8 * (n - i))
            self.starts.append((at, packed))
            at += packed
        start, size = self.starts[-1]
        self.index = json.loads(zstandard.decompress(data[start + 8:start + size]))

    def unpacked(self, frame: int) -> bytes:
        start, size = self.starts[frame]
        return zstandard.ZstdDecompressor().decompress(self.data[start:start + size])


def _bundler(frame: int, bundle: int) -> Callable:
    def bundles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Bundle(frame=frame)

        def full() -> pa.RecordBatch:
            # the writer ends each file with the last four bytes of the footer
            return pa.RecordBatch.from_arrays([pa.array([own.finish()[:-4]], pa.binary())], names=["content"])

        for batch in batches:
            for page_id, url, html, first_id, revisit in zip(*(batch.column(c) for c in
                                                            ("page_id", "url", "html", "first_id", "revisit"))):
                name = page_id.as_py()
                data = record(name, url.as_py(), html.as_py(), first_id.as_py(), revisit.as_py())
                if own.raw and own.raw + len(data) > bundle:
                    yield full()
                    own = Bundle(frame=frame)
                own.add(name, data)
        if own.raw:
            yield full()

    return bundles


def with_revisits(pages: DataFrame) -> DataFrame:
    """Add first_id and revisit: of equal payloads the smallest page_id is kept, others refer to it.

    A null page_id comes after all others. Rows that repeat the smallest page_id are kept too.
    Payloads are equal if their SHA-1 and length are. Only payloads that repeat are joined
    back; a payload that fills a third of the table is one row of the smaller side, and the
    join splits the larger side.
    """
    pages = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", "html",
        F.sha1(F.coalesce("html", F.lit("")).cast("binary")).alias("digest"),
        F.coalesce(F.octet_length("html"), F.lit(0)).alias("size"),
    )
    repeated = written(
        pages.groupBy("digest", "size").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
        .where("n > 1").drop("n"), "repeated",
    )
    return pages.join(repeated, ["digest", "size"], "left").select(
        "page_id", "url", "html", "first_id",
        (F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))).alias("revisit"),
    )


def write_archive(pages: DataFrame, path: str, frame: int = FRAME, bundle: int = BUNDLE) -> None:
    """Write pages (page_id, url, html) as bundles below `path`, one file each.

    Spark's own text writer puts them on any file system it knows: a file is one row's bytes
    and, as its line end, the magic number that ends every seek table.
    """
    rows = with_revisits(pages).mapInArrow(_bundler(frame, bundle), "content binary")
    (
        rows.select(F.col("content").cast("string"))
        .write.option("maxRecordsPerFile", 1).option("encoding", "ISO-8859-1")
        .option("lineSep", struct.pack("<I", SEEK_MAGIC).decode("ISO-8859-1")).text(path)
    )


def bundles(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of every bundle; a bundle fits in memory by its size limit."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")


_ENTRY = "path string, page_id bigint, frame int, first int, size int"


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """(path, page_id, frame, first, size): where each record is."""

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path"), batch.column("content")):
                index = SeekableReader(content.as_py()).index
                columns = list(zip(*index)) or [[]] * 4
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name.as_py()] * len(index), pa.string()), pa.array(columns[0], pa.int64()),
                     *(pa.array(c, pa.int32()) for c in columns[1:])],
                    names=["path", "page_id", "frame", "first", "size"],
                )

    return bundles(spark, path).mapInArrow(entries, _ENTRY)


_RECORD = (
    "page_id bigint, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, "
    "url string, payload binary"
)


def read_records(spark: SparkSession, path: str, wanted: DataFrame | None = None, payloads: bool = True) -> DataFrame:
    """The records below `path`, or those with the page_ids of `wanted`.

    A selection goes through the index: each bundle gets the places asked of it and unpacks
    only their frames.
    """
    own = bundles(spark, path)
    if wanted is not None:
        places = read_index(spark, path).join(wanted.select("page_id").distinct(), "page_id", "left_semi")
        asked = places.groupBy("path").agg(F.collect_list(F.struct("frame", "first", "size")).alias("places"))
        own = own.join(asked, "path")  # at most as many places as the bundle has records

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([
            ("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()),
            ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("url", pa.string()),
            ("payload", pa.binary()),
        ])
        for batch in batches:
            for i, content in enumerate(batch.column("content")):
                reader = SeekableReader(content.as_py())
                if "places" in batch.schema.names:
                    spots = [tuple(p.values()) for p in batch.column("places")[i].as_py()]
                else:
                    spots = [tuple(e[1:]) for e in reader.index]
                frame, data, rows = None, b"", []
                for number, first, size in sorted(spots):
                    if number != frame:
                        if rows:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        frame, data, rows = number, reader.unpacked(number), []
                    row = parse(data[first:first + size])
                    rows.append(row if payloads else row | {"payload": None})
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return own.mapInArrow(records, _RECORD)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all pages as archives, read the archives back and report each record.

    A null html is an empty payload, a null url about:blank. A null page_id is written as
    such; rows that repeat a page_id give a record each.
    """
    path = new_folder(spark, "archive")
    write_archive(table(spark, sf_dir, "pages"), path)
    return read_records(spark, path, payloads=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
bits AS (SELECT page_id, h, strlen(h) AS n, sha1(h) AS hex FROM p),
first AS (SELECT h, min(page_id) AS first_id FROM p GROUP BY h)
SELECT page_id, n AS payload_bytes,
  (SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      ((('0x' || substr(lpad(hex, 40, '0'), 10 * (g // 8) + 1, 10))::BIGINT >> (35 - 5 * (g % 8))) & 31)::INT + 1, 1),
      '' ORDER BY g) FROM range(32) AS r(g)) AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM bits JOIN first USING (h)
"""
