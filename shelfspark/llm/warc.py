"""WARC archives as seekable Zstandard bundles.

Records are grouped into independent Zstandard frames; a skippable frame at the bundle's end holds the seek table
(each frame's compressed and plain size, in the public seekable format), and an index maps each record to its bundle,
frame and offset within the frame. One record is read by fetching its frame only.

Of pages with equal payloads the one with the largest page_id is a response, the others are revisits that refer to
it and hold no payload. Payloads below ``least`` bytes are always responses.

Cases: null html is an empty payload, null url has no target header; line breaks in a url are percent-encoded; pages
with a null page_id are responses if no page of equal payload has an id (else revisits) and are told apart by the index
alone; all rows that carry a group's largest page_id are responses; an empty table writes no bundle; columns other
than page_id, url and html are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.llm import _io, _text

#: Fixed values of the seekable format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
#: A payload of more pages than this doesn't bring them together.
MANY = 256
FRAME_BYTES, FRAME_RECORDS, BUNDLE_BYTES = 256 << 10, 128, 64 << 20
DATE = "2026-01-01T00:00:00Z"
INDEX = "page_id long, bundle string, frame int, offset long, length long"
READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, html string"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _page(name: str | None) -> int | None:
    tail = name[10:-1] if name else "none"
    return None if tail == "none" else int(tail)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response record, or a revisit of the record of page ``refers_to``."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_name(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="".join(chr(c) for c in range(33, 127))))
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_name(refers_to)}"]
    head += [f"WARC-Payload-Digest: sha1:{digest(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """A record's page, type, target, payload (None for a revisit), its length and digest, and what it refers to."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    field = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines[1:])}
    block = rest[: int(field["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(x for x in http.decode().split("\r\n") if x.lower().startswith("content-length:")).split(":")[1])
    revisit = field["warc-type"] == "revisit"
    stated = field["warc-payload-digest"].removeprefix("sha1:")
    if not revisit and (len(payload) != size or digest(payload) != stated):
        raise ValueError(f"record {field['warc-record-id']} is damaged")
    return {
        "page_id": _page(field["warc-record-id"]), "record_type": field["warc-type"], "url": field.get("warc-target-uri"), "payload": None if revisit else payload,
        "payload_bytes": size, "payload_digest": stated, "refers_to": _page(field.get("warc-refers-to")),
    }


class Bundle:
    """A bundle that is being written. add() returns the record's frame, offset and length."""

    def __init__(self, out, level: int = 3):
        self.out, self.level = out, level
        self.open_, self.size, self.records, self.frames, self.bytes = [], 0, 0, [], 0

    def add(self, raw: bytes) -> tuple[int, int, int]:
        if self.records and (self.size + len(raw) > FRAME_BYTES or self.records >= FRAME_RECORDS):
            self.flush()
        at = self.size
        self.open_.append(raw)
        self.size += len(raw)
        self.records += 1
        return len(self.frames), at, len(raw)

    def flush(self) -> None:
        if self.records:
            packed = zstandard.ZstdCompressor(level=self.level, write_content_size=True).compress(b"".join(self.open_))
            self.out.write(packed)
            self.frames.append((len(packed), self.size))
            self.bytes += len(packed)
            self.open_, self.size, self.records = [], 0, 0

    def close(self) -> None:
        self.flush()
        u4 = lambda *v: b"".join(x.to_bytes(4, "little") for x in v)
        table = b"".join(u4(*f) for f in self.frames) + u4(len(self.frames)) + b"\0" + u4(SEEKABLE)
        self.out.write(u4(SKIPPABLE, len(table)) + table)
        self.out.close()


class Reader:
    """Random access to a bundle's frames."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        tail = file.read_at(9, size - 9)
        if int.from_bytes(tail[5:], "little") != SEEKABLE:
            raise ValueError("no seek table")
        n = int.from_bytes(tail[:4], "little")
        table = file.read_at(8 * n, size - 9 - 8 * n)
        self.frames, at = [], 0
        for i in range(n):
            packed, plain = (int.from_bytes(table[8 * i + j : 8 * i + j + 4], "little") for j in (0, 4))
            self.frames.append((at, packed, plain))
            at += packed
        self.last: tuple[int, bytes] = (-1, b"")

    def record(self, frame: int, offset: int, length: int) -> bytes:
        if self.last[0] != frame:
            at, packed, plain = self.frames[frame]
            self.last = frame, zstandard.ZstdDecompressor().decompress(self.file.read_at(packed, at), max_output_size=plain)
        return self.last[1][offset : offset + length]


def _opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri)


def _writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = _opened(folder)
        bundle, name = None, ""
        for b in _text.pieces(batches, "html", 8 << 20):
            rows = []
            for page, url, html, refers in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to"))):
                if bundle is None or bundle.bytes > BUNDLE_BYTES:
                    if bundle:
                        bundle.close()
                    # a name of its own for each attempt: what a lost or repeated task wrote is in no index
                    name = f"{uuid.uuid4().hex}.warc.zst"
                    bundle = Bundle(where.open_output_stream(f"{base}/{name}", compression=None))
                rows.append((page, f"{folder}/{name}", *bundle.add(record(page, url, (html or "").encode(), refers))))
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64()))], ["page_id", "bundle", "frame", "offset", "length"]
            )
        if bundle:
            bundle.close()

    return run


def write(pages: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """Write all pages below ``folder``; the index of the records, itself written there."""
    spark = pages.sparkSession
    _io.ship(spark)
    where, base = _opened(folder)
    where.create_dir(base, recursive=True)
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("key", F.sha1("html"))
    largest = rows.where(F.octet_length("html") >= least).groupBy("key").agg(F.max("page_id").alias("largest"), F.count("*").alias("copies"))
    largest = _io.saved(largest.where("copies > 1"), "largest")
    # payloads of many pages are few, and joined as they are; their pages then have keys that differ, and meet in no task
    many = _io.bounded(largest.where(F.col("copies") > MANY).select("key", F.col("largest").alias("of_many")), "many")
    few = largest.where(F.col("copies") <= MANY).select(F.col("key").alias("few_key"), F.col("largest").alias("of_few"))
    rows = rows.join(many, "key", "left").withColumn("few_key", F.expr("if(of_many is null, key, concat('many', cast(xxhash64(page_id, url) as string)))"))
    dealt = rows.join(few, "few_key", "left").withColumn("largest", F.coalesce("of_many", "of_few"))
    dealt = dealt.withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("largest")), F.col("largest")))
    index = dealt.select("page_id", "url", "html", "refers_to").mapInArrow(_writer(folder), INDEX)
    index.write.parquet(f"{folder}/index")
    _io.discarded(largest, many)
    return spark.read.schema(index.schema).parquet(f"{folder}/index")


def _reading(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    name, reader = "", None
    for b in batches:
        out = []
        for bundle, frame, offset, length in zip(*(b.column(c).to_pylist() for c in ("bundle", "frame", "offset", "length"))):
            if bundle != name:
                where, path = _opened(bundle)
                name, reader = bundle, Reader(where.open_input_file(path))
            r = parse(reader.record(frame, offset, length))
            out.append((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], r["url"], None if r["payload"] is None else r["payload"].decode()))
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays(
            [pa.array(x, t) for x, t in zip(zip(*out) if out else [[]] * len(kinds), kinds)],
            ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "html"],
        )


def read(index: DataFrame) -> DataFrame:
    """The records of an index, each checked against its digest; frames are dealt out evenly and read once each."""
    spark = index.sparkSession
    _io.ship(spark)
    return index.repartition(_io.parts(spark), "bundle", "frame").sortWithinPartitions("bundle", "frame", "offset").mapInArrow(_reading, READ)


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write the pages to the shared folder and read them back."""
    return read(write(pages, _io.fresh(pages.sparkSession, "warc"), least))
