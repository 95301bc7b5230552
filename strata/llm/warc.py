"""WARC records in seekable Zstandard bundles: independent frames, a seek table as footer, and an index of records.

Bundles are files in the session's shared folder; the index is a table with a row per bundle.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from .common import files, portions, scratch, stored

FRAME = 1 << 18
BUNDLE = 64 << 20
#: Fixed values of the seekable format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
FIELDS = "page_id:bigint,first:bigint,none:boolean,frame:bigint,offset:bigint,length:bigint"


def record_id(page_id: int | None, digest: str) -> str:
    """The URI of a page's record: the same for the same id and payload."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'{page_id}|{digest}'.encode()).digest(), version=4)}>"


def record(page_id: int | None, url: str, payload: bytes, revisit: bool, first: int | None = None, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """A response with the payload, or a revisit without one that names the response of page ``first``."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    body = f"HTTP/1.1 200 OK\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + (b"" if revisit else payload)
    uri = "".join(c for c in url if c not in "\r\n")
    # a revisit may have the id and payload of its response, and then needs another URI
    own = record_id(page_id, digest) if not revisit else f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}|{digest}|{uri}|revisit')}>"
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {own}", f"WARC-Date: {date}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest}"]
    if revisit:
        head += [f"WARC-Refers-To: {record_id(first, digest)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join([*head, "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def footer(frames: list[tuple[int, int]]) -> bytes:
    """The seek table in a skippable frame, of (compressed size, size) of each frame."""
    table = b"".join(struct.pack("<II", *f) for f in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(table)) + table


def seek_table(tail: bytes, count: int) -> list[tuple[int, int, int]]:
    """(offset, compressed size, size) of each frame, from the last 8 * count + 9 bytes of a bundle."""
    out, at = [], 0
    for packed, size in struct.iter_unpack("<II", tail[: 8 * count]):
        out.append((at, packed, size))
        at += packed
    return out


def open_bundle(file) -> list[tuple[int, int, int]]:
    """Reads the seek table of an open bundle."""
    size = file.size()
    file.seek(size - 9)
    count, _, magic = struct.unpack("<IBI", file.read(9))
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    file.seek(size - 9 - 8 * count)
    return seek_table(file.read(8 * count + 9), count)


def _keys(page_id: str = "page_id") -> list[Column]:
    return [F.coalesce(F.col(page_id).cast("string"), F.lit("")).alias("_id"), F.col(page_id).isNull().alias("_none"), F.xxhash64("url").alias("_url"), F.sha1(F.col("html").cast("binary")).alias("_mark")]


def write_bundles(pages: DataFrame, least: int = 0, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """The index: archive (path), records: page_id, first (the response's page_id), none (it is a response), frame, offset
    in the frame, length. Every row of ``pages`` is a record.

    Of equal payloads (null html: empty) of at least ``least`` bytes the smallest page_id, null last, is the response, of
    equal ids one of the smallest url; the others revisit it. Rows that are alike in all three are written by one task,
    which makes the first a response. Each attempt of a task writes files of its own names, and the index names only those
    of the attempt that counted. An empty table gives an empty index; other columns are ignored. The table has no dates:
    ``date`` stands in all records.
    """
    spark = pages.sparkSession
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    id_type = rows.schema["page_id"].dataType.simpleString()
    if id_type not in ("bigint", "int"):
        raise ValueError("page_id must be an integer")
    marks = rows.filter(F.octet_length("html") >= least).select(F.col("page_id").cast("long").alias("page_id"), "url", *_keys())
    alike = marks.groupBy("_mark", "_none", "page_id", "url", "_id", "_url").agg(F.count("*").alias("n"))
    # copies are summed up before they meet, so a large group of equal pages is a row for each of its ids at most
    firsts = alike.groupBy("_mark").agg(F.sum("n").alias("m"), F.min(F.struct("_none", "page_id", "url")).alias("least")).filter("m > 1")
    same = (F.col("page_id").eqNullSafe(F.col("least.page_id"))) & (F.col("url") == F.col("least.url"))
    roles = alike.join(firsts, "_mark").groupBy("_id", "_none", "_url", "_mark").agg(F.first(F.col("least.page_id")).alias("first"), F.max(same).alias("leads"))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    folder = f"{scratch(spark)}/warc-{uuid.uuid4().hex}"
    store, inside = files(folder)
    store.create_dir(inside)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, inside = files(folder)
        packer = zstandard.ZstdCompressor(level=3)
        kind = pa.list_(pa.struct([("page_id", pa.int64()), ("first", pa.int64()), ("none", pa.bool_()), ("frame", pa.int64()), ("offset", pa.int64()), ("length", pa.int64())]))
        led: set[bytes] = set()  # payloads whose response this task has written
        out, name, frames, index, open_, held, total = None, "", [], [], [], 0, 0

        def close_frame() -> None:
            nonlocal open_, held
            if open_:
                packed = packer.compress(b"".join(open_))
                out.write(packed)
                frames.append((len(packed), held))
                open_, held = [], 0

        def close_bundle() -> pa.RecordBatch:
            nonlocal out, frames, index, total
            close_frame()
            out.write(footer(frames))
            out.close()
            made = pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([index], kind)], ["archive", "records"])
            out, frames, index, total = None, [], [], 0
            return made

        for batch in portions(batches, "html"):
            for page, url, html, first, leads in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                payload, revisit = html.encode(), False
                if leads is not None:
                    mark = hashlib.sha1(payload).digest()
                    revisit = not leads or mark in led
                    if leads:
                        led.add(mark)
                data = record(page, url, payload, revisit, first, date)
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.zst"
                    out = store.open_output_stream(f"{inside}/{name}", compression=None)  # the name alone would have it compressed again
                index.append({"page_id": page, "first": first if revisit else None, "none": not revisit, "frame": len(frames), "offset": held, "length": len(data)})
                open_.append(data)
                held += len(data)
                total += len(data)
                if held >= FRAME:
                    close_frame()
                if total >= BUNDLE:
                    yield close_bundle()
        if index:
            yield close_bundle()

    keyed = rows.select("page_id", "url", "html", *_keys()).join(roles, ["_id", "_none", "_url", "_mark"], "left")
    ready = keyed.repartition(parts, "_id", "_none", "_url", "_mark").select(F.col("page_id").cast("long").alias("page_id"), "url", "html", "first", "leads")
    return stored(ready.mapInArrow(write, f"archive string, records array<struct<{FIELDS}>>"), "warc")


def parsed(one: bytes) -> tuple[dict[str, str], int, bytes]:
    """Headers, payload size and payload (empty for a revisit) of a record."""
    head, _, rest = one.partition(b"\r\n\r\n")
    names = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    http, _, body = rest.partition(b"\r\n\r\n")
    size = int(http.rpartition(b"Content-Length: ")[2])
    return names, size, body[:size] if names["WARC-Type"] == "response" else b""


def read_bundles(index: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each record, read from the bundles through their
    seek tables; frames are read one by one. Damaged records raise."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
        for batch in batches:
            for archive, records in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, inside = files(archive)
                at, frame, rows = -1, b"", []
                with store.open_input_file(inside) as file:
                    table = open_bundle(file)
                    for x in records:
                        if x["frame"] != at:
                            at = x["frame"]
                            low, packed, size = table[at]
                            file.seek(low)
                            frame = unpack.decompress(file.read(packed), max_output_size=size)
                        names, size, payload = parsed(frame[x["offset"] : x["offset"] + x["length"]])
                        digest, kind = names["WARC-Payload-Digest"].removeprefix("sha1:"), names["WARC-Type"]
                        refers = names.get("WARC-Refers-To")
                        if kind == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest or refers and refers != record_id(x["first"], digest):
                            raise ValueError(f"record {x['page_id']} of {archive} is damaged")
                        rows.append((x["page_id"], size, digest, kind, x["first"]))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return index.mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def fetch(archive: str, entry: dict) -> bytes:
    """One record of a bundle by its index entry: only its frame is read."""
    store, inside = files(archive)
    with store.open_input_file(inside) as file:
        low, packed, size = open_bundle(file)[entry["frame"]]
        file.seek(low)
        frame = zstandard.ZstdDecompressor().decompress(file.read(packed), max_output_size=size)
    return frame[entry["offset"] : entry["offset"] + entry["length"]]
