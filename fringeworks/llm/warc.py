"""WARC archives as seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each with a few whole WARC
records, and a footer: a skippable frame with the seek table (the sizes of every
frame, compressed and not).  The writer returns for each record its bundle, its
frame and its offset within the decompressed frame, so one record is read by
decompressing one frame.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import new_folder, stored
from ._text import table

#: Bytes of records after which a frame ends, and bytes of frames after which a bundle ends.
FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 16 << 20
LEVEL = 3

# fixed values of the Zstandard seekable format
SKIPPABLE = 0x184D2A5E
SEEKABLE = 0x8F92EAB1

_PLACES = pa.schema([("bundle", pa.string()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64()), ("record_id", pa.string())])
_READ = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("whole", pa.bool_())])


def record_id(page_id: int) -> str:
    return f"<urn:page:{page_id}>"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC/1.1 record: a response with its payload, or a revisit without."""
    kind = "response" if refers_to is None else "revisit"
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest(payload)}", f"WARC-Payload-Length: {len(payload)}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c.isprintable() else "%{:02X}".format(ord(c)) for c in url))
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}"]
    block = payload if refers_to is None else b""
    head += ["Content-Type: text/html", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def parsed(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """Headers and block of the record at ``at``, and where the next one begins."""
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("no WARC record here")
    head = dict(x.split(": ", 1) for x in lines[1:])
    size = int(head["Content-Length"])
    return head, data[end + 4 : end + 4 + size], end + 8 + size


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    """Footer: a skippable frame of (compressed, decompressed) sizes."""
    body = b"".join(struct.pack("<II", a, b) for a, b in sizes) + struct.pack("<IBI", len(sizes), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(file) -> list[tuple[int, int, int]]:
    """(offset, compressed, decompressed) of every frame of an open bundle."""
    size = file.seek(0, io.SEEK_END)
    file.seek(size - 9)
    count, _, magic = struct.unpack("<IBI", file.read(9))
    if magic != SEEKABLE:
        raise ValueError("no seek table at the end of the bundle")
    file.seek(size - 9 - 8 * count)
    pairs = struct.unpack(f"<{2 * count}I", file.read(8 * count))
    out, at = [], 0
    for a, b in zip(pairs[::2], pairs[1::2], strict=True):
        out.append((at, a, b))
        at += a
    return out


def read_frame(file, frame: tuple[int, int, int]) -> bytes:
    file.seek(frame[0])
    return zstandard.ZstdDecompressor().decompress(file.read(frame[1]), max_output_size=frame[2])


def _opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def write_bundles(pages: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """Writes a record for each page; returns (bundle, frame, offset, length, record_id) of each.

    pages: page_id, url, html.  folder: a URI that all executors reach.  Of
    records with equal payloads of at least ``min_bytes`` bytes the one with the
    largest page_id is a response and the others revisit it.
    """
    light = pages.select("page_id", F.sha1(F.coalesce("html", F.lit("")).cast("binary")).alias("sha"), F.octet_length(F.coalesce("html", F.lit(""))).alias("size"))
    groups = light.filter(F.col("size") >= min_bytes).groupBy("sha", "size").agg(F.max("page_id").alias("target"), F.min("page_id").alias("least"))
    copies = groups.filter("target <> least").select("sha", "size", "target")
    revisits = light.join(copies, ["sha", "size"]).filter("page_id <> target").select("page_id", "target").distinct()
    rows = pages.select("page_id", "url", "html").join(revisits.hint("shuffle_hash"), "page_id", "left").select("page_id", "url", F.col("html").cast("binary").alias("html"), "target")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _opened(folder)
        pack = zstandard.ZstdCompressor(level=LEVEL)
        frame, places, written, sizes, out, name = [], [], [], [], None, ""
        held = at = 0

        def end_frame() -> None:
            nonlocal frame, places, held
            if frame:
                raw = b"".join(frame)
                small = pack.compress(raw)
                out.write(small)
                written.extend((name, len(sizes), *x) for x in places)
                sizes.append((len(small), len(raw)))
                frame, places, held = [], [], 0

        def end_bundle() -> Iterator[pa.RecordBatch]:
            nonlocal out, written, sizes, at
            if out is not None:
                end_frame()
                out.write(seek_table(sizes))
                out.close()
                system.move(f"{root}/{name}.part", f"{root}/{name}")  # a bundle is either whole or absent
                yield table(_PLACES, [list(x) for x in zip(*written, strict=True)])
                out, written, sizes, at = None, [], [], 0

        for whole in batches:
            for row in whole.to_pylist():
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.zst"  # a second attempt of a task writes other files
                    out = system.open_output_stream(f"{root}/{name}.part")
                data = record(row["page_id"], row["url"], row["html"] or b"", row["target"])
                places.append((held, len(data), record_id(row["page_id"])))
                frame.append(data)
                held += len(data)
                at += len(data)
                if held >= FRAME_BYTES:
                    end_frame()
                if at >= BUNDLE_BYTES:
                    yield from end_bundle()
        yield from end_bundle()

    system, root = _opened(folder)
    system.create_dir(root, recursive=True)
    return rows.mapInArrow(write, "bundle string, frame int, offset long, length long, record_id string")


def read_bundles(places: DataFrame, folder: str) -> DataFrame:
    """Every record of the bundles named in ``places``, from the archives alone.

    payload is null for a revisit; whole: the payload has the size and digest
    that the record states.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _opened(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with system.open_input_file(f"{root}/{name}") as file:
                    for frame in read_seek_table(file):
                        data, at, rows = read_frame(file, frame), 0, []
                        while at < len(data):
                            head, block, at = parsed(data, at)
                            kind = head["WARC-Type"]
                            size, sha = int(head["WARC-Payload-Length"]), head["WARC-Payload-Digest"].removeprefix("sha1:")
                            number = lambda x: int(x.removeprefix("<urn:page:").removesuffix(">"))
                            target = head.get("WARC-Refers-To")
                            whole = kind == "revisit" or (len(block) == size and digest(block) == sha)
                            rows.append((number(head["WARC-Record-ID"]), head.get("WARC-Target-URI"), block if kind == "response" else None, size, sha, kind, number(target) if target else None, whole))
                        yield table(_READ, [list(x) for x in zip(*rows, strict=True)])

    bundles = places.select("bundle").distinct()
    bundles = bundles.repartition(max(1, bundles.count()))  # a task for each bundle, or nearly so
    return bundles.mapInArrow(read, "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long, whole boolean")


def read_records(places: DataFrame, folder: str) -> DataFrame:
    """(record_id, record): single records by random access, one frame read for each."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("record_id", pa.string()), ("record", pa.binary())])
        system, root = _opened(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with system.open_input_file(f"{root}/{row['bundle']}") as file:
                    data = read_frame(file, read_seek_table(file)[row["frame"]])
                yield table(schema, [[row["record_id"]], [data[row["offset"] : row["offset"] + row["length"]]]])

    return places.select("bundle", "frame", "offset", "length", "record_id").mapInArrow(read, "record_id string, record binary")


def archive(pages: DataFrame, folder: str | None = None, min_bytes: int = 0) -> tuple[DataFrame, DataFrame, str]:
    """Writes the pages and reads the archives back: (index, records, folder).

    pages: page_id, url, html; other columns are ignored.  A null html is an
    empty payload, and a null url leaves the header out.  Rows with a null
    page_id are left out, as a record needs its id.  A repeated page_id gives
    repeated records under one record id; they revisit a larger page_id of the
    same payload, or else are all responses.  WARC-Payload-Length, which readers
    of WARC/1.1 ignore, is an extension: a revisit has no payload to measure.  An empty table gives no bundles and no records.
    """
    folder = folder or new_folder(pages.sparkSession, "warc")
    plain = pages.select(F.col("page_id").cast("long"), "url", "html").filter("page_id is not null")
    index = stored(write_bundles(plain, folder, min_bytes), "warc-index")
    return index, read_bundles(index, folder), folder
