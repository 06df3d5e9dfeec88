"""WARC archives as seekable Zstandard bundles.

A bundle is a series of independent Zstandard frames, each holding some whole records,
and a last skippable frame with the seek table of the Zstandard seekable format: the
compressed and uncompressed size of every frame. The index maps a record identifier to
its bundle, frame and offset in the frame, so one record costs one frame to read.

A payload that occurs more than once is stored once, in the record with the largest
identifier; the others are revisit records that refer to it.
"""

from __future__ import annotations

import base64
import hashlib
import os
import struct
import uuid

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tapeforge.llm.common import slices
from tapeforge.session import cut_lineage

FRAME_BYTES = 1 << 20   # of records per frame, before compression; a larger record is a frame of its own
LEVEL = 3
# Fixed values of the Zstandard seekable format and of the record profile.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"  # the pages carry no capture time
INDEX = "page_id long, bundle string, frame int, offset long, length long"


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + os.path.abspath(uri))


def _one_line(text: str | None) -> str:
    """A header value: anything that would end the line or isn't printable is percent-encoded."""
    return "".join(c if c.isprintable() else "".join("%%%02X" % b for b in c.encode("utf-8", "surrogatepass"))
                   for c in text or "")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record. A revisit keeps the HTTP headers, which tell the payload's size, and drops the payload."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{page_id}>",
             f"WARC-Target-URI: {_one_line(url)}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}",
             "Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}"]
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """(headers, body, end) of the record that begins at ``at``."""
    cut = data.index(b"\r\n\r\n", at)
    lines = data[at:cut].decode("utf-8", "surrogatepass").split("\r\n")
    headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    start = cut + 4
    end = start + int(headers["Content-Length"])
    if data[end:end + 4] != b"\r\n\r\n":
        raise ValueError(f"record at {at} doesn't end where its length says")
    return headers, data[start:end], end + 4


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The footer: a skippable frame of (compressed, uncompressed) sizes."""
    table = b"".join(struct.pack("<II", *f) for f in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(table)) + table


def frame_table(f) -> list[tuple[int, int, int]]:
    """(start, compressed size, uncompressed size) of a bundle's frames, read from its end."""
    size = f.size()
    f.seek(size - 9)
    count, _, magic = struct.unpack("<IBI", f.read(9))
    if magic != SEEKABLE:
        raise ValueError("not a seekable bundle")
    f.seek(size - 9 - 8 * count)
    out, start = [], 0
    for packed, plain in struct.iter_unpack("<II", f.read(8 * count)):
        out.append((start, packed, plain))
        start += packed
    return out


def read_frame(f, frame: tuple[int, int, int]) -> bytes:
    f.seek(frame[0])
    return zstandard.ZstdDecompressor().decompress(f.read(frame[1]), max_output_size=frame[2])


def _writer(folder: str, frame_bytes: int):
    """One bundle per task attempt; only the bundles of finished tasks get into the index."""

    def run(batches):
        store, at = _store(folder)
        store.create_dir(at, recursive=True)
        name = f"bundle-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex[:12]}.warc.zst"
        zip_ = zstandard.ZstdCompressor(level=LEVEL)
        frames: list[tuple[int, int]] = []
        held: list[bytes] = []
        size = 0

        def flush(f):
            nonlocal held, size
            if held:
                packed = zip_.compress(b"".join(held))
                f.write(packed)
                frames.append((len(packed), size))
                held, size = [], 0

        with store.open_output_stream(f"{at}/{name}", compression=None) as f:
            for b in slices(batches, 64):
                out: list[list] = [[], [], [], [], []]
                for r in b.to_pylist():
                    rec = record(r["page_id"], r["url"], (r["html"] or "").encode("utf-8", "surrogatepass"),
                                 r["refers_to"], r["revisit"])
                    if size and size + len(rec) > frame_bytes:
                        flush(f)
                    for c, v in zip(out, (r["page_id"], name, len(frames), size, len(rec))):
                        c.append(v)
                    held.append(rec)
                    size += len(rec)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64()))],
                    ["page_id", "bundle", "frame", "offset", "length"])
            flush(f)
            f.write(seek_table(frames))

    return run


def write(pages: DataFrame, folder: str, min_revisit_bytes: int = 0, frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """Write a record for every row of ``pages`` (page_id, url, html); returns the index (page_id, bundle, frame,
    offset, length).

    Of the rows whose payloads are equal and have ``min_revisit_bytes`` at least, the one with the largest page_id
    is the response and the others revisit it. Payloads are equal if size and SHA-1 are. A null html is an empty
    payload; a null url an empty target. Rows that repeat the largest page_id of a group are all responses, and
    so is every row of a group without any page_id. Extra columns are ignored; an empty table has an empty index.
    """
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", "html", F.sha1(payload).alias("digest"), F.octet_length(payload).alias("size"))
    groups = (rows.where(F.col("size") >= min_revisit_bytes).groupBy("digest", "size")
              .agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    groups = cut_lineage(groups)
    marked = rows.join(groups, ["digest", "size"], "left")
    revisit = F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    marked = marked.select("page_id", "url", "html", F.when(revisit, F.col("keeper")).alias("refers_to"),
                           revisit.alias("revisit"))
    return cut_lineage(marked.mapInArrow(_writer(folder, frame_bytes), INDEX))


def read(spark: SparkSession, index: DataFrame, folder: str) -> DataFrame:
    """Every record of the bundles that the index names, frame by frame: (page_id, url, payload_bytes, payload_digest,
    record_type, refers_to). Payloads of responses are hashed anew and must agree with their headers."""
    schema = ("page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")

    def number(urn: str | None) -> int | None:
        return int(urn[10:-1]) if urn and urn != "<urn:page:None>" else None

    def run(batches):
        store, at = _store(folder)
        for b in batches:
            for name, frame in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                with store.open_input_file(f"{at}/{name}") as f:
                    data = read_frame(f, frame_table(f)[frame])
                out: list[list] = [[], [], [], [], [], []]
                pos = 0
                while pos < len(data):
                    h, body, pos = parse(data, pos)
                    head = body.index(b"\r\n\r\n") + 4
                    n = int(body[:head].split(b"Content-Length: ")[1].split(b"\r\n")[0])
                    digest = h["WARC-Payload-Digest"][5:]
                    if h["WARC-Type"] == "response":
                        own = base64.b32encode(hashlib.sha1(body[head:]).digest()).decode()
                        if own != digest or len(body) - head != n:
                            raise ValueError(f"damaged payload in {name}")
                    for c, v in zip(out, (number(h["WARC-Record-ID"]), h["WARC-Target-URI"], n, digest, h["WARC-Type"],
                                          number(h.get("WARC-Refers-To")))):
                        c.append(v)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(),
                                                          pa.int64()))],
                    ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    frames = index.groupBy("bundle").agg(F.max("frame").alias("last"))
    frames = frames.select("bundle", F.explode(F.sequence(F.lit(0), "last")).alias("frame"))
    tasks = max(1, min(frames.count(), 4096))
    return frames.repartition(tasks).mapInArrow(run, schema)


def lookup(index: DataFrame, folder: str, wanted: Column) -> DataFrame:
    """(page_id, record): the raw records that ``wanted`` selects from the index, reading one frame for each."""

    def run(batches):
        store, at = _store(folder)
        for b in slices(batches, 64):
            out = []
            for r in b.to_pylist():
                with store.open_input_file(f"{at}/{r['bundle']}") as f:
                    data = read_frame(f, frame_table(f)[r["frame"]])
                out.append(data[r["offset"]:r["offset"] + r["length"]])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["page_id", "record"])

    return index.where(wanted).mapInArrow(run, "page_id long, record binary")
