"""WARC archives as seekable Zstandard bundles.

Records are grouped into frames that decompress on their own; a footer in a skippable frame lists the frame sizes, and
an index table maps each record to its bundle, frame and place in the frame. Of pages with equal payloads of at least
``MIN_REVISIT`` bytes, those with the smallest page id are responses and the others revisits that refer to it.

Tasks write bundles of their own below the shared folder; a repeated task writes new names and only the index rows of
the successful attempt are kept, so a lost executor leaves no reference to a broken file.

Defined cases: a null payload is empty; a null url has no target header; a null id is written as ``null``, never revisits
an equal null id and refers to the smallest known id; repeated ids stay responses if they equal the smallest id.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import mapped, saved
from tidegauge.session import scratch_path

MIN_REVISIT = 100
FRAME_BYTES = 256 * 1024
BUNDLE_BYTES = 64 * 1024 * 1024
LEVEL = 3
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
# fixed values of the seekable format
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1

INDEX = "page_id long, bundle string, frame_offset long, frame_size long, record_offset long, record_size long"
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record; a revisit keeps the HTTP header and leaves the payload out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    name = "null" if page_id is None else page_id
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{name}>"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%-._~')}")
    head += [f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha256:{digest}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes, start: int) -> tuple[dict, int]:
    """The record that begins at ``start`` and the place after it; the payload's digest is computed, not believed."""
    end = data.index(b"\r\n\r\n", start)
    version, *lines = data[start:end].decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError(f"no WARC record at byte {start}")
    fields = dict(line.split(": ", 1) for line in lines)
    block = data[end + 4 : end + 4 + int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(re.search(rb"Content-Length: (\d+)", http)[1])
    number = lambda field: None if (m := re.fullmatch(r"<urn:page:(-?\d+)>", fields.get(field, ""))) is None else int(m[1])
    revisit = fields["WARC-Type"] == "revisit"
    record = {
        "page_id": number("WARC-Record-ID"),
        "url": fields.get("WARC-Target-URI"),
        "record_type": fields["WARC-Type"],
        "refers_to": number("WARC-Refers-To"),
        "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha256:") if revisit else hashlib.sha256(payload).hexdigest(),
        "payload_bytes": length if revisit else len(payload),
        "payload": None if revisit else payload,
    }
    return record, end + 4 + len(block) + 4


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


class Bundle:
    """A bundle being written: records collect into a frame, frames into a file, the seek table ends it."""

    def __init__(self, folder: str, frame_bytes: int, level: int):
        self.path = f"{folder}/bundle-{uuid.uuid4().hex}.warc.zst"
        system, place = opened(self.path)
        system.create_dir(place.rsplit("/", 1)[0], recursive=True)
        self.out = system.open_output_stream(place, compression=None)
        self.press = zstandard.ZstdCompressor(level=level)
        self.frame_bytes, self.size = frame_bytes, 0
        self.parts, self.pending, self.filled = [], [], 0
        self.frames, self.rows = [], []

    def add(self, page_id: int | None, record: bytes) -> None:
        self.pending.append((page_id, self.filled, len(record)))
        self.parts.append(record)
        self.filled += len(record)
        if self.filled >= self.frame_bytes:
            self.flush()

    def flush(self) -> None:
        if not self.parts:
            return
        frame = self.press.compress(b"".join(self.parts))
        self.out.write(frame)
        self.rows += [(page_id, self.path, self.size, len(frame), offset, size) for page_id, offset, size in self.pending]
        self.frames.append((len(frame), self.filled))
        self.size += len(frame)
        self.parts, self.pending, self.filled = [], [], 0

    def close(self) -> list[tuple]:
        self.flush()
        entries = b"".join(struct.pack("<II", *sizes) for sizes in self.frames)
        footer = struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(entries) + len(footer)) + entries + footer)
        self.out.close()
        return self.rows


def seek_table(file) -> list[tuple[int, int]]:
    """(compressed, original) sizes of the frames, from the footer alone."""
    total = file.size()
    file.seek(total - 9)
    count, _, magic = struct.unpack("<IBI", file.read(9))
    if magic != SEEKABLE:
        raise ValueError("no seek table at the end of the file")
    file.seek(total - 9 - 8 * count)
    table = file.read(8 * count)
    return [struct.unpack_from("<II", table, 8 * k) for k in range(count)]


def _arrow(rows: list, schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    names = [(n, kinds[k]) for n, k in (x.split() for x in schema.split(", "))]
    columns = [pa.array([r[k] if isinstance(r, tuple) else r[n] for r in rows], t) for k, (n, t) in enumerate(names)]
    return pa.RecordBatch.from_arrays(columns, names=[n for n, _ in names])


def plan_records(pages: DataFrame) -> DataFrame:
    """Pages as records to be written: page_id, url, payload, digest, refers_to (null for responses).

    Only groups that hold revisits are joined back; they are aggregated before the shuffle, and a hot payload's rows
    carry ids and digests only.
    """
    records = pages.select(
        "page_id",
        "url",
        F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("digest", F.sha2("payload", 256))
    heads = saved(records.select("page_id", "digest", F.octet_length("payload").alias("size")), "payloads").where(f"size >= {MIN_REVISIT}")
    firsts = heads.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n"))
    firsts = saved(firsts.where("n > 1 and refers_to is not null").drop("n"), "firsts")
    revisits = heads.join(firsts, "digest").where("not page_id <=> refers_to").select("page_id", "digest", "refers_to").distinct()
    revisits = saved(revisits, "revisits").select(F.col("page_id").alias("r_id"), F.col("digest").alias("r_digest"), "refers_to")
    same = F.col("page_id").eqNullSafe(F.col("r_id")) & (F.col("digest") == F.col("r_digest"))
    return records.join(revisits, same, "left").select("page_id", "url", "payload", "digest", "refers_to")


def write_archives(records: DataFrame, folder: str | None = None, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Write the planned records; returns the written index, one row per record."""
    folder = folder or scratch_path(records.sparkSession, "warc")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle = None
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                for row in batch.slice(k, 256).to_pylist():
                    bundle = bundle or Bundle(folder, frame_bytes, LEVEL)
                    bundle.add(row["page_id"], record_bytes(*row.values()))
                    if bundle.size >= bundle_bytes:
                        yield _arrow(bundle.close(), INDEX)
                        bundle = None
        if bundle:
            yield _arrow(bundle.close(), INDEX)

    return saved(mapped(records.select("page_id", "url", "payload", "digest", "refers_to"), write, INDEX), "warc-index")


def read_archives(index: DataFrame, payloads: bool = True) -> DataFrame:
    """Every record of the index's bundles, frame after frame along the seek table; ``payloads``: return them too."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, place = opened(path)
                with system.open_input_file(place) as file:
                    at = 0
                    for packed, original in seek_table(file):
                        file.seek(at)
                        data, start, rows = unpack.decompress(file.read(packed), original), 0, []
                        at += packed
                        while start < len(data):
                            row, start = parse_record(data, start)
                            rows.append(row if payloads else row | {"payload": None})
                        yield _arrow(rows, RECORDS)

    bundles = index.select("bundle").distinct()
    return mapped(bundles.repartition(max(1, bundles.count()), "bundle"), read, RECORDS)


def fetch_records(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """The records of ``wanted`` page ids only: each is cut from its own frame, nothing else is read."""

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            rows = []
            for entry in batch.to_pylist():
                system, place = opened(entry["bundle"])
                with system.open_input_file(place) as file:
                    file.seek(entry["frame_offset"])
                    data = unpack.decompress(file.read(entry["frame_size"]))
                first = entry["record_offset"]
                rows.append(parse_record(data[first : first + entry["record_size"]], 0)[0])
            if rows:
                yield _arrow(rows, RECORDS)

    return mapped(index.join(wanted.select("page_id").distinct(), "page_id", "left_semi"), fetch, RECORDS)
