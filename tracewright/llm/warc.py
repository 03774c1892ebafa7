"""WARC archives as seekable Zstandard bundles.

Records are grouped into independent Zstandard frames; a skippable frame at the end of each bundle is the seek table of
the public seekable format (compressed and plain size of every frame), and a manifest maps each record to its bundle,
frame and offset within the frame. A reader fetches one record by decompressing one frame, and a scan deals frames out
to tasks. Bundles lie in a folder that driver and executors share; names differ by attempt, so a repeated task never
touches a file that another one has written, and only files that the written manifest names are read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm.common import join_hot, materialize, shared_dir

#: Magic numbers of the Zstandard seekable format (published constants).
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
#: Repeated payloads whose first ids are broadcast (about 100 bytes each), and packed bytes that a reading task gets.
BROADCAST_GROUPS, TASK_BYTES = 500_000, 32 << 20
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
MANIFEST = "record_id string, file string, frame int, offset long, length long"
RECORD = "record_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string, payload binary"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(record_id: str | None) -> str:
    return "<urn:record:" + ("" if record_id is None else "=" + quote(record_id, safe="")) + ">"


def _from_urn(urn: str | None) -> str | None:
    return unquote(urn[len("<urn:record:=") : -1]) if urn and urn.startswith("<urn:record:=") else None


def format_record(record_id: str | None, url: str | None, payload: bytes, payload_digest: str, refers_to: str | None) -> bytes:
    """One WARC record; with refers_to a revisit, whose block has the HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to is not None else 'response'}", f"WARC-Record-ID: {_urn(record_id)}", f"WARC-Date: {DATE}"]
    head += [f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%')}"] if url is not None else []
    head += [f"WARC-Payload-Digest: sha1:{payload_digest}", "Content-Type: application/http;msgtype=response"]
    head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {_urn(refers_to)}"] if refers_to is not None else []
    return "\r\n".join([*head, f"Content-Length: {len(block)}"]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: memoryview | bytes, at: int = 0) -> tuple[dict, int]:
    """The record at this place, and where the next one begins; ValueError if it is damaged or its payload doesn't have its digest."""
    data = bytes(data) if not isinstance(data, bytes) else data
    end = data.find(b"\r\n\r\n", at)
    lines = data[at:end].decode().split("\r\n")
    if end < 0 or lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    head = dict(x.split(": ", 1) for x in lines[1:])
    block = data[end + 4 : (stop := end + 4 + int(head["Content-Length"]))]
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise ValueError("a WARC record is cut short")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    sha = head["WARC-Payload-Digest"].removeprefix("sha1:")
    revisit = head["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != size or digest(payload) != sha):
        raise ValueError("a payload doesn't match its digest")
    return {"record_id": _from_urn(head["WARC-Record-ID"]), "url": unquote(head["WARC-Target-URI"]) if "WARC-Target-URI" in head else None, "payload_bytes": size, "payload_digest": sha, "record_type": head["WARC-Type"], "refers_to": _from_urn(head.get("WARC-Refers-To")), "payload": None if revisit else payload}, stop + 4


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    body = b"".join(struct.pack("<II", *s) for s in sizes) + struct.pack("<IBI", len(sizes), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(f, size: int) -> list[tuple[int, int, int]]:
    """Offset, compressed and plain size of every frame of an open bundle of this size."""
    f.seek(size - 9)
    n, _, magic = struct.unpack("<IBI", f.read(9))
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    f.seek(size - 9 - 8 * n)
    table, at, out = f.read(8 * n), 0, []
    for i in range(n):
        packed, plain = struct.unpack_from("<II", table, 8 * i)
        out.append((at, packed, plain))
        at += packed
    return out


class BundleWriter:
    """Frames of at least frame_bytes of records, but for the last; close() appends the seek table."""

    def __init__(self, uri: str, frame_bytes: int, level: int = 3):
        fs, path = pafs.FileSystem.from_uri(uri)
        fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
        self.uri, self.out, self.frame_bytes = uri, fs.open_output_stream(path, compression=None), frame_bytes
        self.pack, self.held, self.size, self.sizes = zstandard.ZstdCompressor(level=level).compress, [], 0, []

    def add(self, record: bytes) -> tuple[int, int, int]:
        """Frame, offset in the frame, length."""
        place = (len(self.sizes), self.size, len(record))
        self.held.append(record)
        self.size += len(record)
        if self.size >= self.frame_bytes:
            self._flush()
        return place

    def _flush(self) -> None:
        if self.held:
            plain = b"".join(self.held)
            packed = self.pack(plain)
            self.out.write(packed)
            self.sizes.append((len(packed), len(plain)))
            self.held, self.size = [], 0

    def close(self) -> None:
        self._flush()
        self.out.write(seek_table(self.sizes))
        self.out.close()


def write_bundles(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0, frame_bytes: int = 1 << 18, bundle_frames: int = 4096) -> DataFrame:
    """Write a record per row and return the written manifest (record_id, file, frame, offset, length).

    Of rows with equal payloads of at least least_bytes, the one with the smallest id is a response and the others
    revisit it; rows that share that smallest id are all responses, as are equal payloads without any id. Payloads are
    equal if their SHA-1, XXH64 and length are. A null payload is empty; null urls are left out of the record. An empty
    table gives an empty manifest. Payloads aren't shuffled: only narrow rows are grouped, and the repeated payloads'
    first ids are broadcast up to BROADCAST_GROUPS of them; beyond that, those of frequent payloads are.
    """
    spark = pages.sparkSession
    folder = folder or shared_dir(spark, "warc")
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    key = ["__sha", "__hash", "__size"]
    base = pages.select(F.col(id_col).alias("__id"), F.col(url_col).cast("string").alias("__url"), payload.alias("__payload"))
    base = base.withColumns({"__sha": F.sha1("__payload"), "__hash": F.xxhash64("__payload"), "__size": F.octet_length("__payload")})
    counts = base.groupBy(*key).agg(F.min("__id").alias("__first"), F.count("*").alias("__n"))
    groups = materialize(counts.where("__n > 1"), "warc-groups")
    if groups.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS:
        marked = base.join(F.broadcast(groups.drop("__n")), key, "left")
    else:
        marked = join_hot(base, groups, key, "__n", int(groups.agg(F.sum("__n")).first()[0]), "left")
    refers = F.when((F.col("__size") >= least_bytes) & ~F.col("__id").eqNullSafe(F.col("__first")), F.col("__first").cast("string"))
    rows = marked.select(F.col("__id").cast("string").alias("id"), F.col("__url").alias("url"), F.col("__payload").alias("payload"), refers.alias("refers"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle = None
        for batch in batches:
            out: list[tuple] = []
            for rid, url, data, to in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if bundle is None:
                    bundle = BundleWriter(f"{folder}/{uuid.uuid4().hex}.warc.zst", frame_bytes)
                out.append((rid, bundle.uri, *bundle.add(format_record(rid, url, data, digest(data), to))))
                if len(bundle.sizes) >= bundle_frames:
                    bundle.close()
                    bundle = None
            cols = list(zip(*out, strict=True)) or [()] * 5
            kinds = (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["record_id", "file", "frame", "offset", "length"])
        if bundle is not None:
            bundle.close()

    return materialize(rows.mapInArrow(run, MANIFEST), "warc-manifest")


def read_bundles(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """Every record of the bundles that the manifest names, frames dealt out by their seek tables to tasks of about TASK_BYTES."""

    def footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                fs, path = pafs.FileSystem.from_uri(uri)
                with fs.open_input_file(path) as f:
                    rows = read_seek_table(f, f.size())
                yield pa.RecordBatch.from_arrays([pa.array([uri] * len(rows), pa.string()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())], names=["file", "at", "packed", "plain"])

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for uri, at, packed, plain in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                fs, path = pafs.FileSystem.from_uri(uri)
                with fs.open_input_file(path) as f:
                    f.seek(at)
                    data = unpack.decompress(f.read(packed), max_output_size=plain)
                got, place = [], 0
                while place < len(data):
                    r, place = parse_record(data, place)
                    got.append(r if payloads else r | {"payload": None})
                names = ["record_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
                kinds = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in got], k) for n, k in zip(names, kinds, strict=True)], names=names)

    files = manifest.select("file").distinct()
    frames = materialize(files.mapInArrow(footers, "file string, at long, packed long, plain long"), "warc-frames")
    packed = frames.agg(F.coalesce(F.sum("packed"), F.lit(0))).first()[0]
    # an explicit number of partitions, which adaptive execution doesn't merge: rows here are small, their frames aren't
    tasks = max(manifest.sparkSession.sparkContext.defaultParallelism, -(-packed // TASK_BYTES))
    return frames.repartition(tasks, "file", "at").sortWithinPartitions("file", "at").mapInArrow(records, RECORD)


def read_record(file: str, frame: int, offset: int, length: int) -> dict:
    """One record by its place in the manifest: a footer and one frame are read."""
    fs, path = pafs.FileSystem.from_uri(file)
    with fs.open_input_file(path) as f:
        at, packed, plain = read_seek_table(f, f.size())[frame]
        f.seek(at)
        data = zstandard.ZstdDecompressor().decompress(f.read(packed), max_output_size=plain)
    return parse_record(data[offset : offset + length])[0]


def digests(spark: SparkSession, pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """Write pages, read the bundles back, and describe each record."""
    kind = dict(pages.dtypes)[id_col]
    read = read_bundles(write_bundles(pages, id_col=id_col), payloads=False)
    return read.select(F.col("record_id").cast(kind).alias(id_col), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))
