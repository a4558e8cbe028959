"""WARC archives in Zstandard frames with a dictionary: writer and reader (operator 9).

An archive opens with a skippable frame that carries the dictionary; every record is one
frame after it.  Of records with equal payloads the one with the largest page_id is a
response, the others are revisits that refer to it.

Writing takes one pass that compresses each page's response where it is read, a small join
with the payloads that recur, and one pass that writes archive files of bounded size to the
shared folder.  Payloads are never shuffled and a payload that very many pages share is one
row of the small side.  File names follow the task's partition, so a retried task replaces
its own files.

Defined results: a null html is an empty payload; a null url has no URI header and reads
back as null; a null page_id never is the largest, and is a response only where all ids of
its payload are null; repeated rows give equal records; an empty table gives no archives;
columns beside page_id, url and html are ignored.  The reader names what is wrong with a
record in ``problem`` and goes on.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.llm.bytetext import tidy
from spanforge.llm.storage import dropped, new_path, written

DICT_MAGIC = 0x184D2A5D
DICT_BYTES = 32 << 10
TRAIN_PAGES = 256
TRAIN_CHARS = 16_384
ARCHIVE_BYTES = 32 << 20
BROADCAST_ROWS = 1_000_000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def train_dictionary(pages: DataFrame) -> bytes:
    """A dictionary from a bounded sample; empty where the sample is too small to train on."""
    sample = pages.select(F.substring("html", 1, TRAIN_CHARS).alias("h"), F.xxhash64("page_id").alias("o")).where("h <> ''").orderBy("o", "h").limit(TRAIN_PAGES)
    texts = [r[0].encode() for r in sample.collect()]
    try:
        return zstandard.train_dictionary(DICT_BYTES, texts).as_bytes() if len(texts) >= 16 else b""
    except zstandard.ZstdError:
        return b""


def _name(page_id: int | None) -> str:
    return f"<urn:x-page:{'none' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes | None, size: int, digest: str, refers_to: int | None = None) -> bytes:
    """The bytes of one record; without payload it is a revisit."""
    fields = [("WARC-Type", "response" if payload is not None else "revisit"), ("WARC-Record-ID", _name(page_id)), ("WARC-Date", DATE), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", str(size))]
    if url is not None:
        plain = url == url.strip() and url.isprintable()
        fields.append(("WARC-Target-URI", url) if plain else ("X-Target-URI-Base64", base64.b64encode(url.encode("utf-8", "surrogatepass")).decode()))
    if payload is None:
        fields += [("WARC-Refers-To", _name(refers_to)), ("WARC-Profile", PROFILE)]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or b"")
    fields += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, write_content_size=True)


def _put(path: str, data: bytes) -> None:
    """Writes a file whole or not at all; any store that Arrow can reach."""
    from pyarrow import fs

    store, place = fs.FileSystem.from_uri(path)
    store.create_dir(place.rsplit("/", 1)[0], recursive=True)
    part = f"{place}.{uuid.uuid4().hex}"
    with store.open_output_stream(part) as f:
        f.write(data)
    store.move(part, place)


def write_archives(pages: DataFrame, out_dir: str, *, min_payload: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes all pages; returns the table of archives: path, records, bytes."""
    dictionary = train_dictionary(pages)  # DICT_BYTES at most
    src = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_ = _compressor(dictionary)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                rows = []
                for page_id, url, html in zip(*(c.to_pylist() for c in b.slice(at, 256).columns), strict=True):
                    payload = (html or "").encode()
                    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    rows.append((page_id, url, len(payload), digest, zip_.compress(record(page_id, url, payload, len(payload), digest))))
                cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary()), strict=True)]
                yield pa.RecordBatch.from_arrays(cols, names=["page_id", "url", "size", "digest", "frame"])

    frames = written(src.mapInArrow(tidy(compress), "page_id long, url string, size long, digest string, frame binary"), "frames")
    again = frames.where(F.col("size") >= min_payload).groupBy("digest", "size").agg(F.max("page_id").alias("top"), F.count("*").alias("n")).where("n > 1").drop("n")
    few = again.count() <= BROADCAST_ROWS
    rows = frames.join(F.broadcast(again) if few else again, ["digest", "size"], "left").select("page_id", "url", "size", "digest", "top", F.when(F.col("top").isNull() | F.col("page_id").eqNullSafe(F.col("top")), F.col("frame")).alias("frame"))

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        zip_, number = _compressor(dictionary), 0
        part = f"{TaskContext.get().partitionId():06d}-{TaskContext.get().taskAttemptId()}"  # a rerun never touches an older file
        head = struct.pack("<II", DICT_MAGIC, len(dictionary)) + dictionary if dictionary else b""
        held, size = [head], len(head)

        def close() -> pa.RecordBatch:
            path = f"{out_dir}/part-{part}-{number:05d}.warc.zst"
            _put(path, b"".join(held))
            return pa.RecordBatch.from_pydict({"path": [path], "records": [len(held) - 1], "bytes": [size]})

        for b in batches:
            for page_id, url, n, digest, top, frame in zip(*(c.to_pylist() for c in b.columns), strict=True):
                frame = zip_.compress(record(page_id, url, None, n, digest, top)) if frame is None else frame
                held.append(frame)
                size += len(frame)
                if size >= archive_bytes:
                    yield close()
                    number += 1
                    held, size = [head], len(head)
        if len(held) > 1:
            yield close()

    listed = written(rows.mapInArrow(tidy(archive), "path string, records long, bytes long"), "archives")
    dropped(frames)
    return listed


def parse(raw: bytes) -> dict:
    """Fields of one record, and what is wrong with it."""
    out = {"page_id": None, "url": None, "payload_bytes": None, "payload_digest": None, "record_type": None, "refers_to": None, "payload": None, "problem": None}
    head, gap, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    fields = {}
    for line in lines[1:]:
        k, colon, v = line.partition(":")
        if not colon or not k.strip():
            return out | {"problem": "malformed header line"}
        fields[k.strip().lower()] = v.strip()
    if not gap or not lines[0].startswith("WARC/1."):
        return out | {"problem": "no version line"}
    if missing := [k for k in ("warc-type", "warc-record-id", "warc-date", "content-length") if k not in fields]:
        return out | {"problem": f"missing {missing[0]}"}
    ident = lambda v: int(v[12:-1]) if v.startswith("<urn:x-page:") and v[12:-1].lstrip("-").isdigit() else None
    out |= {"page_id": ident(fields["warc-record-id"]), "record_type": fields["warc-type"], "refers_to": ident(fields.get("warc-refers-to", "")), "payload_digest": fields.get("warc-payload-digest", "").removeprefix("sha1:")}
    out["url"] = base64.b64decode(fields["x-target-uri-base64"]).decode("utf-8", "surrogatepass") if "x-target-uri-base64" in fields else fields.get("warc-target-uri")
    if not fields["content-length"].isdigit() or int(fields["content-length"]) + 4 != len(rest) or rest[-4:] != b"\r\n\r\n":
        return out | {"problem": "content length differs"}
    http, gap, payload = rest[:-4].partition(b"\r\n\r\n")
    if not gap or not http.startswith(b"HTTP/"):
        return out | {"problem": "no HTTP header"}
    size = fields.get("x-payload-length", "")
    out["payload_bytes"] = int(size) if size.isdigit() else len(payload)
    if out["record_type"] == "response":
        out["payload"] = payload
        if out["payload_bytes"] != len(payload):
            out["problem"] = "payload length differs"
        elif base64.b32encode(hashlib.sha1(payload).digest()).decode() != out["payload_digest"]:
            out["problem"] = "payload digest differs"
    elif out["record_type"] != "revisit" or payload:
        out["problem"] = "unexpected record"
    return out


def frames_of(data: bytes) -> Iterator[bytes]:
    """The decoded frames of an archive, one at a time."""
    view, at, dictionary = memoryview(data), 0, None
    if len(data) >= 8:
        magic, size = struct.unpack_from("<II", data)
        if magic == DICT_MAGIC:
            own = bytes(view[8 : 8 + size])
            if own[:4] == b"\x28\xb5\x2f\xfd":  # the dictionary may itself be compressed
                own = zstandard.ZstdDecompressor().decompress(own)
            dictionary, at = zstandard.ZstdCompressionDict(own), 8 + size
    unzip = zstandard.ZstdDecompressor(dict_data=dictionary)
    while at < len(data):
        one = unzip.decompressobj()
        parts, begin = [], at
        while at < len(data) and not one.eof:
            step = view[at : at + (64 << 10)]
            parts.append(one.decompress(step))
            at += len(step)
        if not one.eof:
            raise ValueError(f"truncated frame at byte {begin}")
        at -= len(one.unused_data)
        yield b"".join(parts)


_READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary, problem string"


def read_archives(spark: SparkSession, path: str, listed: DataFrame | None = None) -> DataFrame:
    """One row per record of all archives in a folder of any store that Spark reads; of those alone
    that are listed (path) if a list is given, as a task that ran again may have left others."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(path)
    if listed is not None:
        name = F.element_at(F.split("path", "/"), -1)
        few = listed.count() <= BROADCAST_ROWS
        names = listed.select(name.alias("file")).distinct()
        files = files.withColumn("file", name).join(F.broadcast(names) if few else names, "file", "left_semi")
    files = files.select("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("problem", pa.string())])
        for b in batches:
            for i in range(b.num_rows):
                rows, size = [], 0
                for raw in frames_of(b.column(0)[i].as_py()):
                    rows.append(parse(raw))
                    size += len(raw)
                    if size >= 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return files.mapInArrow(tidy(run), _READ)


def round_trip(pages: DataFrame, *, min_payload: int = 0) -> DataFrame:
    """Writes all pages and reads the archives back."""
    spark = pages.sparkSession
    out_dir = new_path(spark, "warc")
    listed = write_archives(pages, out_dir, min_payload=min_payload)
    if listed.isEmpty():
        return spark.createDataFrame([], _READ)
    return read_archives(spark, out_dir, listed)
