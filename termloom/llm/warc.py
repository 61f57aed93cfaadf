"""WARC archives in Zstandard frames: one frame per record, the dictionary in a leading skippable frame.

Tasks write bounded archives into a shared folder and report their names; only the names that Spark
commits are read back, so what a lost or repeated attempt leaves behind is never seen. Records whose
payload another record already holds are written as revisits.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.llm.common import shared_dir, stored

# Fixed values of the formats.
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
VERSION = b"WARC/1.1\r\n"

ARCHIVE_BYTES = 32_000_000
CHUNK = 1 << 16


def train_dictionary(pages: DataFrame, payload: str, size: int = 32_768, sample: int = 256, most: int = 32_768) -> bytes:
    """A dictionary from at most `sample` payloads (least hashes), `most` characters of each; empty if they are too few.

    The bounds only limit what the compressor learns from; every record is written and read whole.
    """
    hashed = pages.where(F.col(payload) != "").select(F.substring(payload, 1, most).alias("p"), F.xxhash64(payload).alias("h"))
    least = [r.h for r in hashed.select("h").orderBy("h").limit(sample).collect()]  # numbers first: payloads of all tasks would not fit the driver
    rows = hashed.where(F.col("h").isin(least)).groupBy("h").agg(F.min("p").alias("p")).orderBy("h").collect() if least else []
    try:
        return zstandard.train_dictionary(size, [r.p.encode() for r in rows]).as_bytes()
    except zstandard.ZstdError:
        return b""


def record_id(key: object, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{key}:{digest}')}>"


def record(key: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One WARC record; with refers_to a revisit, whose block is the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    uri = "".join(c if " " < c != "\x7f" else f"%{ord(c):02X}" for c in url) if url and not url.isprintable() or url and " " in url else url
    head = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id(key, digest)),
        ("WARC-Date", date),
        ("WARC-Target-URI", uri or "about:blank"),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()),
        ("WARC-Block-Digest", "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if key is not None:
        head.append(("X-Record-Key", str(key)))
    if refers_to is not None:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, digest)), ("X-Refers-To-Key", str(refers_to))]
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*head, ("Content-Length", str(len(block)))])
    return VERSION + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a record; raises ValueError unless version, headers, lengths and digests hold."""
    head, sep, rest = raw.partition(b"\r\n\r\n")
    if not sep or not head.startswith(VERSION):
        raise ValueError("no WARC/1.1 header")
    headers: dict[str, str] = {}
    for line in head[len(VERSION) :].decode().split("\r\n"):
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip():
            raise ValueError(f"malformed header line {line[:80]!r}")
        headers[name.lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in headers:
            raise ValueError(f"no {name}")
    n = headers["content-length"]
    if not n.isdigit() or len(rest) != int(n) + 4 or rest[-4:] != b"\r\n\r\n":
        raise ValueError("content length and record differ")
    block = rest[:-4]
    said = headers.get("warc-block-digest", "")
    if said.startswith("sha1:") and base64.b32decode(said[5:]) != hashlib.sha1(block).digest():
        raise ValueError("block digest and block differ")
    return headers, block


def payload_of(headers: dict[str, str], block: bytes) -> tuple[int, str, bytes | None]:
    """Length, hex SHA-1 and bytes of the full payload; a revisit states the first two and holds no bytes."""
    http, sep, payload = block.partition(b"\r\n\r\n")
    if not sep:
        raise ValueError("no HTTP header")
    fields = dict(x.lower().split(b": ", 1) for x in http.split(b"\r\n")[1:])
    n = int(fields[b"content-length"])
    digest = base64.b32decode(headers["warc-payload-digest"].removeprefix("sha1:")).hex()
    if headers["warc-type"] == "revisit":
        if payload:
            raise ValueError("a revisit with a payload")
        return n, digest, None
    if len(payload) != n or hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError("payload and its length or digest differ")
    return n, digest, payload


def records(read) -> Iterator[bytes]:
    """The records of an archive, given read(n): the dictionary first, then frame after frame in bounded memory."""
    data = read(8)
    words = None
    if len(data) == 8 and struct.unpack("<I", data[:4])[0] == DICTIONARY_MAGIC:
        left = struct.unpack("<I", data[4:])[0]
        held = read(left)
        if len(held) != left:
            raise ValueError("the dictionary frame is cut")
        if held[:4] == FRAME_MAGIC:
            held = zstandard.ZstdDecompressor().decompressobj().decompress(held)
        words = zstandard.ZstdCompressionDict(held)
        data = b""
    opener = zstandard.ZstdDecompressor(dict_data=words) if words else zstandard.ZstdDecompressor()
    while True:
        while len(data) < 18 and (more := read(CHUNK)):
            data += more
        if not data:
            return
        if data[:4] != FRAME_MAGIC:
            raise ValueError("no Zstandard frame where a record should begin")
        size = zstandard.get_frame_parameters(data).content_size
        frame, parts = opener.decompressobj(), []
        parts.append(frame.decompress(data))
        while not frame.eof:
            data = read(CHUNK)
            if not data:
                raise ValueError("the last frame is cut")
            parts.append(frame.decompress(data))
        data = frame.unused_data
        raw = b"".join(parts)
        if size not in (zstandard.CONTENTSIZE_UNKNOWN, len(raw)):
            raise ValueError("frame header and content differ in length")
        yield raw


def with_owners(pages: DataFrame, key: str, payload: str, least: int = 1000) -> DataFrame:
    """Columns key, url, payload, digest and refers_to: the largest key among records with an equal payload of `least` bytes or more.

    Null payloads are empty. The record with the largest key refers to nothing; records that repeat that
    key are all responses, records with a null key revisit it, and if all keys are null all are responses.
    Only digests that occur more than once are joined; Spark broadcasts them while they are few.
    """
    x = pages.select(F.col(key).cast("long").alias("key"), F.col("url").cast("string").alias("url"), F.coalesce(F.col(payload).cast("string"), F.lit("")).alias("payload"))
    x = x.withColumns({"digest": F.sha1("payload"), "n": F.octet_length("payload")})
    owners = stored(x.where(F.col("n") >= least).groupBy("digest", "n").agg(F.max("key").alias("owner"), F.count(F.lit(1)).alias("times")).where("times > 1 and owner is not null").select("digest", "n", "owner"), "owners")
    return x.join(owners, ["digest", "n"], "left").select("key", "url", "payload", "digest", F.expr("case when owner <=> key then null else owner end").alias("refers_to"))


def write_archives(found: DataFrame, folder: str, dictionary: bytes = b"", archive_bytes: int = ARCHIVE_BYTES, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write what with_owners returns; gives (path, n_records) of each committed archive. The folder is any pyarrow file system's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name = f"{task.partitionId():05d}-{task.taskAttemptId()}" if task else "00000-0"
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        words = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        squeeze = zstandard.ZstdCompressor(level=3, dict_data=words, write_content_size=True).compress
        out, path, count, size, paths, counts = None, "", 0, 0, [], []

        def close() -> None:
            nonlocal out, count, size
            if out is not None:
                out.close()
                paths.append(f"{folder}/{path.rpartition('/')[2]}")
                counts.append(count)
            out, count, size = None, 0, 0

        for b in batches:
            for key, url, payload, digest, refers_to in zip(*(c.to_pylist() for c in b.columns), strict=True):
                raw = record(key, url, payload.encode(), digest, refers_to, date)
                if out is None:
                    path = f"{base}/{name}-{len(paths):04d}.warc.zst"
                    out = store.open_output_stream(path)
                    if dictionary:
                        out.write(struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary)
                out.write(squeeze(raw))
                count, size = count + 1, size + len(raw)
                if size >= archive_bytes:
                    close()
        close()
        if paths:
            yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array(counts, pa.int64())], ["path", "n_records"])

    return stored(found.select("key", "url", "payload", "digest", "refers_to").mapInArrow(run, "path string, n_records long"), "archives")


def read_archives(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """A row per record of the archives (path, n_records): key, url, record_type, refers_to, payload_bytes, payload_digest, payload.

    Every record is validated (version, headers, lengths, block and payload digests, records per archive)
    and a fault raises ValueError. Frames are read one at a time. payload is null for revisits, and for all
    records if with_payload is false.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for b in batches:
            for path, expected in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                store, at = fs.FileSystem.from_uri(path)
                rows, size, n = [], 0, 0
                with store.open_input_stream(at) as f:
                    for raw in records(f.read):
                        headers, block = parse(raw)
                        length, digest, payload = payload_of(headers, block)
                        key, ref = headers.get("x-record-key"), headers.get("x-refers-to-key")
                        rows.append((None if key is None else int(key), headers.get("warc-target-uri"), headers["warc-type"], None if ref is None else int(ref), length, digest, payload if with_payload else None))
                        n, size = n + 1, size + len(block)
                        if size > 4_000_000 or len(rows) >= 5000:
                            yield batch(rows)
                            rows, size = [], 0
                if n != expected:
                    raise ValueError(f"{path} has {n} records instead of {expected}")
                if rows:
                    yield batch(rows)

    n = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return archives.repartition(n).mapInArrow(run, "key long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary")


def archive_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/llm-warc-{uuid.uuid4().hex}"
