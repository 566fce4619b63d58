"""WARC archives whose records share a Zstandard dictionary, written and read by Spark.

An archive is a file of Zstandard frames: first a skippable frame (number 0x184D2A5D)
that holds the dictionary, then each record as a frame of its own, so that a record can
be read without those before it; the text writer's separator is an empty skippable
frame, which readers pass over. The dictionary is trained on a bounded sample of the
records to be archived (SAMPLE of least hash, of payloads up to SAMPLE_BYTES), a choice
of size only.

Of records with equal payloads of at least `least_bytes`, that with the largest page_id
is a response and the others revisit it: they keep its HTTP head, the payload's digest
and the response's record id, not the payload. Records are compressed before they are
shuffled by the payload's hash, so whole pages never are; payloads that hold a share of
the rows meet by broadcast. An archive ends once it holds ARCHIVE bytes.

Record ids are UUIDs of version 8 that carry the page_id and bits of the payload's
digest, so a retried task writes the same ids and a reader gets page_id back.

A null html is an empty payload. A null page_id counts as smaller than any; where all
are null, all are responses. Rows with the largest page_id of a payload are responses
all, should it repeat. A null url is left out; characters of an url that a header cannot
hold are percent-encoded. Payloads are told apart by SHA-256. An empty table gives no
archive. Other columns are not archived.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import urllib.parse
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions.tables import shared_root

from . import support
from .support import join_hot, slices, stored

SAMPLE, SAMPLE_BYTES = 512, 65536  # records a dictionary is trained on, and the largest of them
DICTIONARY = 112_640  # bytes of a dictionary at most
ARCHIVE = 16 << 20  # bytes of frames that end an archive
LEVEL = 3
DATE = "1970-01-01T00:00:00Z"  # of capture, unless told otherwise: a table of pages has none
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DICTIONARY_FRAME, _SEPARATOR = 0x184D2A5D, "P*M\x18\0\0\0\0"  # an empty skippable frame, in ASCII
_OUT = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    """A version 8 UUID: 64 bits of page_id, one that says it is null, 57 of the digest."""
    n = 0 if page_id is None else page_id & (1 << 64) - 1
    rest = int.from_bytes(hashlib.sha256(digest.encode()).digest()[:8]) >> 7
    low = (n & 0xF) << 58 | (page_id is None) << 57 | rest
    return f"<urn:uuid:{uuid.UUID(int=(n >> 16) << 80 | 8 << 76 | (n >> 4 & 0xFFF) << 64 | 2 << 62 | low)}>"


def page_of(urn: str) -> int | None:
    """The page_id that a record id carries."""
    x = uuid.UUID(urn.strip("<>").removeprefix("urn:uuid:")).int
    n = x >> 80 << 16 | (x >> 64 & 0xFFF) << 4 | x >> 58 & 0xF
    return None if x >> 57 & 1 else n - (1 << 64) * (n >> 63)


def _head(fields: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))]]
    return ("WARC/1.1\r\n" + "".join(lines) + "\r\n").encode() + block + b"\r\n\r\n"


def record(page_id: int | None, url: str | None, payload: bytes | None, digest: str, length: int, date: str, refers_to: int | None = None) -> bytes:
    """A response, or without a payload a revisit of refers_to's record."""
    target = [] if url is None else [("WARC-Target-URI", "".join(urllib.parse.quote(c) if c <= " " or c == "\x7f" else c for c in url))]
    fields = [("WARC-Type", "response" if payload is not None else "revisit"), ("WARC-Record-ID", record_id(page_id, digest)), ("WARC-Date", date), *target, ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http;msgtype=response")]
    if payload is None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, digest))]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    return _head(fields, http + (payload or b""))


def dictionary(pages: DataFrame, date: str = DATE) -> bytes:
    """A dictionary trained on records of a bounded sample of pages; empty if they are too few for one."""
    few = pages.filter(F.length("html") <= SAMPLE_BYTES // 4).filter("html != ''")  # a character takes 4 bytes at most
    sample = few.select("page_id", "url", "html").orderBy(F.xxhash64("page_id", "url"), "page_id").limit(SAMPLE).toArrow().to_pylist()
    records = [record(r["page_id"], r["url"], p := r["html"].encode(), base32_sha1(p), len(p), date) for r in sample]
    try:
        return zstandard.train_dictionary(DICTIONARY, records).as_bytes()
    except zstandard.ZstdError:
        return b""


def _compressor(trained: bytes) -> zstandard.ZstdCompressor:
    shared = zstandard.ZstdCompressionDict(trained) if trained else None
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=shared, write_checksum=True)


def frames(pages: DataFrame, trained: bytes, date: str) -> DataFrame:
    """(page_id, url, key, digest, length, frame): each page as a compressed response record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = _compressor(trained)
        for b in slices(batches, 64):
            out: dict[str, list] = {c: [] for c in ("page_id", "url", "key", "digest", "length", "frame")}
            for page_id, url, html in zip(b.column("page_id").to_pylist(), b.column("url").to_pylist(), b.column("html").to_pylist()):
                payload = html.encode()
                digest = base32_sha1(payload)
                row = (page_id, url, hashlib.sha256(payload).digest(), digest, len(payload), press.compress(record(page_id, url, payload, digest, len(payload), date)))
                for column, value in zip(out.values(), row):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), (pa.int64(), pa.string(), pa.binary(), pa.string(), pa.int64(), pa.binary()))], list(out))

    return pages.mapInArrow(run, "page_id long, url string, key binary, digest string, length long, frame binary")


def packed(records: DataFrame, trained: bytes, date: str, archive_bytes: int) -> DataFrame:
    """(archive): whole archives; a row with refers_to becomes a revisit record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = _compressor(trained)
        first = struct.pack("<II", _DICTIONARY_FRAME, len(trained)) + trained if trained else b""
        held, size = [], 0

        def archive() -> pa.RecordBatch:
            info = _head([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(b''.join(held)).digest()[:16], version=5)}>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], b"software: tracewell\r\nformat: WARC File Format 1.1\r\n")
            return pa.RecordBatch.from_arrays([pa.array([b"".join([first, press.compress(info), *held])], pa.binary())], ["archive"])

        for b in slices(batches, 64):
            for r in b.to_pylist():
                frame = r["frame"] if r["first"] is None else press.compress(record(r["page_id"], r["url"], None, r["digest"], r["length"], date, r["first"]))
                held.append(frame)
                size += len(frame)
                if size >= archive_bytes:
                    yield archive()
                    held, size = [], 0
        if held:
            yield archive()

    return records.mapInArrow(run, "archive binary")


def linked(records: DataFrame, least_bytes: int) -> DataFrame:
    """Adds first: the page_id of the response that a record revisits, null for responses."""
    groups = records.groupBy("key").agg(F.max("page_id").alias("greatest"), F.count("*").alias("copies"))
    met = join_hot(records, groups, ["key"], "copies", records.count())
    revisits = (F.col("length") >= least_bytes) & ~F.col("page_id").eqNullSafe(F.col("greatest"))
    return met.withColumn("first", F.when(revisits, F.col("greatest")))


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0, date: str = DATE, archive_bytes: int = ARCHIVE) -> None:
    """Write pages(page_id, url, html) as archives `*.warc.zst` in a new folder of a file system that Spark knows."""
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    trained = dictionary(own, date)
    records = stored(frames(own, trained, date), "warc-frames")
    archives = packed(linked(records, least_bytes), trained, date, archive_bytes)
    # the cast keeps the bytes as they are; one archive a file
    archives.select(F.col("archive").cast("string")).write.option("lineSep", _SEPARATOR).option("maxRecordsPerFile", 1).text(folder)
    _name(pages.sparkSession, folder)


def _name(spark: SparkSession, folder: str) -> None:
    """Give the files their archive names; a look at names, not at contents."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for f in fs.listStatus(path(folder)):
        name = f.getPath().getName()
        if name.startswith("part-") and name.endswith(".txt"):
            fs.rename(f.getPath(), path(f"{folder}/{name.removesuffix('.txt')}.warc.zst"))


def read_records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an archive, with the dictionary of its leading frame if it has one."""
    number, size = struct.unpack("<II", content[:8]) if len(content) >= 8 else (0, 0)
    trained = content[8 : 8 + size] if number == _DICTIONARY_FRAME else b""
    shared = zstandard.ZstdCompressionDict(trained) if trained else None
    with zstandard.ZstdDecompressor(dict_data=shared).stream_reader(io.BytesIO(content), read_across_frames=True) as raw:
        lines = io.BufferedReader(raw, 1 << 18)
        while version := lines.readline():
            if not version.startswith(b"WARC/"):
                raise ValueError(f"not a WARC record: {version[:40]!r}")
            headers = {}
            while (line := lines.readline()) not in (b"\r\n", b""):
                k, _, v = line.decode().rstrip("\r\n").partition(":")
                headers[k.lower()] = v.strip()
            block = lines.read(int(headers["content-length"]))
            if lines.read(4) != b"\r\n\r\n":
                raise ValueError(f"record {headers.get('warc-record-id')} is cut short")
            yield headers, block


def page(headers: dict[str, str], block: bytes) -> dict:
    """A record's row; the payload of a response must have the digest and length that its heads state."""
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest, kind = headers["warc-payload-digest"].removeprefix("sha1:"), headers["warc-type"]
    if kind == "response" and (base32_sha1(payload), len(payload)) != (digest, length):
        raise ValueError(f"record {headers['warc-record-id']} does not hold the payload that it states")
    refers_to = page_of(headers["warc-refers-to"]) if kind == "revisit" else None
    return {"page_id": page_of(headers["warc-record-id"]), "url": headers.get("warc-target-uri"), "record_type": kind, "refers_to": refers_to, "payload_digest": digest, "payload_bytes": length, "payload": payload if kind == "response" else None}


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, url, record_type, refers_to, payload_digest, payload_bytes, payload) of the responses and revisits in a folder's archives.

    Digests and lengths are those of the full payload; a revisit's payload is null (see
    with_payloads). Damaged archives raise.
    """
    kinds = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                held = []
                for headers, block in read_records(b.column("content")[i].as_py()):
                    if headers["warc-type"] in ("response", "revisit"):
                        held.append(page(headers, block))
                        if len(held) == 64:
                            yield pa.RecordBatch.from_pylist(held, kinds)
                            held = []
                if held:
                    yield pa.RecordBatch.from_pylist(held, kinds)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)
    return files.select("content").mapInArrow(run, _OUT)


def with_payloads(records: DataFrame) -> DataFrame:
    """read_archives' rows with every payload: revisits get that of the record they refer to."""
    key = ["refers_to", "payload_digest"]
    full = records.filter("record_type = 'response'").select(F.col("page_id").alias("refers_to"), "payload_digest", F.col("payload").alias("_p")).dropDuplicates(key)
    revisits = records.filter("record_type = 'revisit'").drop("payload")
    counts = revisits.groupBy(*key).agg(F.count("*").alias("_n"))
    one = full.join(counts, key)
    found = join_hot(revisits, one, key, "_n", revisits.count()).withColumnRenamed("_p", "payload").drop("_n")
    return records.filter("record_type = 'response'").unionByName(found.select(records.columns))


def digests(records: DataFrame) -> DataFrame:
    """The rows that the query returns."""
    payload: list[str | Column] = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"]
    return records.select(*payload)


def scratch_folder(spark: SparkSession) -> str:
    """A new folder for archives under the shared one; it goes when the application ends."""
    return support.scratch(f"{shared_root(spark)}/llm/archives-{uuid.uuid4().hex}")
