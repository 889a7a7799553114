"""WARC archives as seekable Zstandard bundles.

Records are grouped into independent Zstandard frames. After the last frame come two skippable frames: an
index (for each record: identifier, frame, offset in the decompressed frame, length) and the seek table of
the seekable format (compressed and decompressed size of each frame, and a footer). A plain Zstandard
decoder skips both and sees an ordinary WARC file; a reader that knows them fetches a record by
decompressing its one frame.

Records whose payloads are equal are stored once: the page with the smallest page_id is a response, the
others are revisit records that refer to it."""

from __future__ import annotations

import base64
import json
import struct
from hashlib import sha1
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, ship

# Fixed values of the formats.
SKIPPABLE_INDEX = 0x184D2A5D
SKIPPABLE_SEEK = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

FRAME_BYTES, ARCHIVE_BYTES = 256 << 10, 48 << 20
DATE = "2024-01-01T00:00:00Z"


def record_id(page_id: int | None) -> str:
    return f"<urn:larkspur:page:{'none' if page_id is None else page_id}>"


def page_of(record: str) -> int | None:
    tail = record.rstrip(">").rsplit(":", 1)[1]
    return None if tail == "none" else int(tail)


def digest(payload: bytes) -> str:
    return base64.b32encode(sha1(payload).digest()).decode()


def render(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, is_revisit: bool, date: str = DATE) -> bytes:
    """One record, payload in an HTTP message. A revisit holds the message's head only; the head's length is
    that of the payload it stands for."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if not is_revisit:
        block += payload
    head = [("WARC-Type", "revisit" if is_revisit else "response"), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", date)]
    if url is not None:  # characters that can't stand in a header line are percent-encoded
        head.append(("WARC-Target-URI", quote(url, safe="!#$%&'()*+,/:;=?@[]~-._")))
    head.append(("WARC-Payload-Digest", f"sha1:{digest(payload)}"))
    if is_revisit:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to))]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(record: bytes) -> dict:
    """Headers, and payload (None for a revisit) and payload_bytes of one record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    out = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(out["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a WARC record's length is wrong")
    http, _, body = block.partition(b"\r\n\r\n")
    out["payload_bytes"] = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    out["payload"] = body if out["WARC-Type"] == "response" else None
    return out


class Writer:
    """Collects records into frames; ``finish`` gives the archive's bytes."""

    def __init__(self, frame_bytes: int = FRAME_BYTES, level: int = 3):
        self.limit, self.zip = frame_bytes, zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.frames: list[tuple[bytes, int]] = []
        self.open, self.held, self.size = [], 0, 0
        self.index: list[tuple[str, int, int, int]] = []

    def add(self, name: str, record: bytes) -> None:
        self.index.append((name, len(self.frames), self.held, len(record)))
        self.open.append(record)
        self.held += len(record)
        if self.held >= self.limit:
            self.flush()

    def flush(self) -> None:
        if self.open:
            self.frames.append((self.zip.compress(b"".join(self.open)), self.held))
            self.size += len(self.frames[-1][0])
            self.open, self.held = [], 0

    def finish(self) -> bytes:
        self.flush()
        index = zstandard.compress(json.dumps(self.index).encode())
        table = b"".join(struct.pack("<II", len(x), n) for x, n in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE_MAGIC)
        return b"".join([*(x for x, _ in self.frames), struct.pack("<II", SKIPPABLE_INDEX, len(index)), index, struct.pack("<II", SKIPPABLE_SEEK, len(table)), table])


class Reader:
    """An archive, in memory or an open file, by its seek table and index: the tables and then single frames are
    read, never the whole. Truncated or foreign data raise ValueError."""

    def __init__(self, source: bytes | pa.NativeFile):
        held = isinstance(source, bytes)
        self.read = (lambda n, at: source[at : at + n]) if held else source.read_at
        end = len(source) if held else source.size()
        if end < 17:
            raise ValueError("no seek table")
        n, flags, magic = struct.unpack("<IBI", self.read(9, end - 9))
        at = end - 9 - 8 * n - 8
        if magic != SEEKABLE_MAGIC or flags or at < 0:
            raise ValueError("no seek table")
        table = self.read(8 + 8 * n, at)
        if struct.unpack_from("<II", table) != (SKIPPABLE_SEEK, 8 * n + 9):
            raise ValueError("no seek table")
        self.frames, start = [], 0
        for packed, plain in struct.iter_unpack("<II", table[8:]):
            self.frames.append((start, packed, plain))
            start += packed
        if start + 8 > at:
            raise ValueError("no record index")
        index = self.read(at - start, start)
        if struct.unpack_from("<II", index) != (SKIPPABLE_INDEX, len(index) - 8):
            raise ValueError("no record index")
        self.index = [tuple(x) for x in json.loads(zstandard.decompress(index[8:]))]
        self.unzip, self.cached = zstandard.ZstdDecompressor(), (-1, b"")

    def frame(self, k: int) -> bytes:
        if self.cached[0] != k:
            start, packed, plain = self.frames[k]
            out = self.unzip.decompress(self.read(packed, start), max_output_size=plain)
            if len(out) != plain:
                raise ValueError("a frame's size is wrong")
            self.cached = (k, out)
        return self.cached[1]

    def record(self, frame: int, offset: int, length: int) -> bytes:
        return self.frame(frame)[offset : offset + length]


def _store(uri: str):
    """(file system, path) of a URI, for executors; plain paths and file: are the mounted shared folder."""
    from pyarrow import fs

    if uri.startswith("file:"):
        uri = "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


INDEX = T.StructType([
    T.StructField("archive", T.StringType()), T.StructField("page_id", T.LongType()), T.StructField("record_id", T.StringType()),
    T.StructField("frame", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("length", T.LongType()),
])
RECORDS = T.StructType([
    T.StructField("page_id", T.LongType()), T.StructField("record_id", T.StringType()), T.StructField("record_type", T.StringType()), T.StructField("url", T.StringType()),
    T.StructField("payload_digest", T.StringType()), T.StructField("payload_bytes", T.LongType()), T.StructField("refers_to", T.LongType()), T.StructField("payload", T.BinaryType()),
    T.StructField("archive", T.StringType()), T.StructField("frame", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("length", T.LongType()),
])


def with_originals(pages: DataFrame, min_revisit: int = 0) -> DataFrame:
    """``pages`` with payload (binary) and original: the smallest page_id of pages with an equal payload.

    Digests are joined, not payloads grouped: minima are made before the shuffle, and a payload that a third
    of all pages share meets one row of the other side, a join that Spark splits."""
    p = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    p = p.withColumn("sha", F.sha1("payload")).withColumn("size", F.octet_length("payload"))
    first = p.where(F.col("size") >= min_revisit).groupBy("sha", "size").agg(F.min("page_id").alias("original"))
    return p.join(first, ["sha", "size"], "left").select("page_id", "url", "payload", "original")


def write_archives(pages: DataFrame, folder: str, min_revisit: int = 0, frame_bytes: int = FRAME_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes a record for each row of ``pages`` (page_id, url, html) and returns the index of all archives:
    archive, page_id, record_id, frame, offset (in the decompressed frame), length.

    A null html is an empty payload; a null url is left out of the record. A page without page_id never is an
    original. Repeated rows give repeated records. Each task writes archives of its own, cut at about
    ``archive_bytes``, whose names hold the attempt's number. Write the index to a table: an archive counts only
    if that names it, so what failed, repeated or slow attempts left behind is never read. ``folder`` must be one
    that all executors share."""
    ship(pages.sparkSession)

    def run(batches):
        from pyspark import TaskContext

        context, n = TaskContext.get(), 0
        store, root = _store(folder)
        writer, ids = Writer(frame_bytes), []

        def close():
            nonlocal writer, ids, n
            name = f"part-{context.partitionId():06d}-{n:04d}-{context.taskAttemptId()}.warc.zst"
            with store.open_output_stream(f"{root}/{name}", compression=None) as out:
                out.write(writer.finish())
            rows = [(name, p, *x) for p, x in zip(ids, writer.index)]
            writer, ids, n = Writer(frame_bytes), [], n + 1
            return _batch(rows, INDEX)

        for b in batches:
            for page, url, payload, original in zip(*(b.column(k).to_pylist() for k in range(4))):
                revisit = original is not None and original != page
                writer.add(record_id(page), render(page, url, payload, original, revisit))
                ids.append(page)
                if writer.size + writer.held >= archive_bytes:
                    yield close()
        if ids:
            yield close()

    return with_originals(pages, min_revisit).mapInArrow(run, INDEX)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _batch(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _arrow(schema))], names=schema.names)


def _dealt(rows: DataFrame) -> DataFrame:
    """A row an archive, each in a task of its own as long as there are no more than some thousands."""
    return rows.repartition(max(1, min(rows.count(), 1 << 14)))


def read_archives(spark: SparkSession, folder: str, index: DataFrame) -> DataFrame:
    """All records of the archives in ``folder`` that ``index`` (a written table) names, each fetched by its
    archive's own index, frame by frame. Payloads of responses are checked against their digests. A revisit has
    no payload; its digest and payload_bytes are the original's. An empty index gives no rows."""
    ship(spark)

    def run(batches):
        store, root = _store(folder)
        for b in batches:
            for name in b.column(0).to_pylist():
                with store.open_input_file(f"{root}/{name}") as file:
                    reader, rows = Reader(file), []
                    for key, frame, offset, length in reader.index:
                        r = parse(reader.record(frame, offset, length))
                        if r["WARC-Record-ID"] != key:
                            raise ValueError("the index names another record")
                        sha = r["WARC-Payload-Digest"].removeprefix("sha1:")
                        if r["payload"] is not None and (digest(r["payload"]) != sha or len(r["payload"]) != r["payload_bytes"]):
                            raise ValueError("a payload doesn't fit its digest")
                        refers = page_of(r["WARC-Refers-To"]) if "WARC-Refers-To" in r else None
                        rows.append((page_of(key), key, r["WARC-Type"], r.get("WARC-Target-URI"), sha, r["payload_bytes"], refers, r["payload"], name, frame, offset, length))
                        if len(rows) >= 2000 or reader.cached[0] != frame:
                            yield _batch(rows, RECORDS)
                            rows = []
                    if rows:
                        yield _batch(rows, RECORDS)

    return _dealt(index.select("archive").distinct()).mapInArrow(run, RECORDS)


def fetch_records(spark: SparkSession, folder: str, wanted: DataFrame) -> DataFrame:
    """The raw WARC records (archive, record_id, record) of index entries ``wanted``. Of an archive only its tables
    and the frames with a wanted record are read. An archive is bounded, and so are its entries."""
    ship(spark)
    entries = wanted.groupBy("archive").agg(F.sort_array(F.collect_list(F.struct("frame", "offset", "length", "record_id"))).alias("entries"))

    def run(batches):
        store, root = _store(folder)
        for b in batches:
            for name, entries in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                with store.open_input_file(f"{root}/{name}") as file:
                    reader = Reader(file)
                    for e in entries:
                        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([e["record_id"]]), pa.array([reader.record(e["frame"], e["offset"], e["length"])], pa.binary())], names=["archive", "record_id", "record"])

    return _dealt(entries).mapInArrow(run, "archive string, record_id string, record binary")


def archive_folder(spark: SparkSession) -> str:
    """A new empty folder for archives in the session's shared folder."""
    folder = Scratch(spark, "warc").base
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    return folder


def round_trip(pages: DataFrame, min_revisit: int = 0) -> DataFrame:
    """Writes all pages to archives in a new shared folder and reads the archives back."""
    spark = pages.sparkSession
    folder = archive_folder(spark)
    return read_archives(spark, folder, Scratch(spark, "warc").table(write_archives(pages, folder, min_revisit), "index"))


def _base32_sql(sha: str) -> str:
    """Bare upper-case base32 of 40 hexadecimal digits, in DuckDB: five digits are four letters."""
    letter = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((x >> {0}) & 31)::INTEGER + 1, 1)"
    four = " || ".join(letter.format(k) for k in (15, 10, 5, 0))
    return f"array_to_string(list_transform(list_transform(range(0, 8), lambda i: ('0x' || substr({sha}, (5 * i + 1)::INTEGER, 5))::BIGINT), lambda x: {four}), '')"


#: What a round trip of ``pages`` gives, for DuckDB.
ROUND_TRIP_SQL = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, payload, sha1(payload) AS sha, min(page_id) OVER (PARTITION BY payload) AS original FROM p)
SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, {_base32_sql("sha")} AS payload_digest,
  CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> original THEN original END AS refers_to FROM d
"""
