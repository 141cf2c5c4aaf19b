"""WARC archives with a Zstandard dictionary in front, written and read by tasks.

Each archive begins with a skippable frame that holds a dictionary trained from
records of that archive; every record is a frame of its own, compressed with it. Of
pages with equal payloads the one with the smallest id is a response, the others are
revisits that refer to it. The archives lie in a folder all executors share; the
manifest, written by Spark, lists the files of the attempts that counted, so a lost
or repeated task leaves at most files nobody reads.

A null page is an empty payload. Rows equal in id and payload are separate records,
and all rows with the smallest id are responses. A null id sorts last. An empty table
gives no archives. Payloads of any length are one record.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from urllib.parse import quote, unquote

import pyarrow as pa
import zstandard as zstd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codelineage.llm.common import slices

# Fixed values of the archive format: magic of the dictionary's skippable frame, revisit profile.
DICTIONARY_MAGIC = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

ARCHIVE_BYTES = 64 << 20
TRAIN_BYTES = 4 << 20
DICTIONARY_BYTES = 64 << 10
LEVEL = 3
CHUNK = 1 << 16
# Raw bytes of archives that one reading task is meant for, and the most tasks.
READ_BYTES = 8 << 20
READ_TASKS = 50_000


def with_first(pages: DataFrame, key: str = "page_id", payload: str = "html", min_bytes: int = 0) -> DataFrame:
    """Adds ``digest`` and ``first``, the smallest id with that payload.

    The smallest ids are pre-aggregated before the shuffle and have one row per
    payload; a payload with very many copies repeats on the other side only, where
    adaptive execution splits it.
    """
    body = F.coalesce(F.col(payload), F.lit(""))
    rows = pages.withColumns({"digest": F.sha1(F.encode(body, "UTF-8")), "_size": F.octet_length(body)})
    first = rows.groupBy(F.col("digest").alias("_digest")).agg(F.min(key).alias("first"))
    joined = rows.join(first, F.col("digest") == F.col("_digest")).drop("_digest")
    return joined.withColumn("first", F.when(F.col("_size") >= min_bytes, F.col("first")).otherwise(F.col(key))).drop("_size")


def record(page: int | None, url: str | None, body: bytes, first: int | None) -> bytes:
    """One WARC record, with an empty block for a revisit."""
    digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
    revisit = page != first
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"page:{page}:{digest}")
    head = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": f"<urn:uuid:{name}>",
        "WARC-Date": "1970-01-01T00:00:00Z",
        "WARC-Target-URI": quote(url or "", safe="%/:=&?~#+!$,;'@()*[]|"),
        "WARC-Payload-Digest": f"sha1:{digest}",
        "X-Page-ID": "" if page is None else str(page),
        "X-Payload-Length": str(len(body)),
    }
    block = b""
    if revisit:
        head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": f"<urn:page:{first}>"}
    else:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body) + body
    head |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    lines = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n"
    return lines.encode() + block + b"\r\n\r\n"


def dictionary(records: list[bytes]) -> zstd.ZstdCompressionDict:
    """A dictionary trained from records; too few of them are taken as its raw content."""
    try:
        return zstd.train_dictionary(min(DICTIONARY_BYTES, max(1024, sum(map(len, records)) // 8)), records, k=256, d=8)
    except zstd.ZstdError:
        return zstd.ZstdCompressionDict(b"".join(records)[-DICTIONARY_BYTES:], dict_type=zstd.DICT_TYPE_RAWCONTENT)


class Archive:
    """Writes one archive: keeps the first records until the dictionary is trained, then streams."""

    def __init__(self, store: fs.FileSystem, path: str):
        self.out, self.path = store.open_output_stream(path), path
        self.waiting: list[bytes] = []
        self.held = self.raw = self.records = 0
        self.compressor = None

    def add(self, data: bytes) -> None:
        self.raw += len(data)
        self.records += 1
        if self.compressor is None:
            self.waiting.append(data)
            self.held += len(data)
            if self.held >= TRAIN_BYTES:
                self._begin()
        else:
            self.out.write(self.compressor.compress(data))

    def _begin(self) -> None:
        trained = dictionary(self.waiting)
        content = trained.as_bytes()
        self.out.write(struct.pack("<II", DICTIONARY_MAGIC, len(content)) + content)
        self.compressor = zstd.ZstdCompressor(level=LEVEL, dict_data=trained)
        for data in self.waiting:
            self.out.write(self.compressor.compress(data))
        self.waiting = []

    def close(self) -> tuple[str, int, int]:
        if self.compressor is None:
            self._begin()
        self.out.close()
        return self.path, self.records, self.raw


MANIFEST = T.StructType([T.StructField("path", T.StringType()), T.StructField("records", T.LongType()), T.StructField("raw_bytes", T.LongType())])


def write_archives(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0) -> DataFrame:
    """Writes archives below ``folder``, a URI all executors reach; returns their manifest, read from there."""
    rows = with_first(pages.select(F.col(key).cast("long").alias("page"), F.col(url).alias("url"), F.col(payload).alias("body")), "page", "body", min_bytes)

    def run(batches):
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        archive, done = None, []
        for batch in slices(batches, "body"):
            for page, where, body, first in zip(*(batch.column(c).to_pylist() for c in ("page", "url", "body", "first"))):
                if archive is None:
                    archive = Archive(store, f"{root}/{uuid.uuid4().hex}.warc.zst")
                archive.add(record(page, where, (body or "").encode("utf-8", "surrogatepass"), first))
                if archive.raw >= ARCHIVE_BYTES:
                    done.append(archive.close())
                    archive = None
        if archive is not None:
            done.append(archive.close())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names=[f.name for f in MANIFEST])

    listed = f"{folder}/manifest"
    rows.select("page", "url", "body", "first").mapInArrow(run, MANIFEST).write.parquet(listed)
    return pages.sparkSession.read.schema(MANIFEST).parquet(listed)


def frames(stream, trained: bytes | None = None):
    """The records of an archive, one at a time, from a readable binary stream."""
    magic, size = struct.unpack("<II", stream.read(8))
    if magic != DICTIONARY_MAGIC:
        raise ValueError("no dictionary frame in front")
    content = stream.read(size)
    decompressor = zstd.ZstdDecompressor(dict_data=zstd.ZstdCompressionDict(content))
    rest = stream.read(CHUNK)
    while rest:
        frame, out = decompressor.decompressobj(), []
        while not frame.eof:
            if not rest:
                raise ValueError("the archive ends inside a record")
            out.append(frame.decompress(rest))
            rest = frame.unused_data if frame.eof else stream.read(CHUNK)
        yield b"".join(out)
        rest = rest or stream.read(CHUNK)


def parse(data: bytes) -> tuple[int | None, str, int, str, str, int | None, bytes]:
    """(page, url, payload length, digest, type, refers to, payload) of a record; a response's payload is checked."""
    head, block = data.split(b"\r\n\r\n", 1)
    field = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    digest = field["WARC-Payload-Digest"].removeprefix("sha1:")
    body = b""
    if field["WARC-Type"] == "response":
        block = block[: int(field["Content-Length"])]
        body = block.split(b"\r\n\r\n", 1)[1]
        if base64.b32encode(hashlib.sha1(body).digest()).decode() != digest:
            raise ValueError(f"payload of page {field['X-Page-ID']} does not match its digest")
    page = int(field["X-Page-ID"]) if field["X-Page-ID"] else None
    refers = field.get("WARC-Refers-To")
    refers_to = int(refers[len("<urn:page:") : -1]) if refers and refers != "<urn:page:None>" else None
    return page, unquote(field["WARC-Target-URI"]), int(field["X-Payload-Length"]), digest, field["WARC-Type"], refers_to, body


RECORD = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("refers_to", T.LongType()),
        T.StructField("payload", T.BinaryType()),
    ]
)


def read_archives(manifest: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records of all archives of a manifest, streamed file by file.

    The number of tasks follows the raw bytes of the archives, at most one an archive: adaptive
    execution would size tasks by the bytes of the paths.
    """
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    schema = pa.schema(list(zip([f.name for f in RECORD], kinds)))

    def run(batches):
        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows, size = [], 0
                with store.open_input_stream(path, buffer_size=CHUNK) as stream:
                    for data in frames(stream):
                        row = parse(data)
                        rows.append(row if payloads else (*row[:6], None))
                        size += 512 + len(row[6]) * payloads
                        if size >= 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], schema=schema)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], schema=schema)

    archives, raw = manifest.agg(F.count("*"), F.coalesce(F.sum("raw_bytes"), F.lit(0))).first()
    tasks = max(1, min(archives, READ_TASKS, -(-raw // READ_BYTES)))
    return manifest.select("path").repartition(tasks).mapInArrow(run, RECORD)


def new_folder(spark: SparkSession) -> str:
    """A fresh URI in the shared folder."""
    from codelineage.session import scratch_path

    path = scratch_path(spark, "warc")
    return path if "://" in path or path.startswith("file:") else f"file://{path}"
