"""WARC archives as a chunked record table.

A record is a run of rows (record id, chunk number, bytes), so a payload of any size passes through in chunks: writing cuts
payloads into chunk rows and streams them into archives, reading streams archives back into chunk rows. Each row read
carries the number of payload bytes and the SHA-1 digest up to and including its chunk, so a record's last row has the
figures of the whole payload and no step holds a whole record.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridscore.llm.components import stored
from gridscore.session import scratch_path

CHUNK_BYTES = 64 << 10
#: Rows of one Arrow batch when reading: at most so many payload bytes.
BATCH_BYTES = 4 << 20
#: An archive is closed after so many uncompressed bytes.
ARCHIVE_BYTES = 1 << 30

# Fixed values of the archive format and of base32.
VERSION = "WARC/1.1"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

MANIFEST = T.StructType([
    T.StructField("path", T.StringType(), False),
    T.StructField("n_records", T.LongType(), False),
    T.StructField("n_bytes", T.LongType(), False),
])
CHUNKS = T.StructType([
    T.StructField("path", T.StringType(), False),
    T.StructField("record_no", T.LongType(), False),
    T.StructField("record_id", T.StringType()),
    T.StructField("record_type", T.StringType()),
    T.StructField("target_uri", T.StringType()),
    T.StructField("refers_to", T.StringType()),
    T.StructField("declared_digest", T.StringType()),
    T.StructField("declared_bytes", T.LongType()),
    T.StructField("chunk_no", T.LongType(), False),
    T.StructField("data", T.BinaryType(), False),
    T.StructField("payload_bytes", T.LongType(), False),
    T.StructField("payload_digest", T.StringType(), False),
    T.StructField("is_last", T.BooleanType(), False),
])


def base32(digest: Column) -> Column:
    """A SHA-1 digest in hex as base32, as native expression: 5 hex digits give 4 letters."""
    letters = []
    for group in range(8):
        value = F.conv(F.substring(digest, 5 * group + 1, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(BASE32), F.shiftright(value, shift).bitwiseAND(31) + 1, F.lit(1)) for shift in (15, 10, 5, 0)]
    return F.concat(*letters)


def with_revisits(records: DataFrame, key: str, payload: str, least_bytes: int = 0) -> DataFrame:
    """Add ``payload_bytes``, ``payload_digest`` and ``first_key``: the smallest ``key`` with the same payload, or null
    for that record itself and for payloads below ``least_bytes``.

    Null payloads are empty. Null keys come last. Rows that repeat the smallest key stay records of their own, since
    nothing orders them. Only keys and digests are grouped; payloads are joined by key, so a payload shared by very many
    records gathers nowhere.
    """
    content = F.coalesce(F.col(f"`{payload}`").cast("binary"), F.lit("").cast("binary"))
    rows = records.withColumn(payload, content).withColumns({"payload_bytes": F.octet_length(content).cast("bigint"), "_sha1": F.sha1(content)})
    narrow = rows.where(F.col("payload_bytes") >= least_bytes).select(F.col(f"`{key}`").alias("_key"), F.col("_sha1").alias("_digest"))
    narrow = stored(narrow, "digests")
    shared = narrow.groupBy("_digest").agg(F.min("_key").alias("first_key"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    later = narrow.join(shared, "_digest").where("not (_key <=> first_key)").distinct()
    found = rows.join(later, F.col(f"`{key}`").eqNullSafe(F.col("_key")) & (F.col("_sha1") == F.col("_digest")), "left")
    return found.withColumn("payload_digest", base32(F.col("_sha1"))).drop("_key", "_digest", "_sha1")


def chunk_rows(records: DataFrame, record_id: Column, uri: Column, payload: Column, refers_to: Column, digest: Column, n_bytes: Column, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per chunk, in order; an empty or withheld payload is one empty chunk. Narrow: chunks stay together."""
    rows = records.select(
        record_id.alias("record_id"), uri.alias("target_uri"), refers_to.alias("refers_to"), digest.alias("digest"), n_bytes.alias("n_bytes"),
        F.when(refers_to.isNull(), payload).otherwise(F.lit("").cast("binary")).alias("payload"),
    )
    count = F.greatest(F.lit(1), F.ceil(F.octet_length("payload") / chunk_bytes)).cast("int")
    rows = rows.withColumn("chunk_no", F.explode(F.sequence(F.lit(0), count - 1)))
    return rows.withColumn("data", F.substring("payload", F.col("chunk_no") * chunk_bytes + 1, F.lit(chunk_bytes))).withColumn("is_last", F.col("chunk_no") == count - 1).drop("payload")


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder or file that all executors can reach."""
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def header_value(text: str | None) -> str:
    return "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode()) for c in text or "")


class Archive:
    """One archive file under a name of its own, each record a compressed member."""

    def __init__(self, folder: str, date: str) -> None:
        system, path = open_folder(folder)
        name = f"{uuid.uuid4().hex}.warc.gz"
        system.create_dir(path, recursive=True)
        self.uri, self.date = f"{folder}/{name}", date
        self.out = system.open_output_stream(f"{path}/{name}", compression=None)
        self.n_records = self.n_bytes = 0

    def begin(self, row: dict) -> None:
        self.packer = zlib.compressobj(4, zlib.DEFLATED, 31)
        self.row, self.seen, self.digest = row, 0, hashlib.sha1()
        revisit = row["refers_to"] is not None
        block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['n_bytes']}\r\n\r\n".encode()
        lines = [
            VERSION, f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{header_value(row['record_id'])}>", f"WARC-Date: {self.date}",
            f"WARC-Target-URI: {header_value(row['target_uri'])}", f"WARC-Payload-Digest: sha1:{row['digest']}",
            *([f"WARC-Profile: {SAME_PAYLOAD}", f"WARC-Refers-To: <{header_value(row['refers_to'])}>"] if revisit else []),
            "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block) + (0 if revisit else row['n_bytes'])}",
        ]
        self.put("\r\n".join(lines).encode() + b"\r\n\r\n" + block)

    def put(self, data: bytes) -> None:
        self.n_bytes += len(data)
        self.out.write(self.packer.compress(data))

    def chunk(self, data: bytes) -> None:
        self.seen += len(data)
        self.digest.update(data)
        self.put(data)

    def end(self) -> None:
        if self.row["refers_to"] is None and (self.seen != self.row["n_bytes"] or base64.b32encode(self.digest.digest()).decode() != self.row["digest"]):
            raise ValueError(f"chunks of {self.row['record_id']} are not its payload")
        self.put(b"\r\n\r\n")
        self.out.write(self.packer.flush())
        self.n_records += 1

    def close(self) -> tuple[str, int, int]:
        self.out.close()
        return self.uri, self.n_records, self.n_bytes


def write_archives(chunks: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write chunk rows into archives below ``folder`` (shared by all executors) and return their manifest.

    Archive names are drawn anew for each attempt of a task and the manifest, which is written before it is returned,
    names those of the attempts that counted, so a repeated task leaves at most unnamed files behind. An empty table writes
    nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, done = None, []
        for batch in batches:
            columns = {name: batch.column(name) for name in batch.schema.names}
            for i in range(batch.num_rows):
                if columns["chunk_no"][i].as_py() == 0:
                    if archive and archive.n_bytes >= archive_bytes:
                        done.append(archive.close())
                        archive = None
                    archive = archive or Archive(folder, date)
                    archive.begin({name: columns[name][i].as_py() for name in ("record_id", "target_uri", "refers_to", "digest", "n_bytes")})
                archive.chunk(columns["data"][i].as_py())
                if columns["is_last"][i].as_py():
                    archive.end()
        if archive:
            done.append(archive.close())
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], kind) for k, kind in enumerate((pa.string(), pa.int64(), pa.int64()))], MANIFEST.names)

    spark = chunks.sparkSession
    chunks.mapInArrow(run, MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


class Stream:
    """Uncompressed bytes of an archive, read through a small buffer."""

    def __init__(self, raw: pa.NativeFile, step: int = 256 << 10) -> None:
        self.raw, self.step, self.buffer = raw, step, b""
        head = raw.read(step)
        self.member = zlib.decompressobj(31) if head[:2] == b"\x1f\x8b" else None
        self.packed = head

    def more(self) -> bool:
        data = b""
        while not data:
            packed = self.packed or self.raw.read(self.step)
            self.packed = b""
            if not packed:
                if self.member and not self.member.eof and self.member.unconsumed_tail:
                    raise ValueError("the archive ends within a record")
                return False
            if self.member is None:
                data = packed
                continue
            if self.member.eof:
                self.member = zlib.decompressobj(31)
            data = self.member.decompress(packed, self.step)
            self.packed = self.member.unconsumed_tail or self.member.unused_data
        self.buffer += data
        return True

    def line(self, most: int = 1 << 20) -> bytes | None:
        """The next line without its end; None at the end of the archive."""
        while (at := self.buffer.find(b"\n")) < 0:
            if len(self.buffer) > most:
                raise ValueError("a header line is too long")
            if not self.more():
                if self.buffer:
                    raise ValueError("the archive ends within a header")
                return None
        found, self.buffer = self.buffer[:at], self.buffer[at + 1 :]
        return found.rstrip(b"\r")

    def take(self, n: int) -> bytes:
        """At least one and at most ``n`` bytes."""
        if not self.buffer and not self.more():
            raise ValueError("the archive ends within a record")
        found, self.buffer = self.buffer[:n], self.buffer[n:]
        return found


def headers(stream: Stream) -> dict[str, str]:
    found = {}
    while line := stream.line():
        name, _, value = line.decode("utf-8", "replace").partition(":")
        found[name.strip().lower()] = value.strip()
    return found


def records(stream: Stream, chunk_bytes: int) -> Iterator[tuple]:
    """Rows of ``CHUNKS`` without the path."""
    number = 0
    while (line := stream.line()) is not None:
        if not line:
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record starts with {line[:40]!r}")
        head = headers(stream)
        left = int(head["content-length"])
        declared = None
        if head.get("content-type", "").startswith("application/http"):
            status = stream.line()
            left -= len(status) + 2
            while line := stream.line():
                left -= len(line) + 2
                name, _, value = line.decode("utf-8", "replace").partition(":")
                if name.strip().lower() == "content-length":
                    declared = int(value)
            left -= 2
        named = [head.get(k, "").strip("<>") or None for k in ("warc-record-id", "warc-type", "warc-target-uri", "warc-refers-to")]
        digest, total, chunk = hashlib.sha1(), 0, 0
        while True:
            parts, size = [], 0
            while left and size < chunk_bytes:
                parts.append(stream.take(min(left, chunk_bytes - size)))
                size += len(parts[-1])
                left -= len(parts[-1])
            data = b"".join(parts)
            digest.update(data)
            total += size
            yield (number, *named, head.get("warc-payload-digest", "").removeprefix("sha1:") or None, declared, chunk, data, total, base64.b32encode(digest.digest()).decode(), left == 0)
            chunk += 1
            if not left:
                break
        number += 1


def read_chunks(manifest: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Chunk rows of the archives named in column ``path``; each archive is streamed once by one task.

    A record without payload is one empty chunk. Damaged archives fail with the reason. Rows of one record are consecutive and
    ordered by ``chunk_no``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [T.StructField(f.name, f.dataType) for f in CHUNKS]
        arrow = pa.schema([(f.name, {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}[f.dataType.simpleString()]) for f in kinds])

        def packed(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(column, field.type) for column, field in zip(zip(*rows), arrow)], schema=arrow)

        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, name = open_folder(path)
                with system.open_input_stream(name, compression=None) as raw:
                    rows, size = [], 0
                    for row in records(Stream(raw), chunk_bytes):
                        rows.append((path, *row))
                        size += len(row[8]) + 200
                        if size >= BATCH_BYTES:
                            yield packed(rows)
                            rows, size = [], 0
                    if rows:
                        yield packed(rows)

    archives = manifest.select("path")
    return archives.repartition(max(1, archives.sparkSession.sparkContext.defaultParallelism)).mapInArrow(run, CHUNKS)


def archive_folder(spark) -> str:
    return scratch_path(spark, "warc")
