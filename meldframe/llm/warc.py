"""WARC archives as a chunked record table.

``chunks`` turns payloads into rows ``record, chunk, of, data``, so that writing and reading handle one
chunk at a time. ``write_archives`` streams these rows into archives, a gzip member for each record;
``read_chunks`` streams archives back into such rows, with the SHA-256 of the payload so far. No payload
is put together anywhere. An archive appears under its final name only when it is whole, and a lost
task writes it again under a name of its own; the list of archives comes from the tasks that ended well.

The folder may be any URI that pyarrow's file systems open (file, hdfs, s3, gs) and must be shared.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meldframe.llm.shared import bounded_batches, require, written

#: A worker holds at most an Arrow batch of chunks: 512 of them.
CHUNK_BYTES = 1 << 16
#: Payloads shorter than this are never revisits.
REVISIT_BYTES = 100
#: An archive is closed, between records, once it has this many bytes.
ARCHIVE_BYTES = 256 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD = T.StructType(
    [
        T.StructField("record", T.LongType()),
        T.StructField("chunk", T.IntegerType()),
        T.StructField("data", T.BinaryType()),
        T.StructField("digest_so_far", T.StringType()),
        T.StructField("last", T.BooleanType()),
        T.StructField("intact", T.BooleanType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("refers_to", T.LongType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("uri", T.StringType()),
    ]
)


def decide(pages: DataFrame, record: str, payload: str, uri: str) -> DataFrame:
    """``record, uri, data, bytes, digest, type, refers_to``: of equal payloads of at least ``REVISIT_BYTES``
    the smallest record is the response and the others revisit it; shorter payloads are all responses.

    Record identifiers are integers, as is what casts to long; others are an error. A NULL payload is empty. Repeated rows of the smallest record are all responses; a NULL record is never
    the smallest, and where all are NULL all are responses. Digests that occur once need no join's answer: the
    smallest records of the others are combined before the shuffle and written, so that Spark can split the rows of
    a digest that very many copies share, or send so few digests to the payloads. Other columns aren't read.
    """
    require(pages, record, payload, uri)
    data = F.coalesce(F.col(f"`{payload}`").cast("binary"), F.lit("").cast("binary"))
    own = pages.select(F.col(f"`{record}`").cast("long").alias("record"), F.col(f"`{uri}`").cast("string").alias("uri"), data.alias("data"))
    own = own.withColumns({"bytes": F.octet_length("data").cast("long"), "digest": F.sha2("data", 256)})
    first = own.where(F.col("bytes") >= REVISIT_BYTES).groupBy("digest").agg(F.min("record").alias("first"), F.count("*").alias("n"))
    first = written(first.where("n > 1").select("digest", "first"), "first-records")
    joined = own.join(first, "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("record"))
    return joined.select(
        "record",
        "uri",
        F.when(revisit, F.lit("").cast("binary")).otherwise(F.col("data")).alias("data"),
        "bytes",
        "digest",
        F.when(revisit, "revisit").otherwise("response").alias("type"),
        F.when(revisit, F.col("first")).alias("refers_to"),
    )


def chunks(records: DataFrame, *, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``records`` with ``data`` cut into rows ``chunk`` (from 0) ``of``; the rows of a record follow each other."""
    pieces = F.greatest(F.lit(1), F.ceil(F.octet_length("data") / chunk_bytes)).cast("int")
    rows = records.withColumn("of", pieces).withColumn("chunk", F.explode(F.expr("sequence(0, of - 1)")))
    return rows.withColumn("data", F.expr(f"substring(data, chunk * {chunk_bytes} + 1, {chunk_bytes})"))


def _header(row: dict) -> bytes:
    block = row["bytes"] if row["type"] == "response" else 0
    uri = (row["uri"] or "").replace("\r", "%0D").replace("\n", "%0A")
    lines = ["WARC/1.1", f"WARC-Type: {row['type']}", f"WARC-Record-ID: <urn:record:{'' if row['record'] is None else row['record']}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    lines += [f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha256:{row['digest']}", f"X-Payload-Length: {row['bytes']}"]
    if row["type"] == "revisit":
        lines += [f"WARC-Refers-To: <urn:record:{row['refers_to']}>", f"WARC-Profile: {PROFILE}"]
    return ("\r\n".join([*lines, "Content-Type: application/octet-stream", f"Content-Length: {block}"]) + "\r\n\r\n").encode()


class _Archive:
    """One archive being written; it gets its name when it is closed."""

    def __init__(self, folder: str, level: int):
        self.files, base = pafs.FileSystem.from_uri(folder)
        self.files.create_dir(base, recursive=True)
        self.name = uuid.uuid4().hex
        self.part, self.final = f"{base}/{self.name}.part", f"{base}/{self.name}.warc.gz"
        self.out, self.level, self.size, self.records = self.files.open_output_stream(self.part), level, 0, 0

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def begin(self, header: bytes) -> None:
        self.zip = zlib.compressobj(self.level, zlib.DEFLATED, 31)
        self._put(self.zip.compress(header))

    def add(self, data: bytes) -> None:
        self._put(self.zip.compress(data))

    def end(self) -> None:
        self._put(self.zip.compress(b"\r\n\r\n") + self.zip.flush())
        self.records += 1

    def close(self) -> tuple[str, int, int]:
        self.out.close()
        self.files.move(self.part, self.final)
        return f"{self.name}.warc.gz", self.records, self.size


def write_archives(chunked: DataFrame, folder: str, *, level: int = 1, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes the rows of ``chunks`` and returns a row ``archive, records, bytes`` for each archive. Rows of a record
    that don't follow each other in order are an error.

    The result is lazy and must be evaluated once: each evaluation writes archives of its own.
    """
    bounded_batches(chunked.sparkSession)
    columns = ["record", "uri", "data", "bytes", "digest", "type", "refers_to", "of", "chunk"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, archive, awaited = [], None, (0, None)
        for batch in batches:
            for row in batch.to_pylist():
                if (row["chunk"], row["chunk"] and row["record"]) != (awaited[0], awaited[0] and awaited[1]):
                    raise ValueError(f"chunk {row['chunk']} of record {row['record']} isn't where it should be: the rows of a record must follow each other")
                if row["chunk"] == 0:
                    archive = archive or _Archive(folder, level)
                    archive.begin(_header(row))
                archive.add(row["data"])
                awaited = ((row["chunk"] + 1) % row["of"], row["record"])
                if not awaited[0]:
                    archive.end()
                    if archive.size >= archive_bytes:
                        done.append(archive.close())
                        archive = None
        if awaited[0]:
            raise ValueError(f"record {awaited[1]} lacks chunks from {awaited[0]} on")
        if archive:
            done.append(archive.close())
        names, records, sizes = (list(x) for x in zip(*done, strict=True)) if done else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(records, pa.int64()), pa.array(sizes, pa.int64())], ["archive", "records", "bytes"])

    return chunked.select(*columns).mapInArrow(run, "archive string, records long, bytes long")


def _inflated(stream, size: int = 1 << 18) -> Iterator[bytes]:
    """The bytes of all gzip members, a bounded piece at a time."""
    unzip = zlib.decompressobj(31)
    while data := stream.read(size):
        while data:
            out = unzip.decompress(data, size)
            if out:
                yield out
            if unzip.eof:
                data, unzip = unzip.unused_data, zlib.decompressobj(31)
            else:
                data = unzip.unconsumed_tail


class _Bytes:
    """Reads lines and counted runs from an iterator of byte strings, keeping one of them."""

    def __init__(self, parts: Iterator[bytes]):
        self.parts, self.left = parts, b""

    def _more(self) -> bool:
        part = next(self.parts, None)
        self.left += part or b""
        return part is not None

    def line(self) -> bytes | None:
        while (at := self.left.find(b"\r\n")) < 0:
            if not self._more():
                if self.left:
                    raise ValueError("the archive ends inside a record")
                return None
        out, self.left = self.left[:at], self.left[at + 2 :]
        return out

    def run(self, size: int) -> bytes:
        have, n = [self.left], len(self.left)
        while n < size:
            part = next(self.parts, None)
            if part is None:
                raise ValueError("the archive ends inside a record")
            have.append(part)
            n += len(part)
        whole = b"".join(have)
        self.left = whole[size:]
        return whole[:size]


def _records(source: _Bytes, chunk_bytes: int) -> Iterator[tuple]:
    while (version := source.line()) is not None:
        if not version.startswith(b"WARC/1."):
            raise ValueError("not a WARC record")
        headers = {}
        while line := source.line():
            name, _, value = line.partition(b":")
            headers[name.strip().lower().decode()] = value.strip().decode()
        urn = lambda key: int(v) if (v := headers.get(key, "").strip("<>").rpartition(":")[2]) else None
        left, sha, number, size = int(headers["content-length"]), hashlib.sha256(), 0, 0
        kind, declared = headers["warc-type"], headers["warc-payload-digest"].removeprefix("sha256:")
        while True:
            data = source.run(min(left, chunk_bytes))
            left, size = left - len(data), size + len(data)
            sha.update(data)
            digest = sha.hexdigest()
            intact = (kind == "revisit" or digest == declared) if not left else None
            yield urn("warc-record-id"), number, data, digest, not left, intact, kind, urn("warc-refers-to"), int(headers["x-payload-length"]) if kind == "revisit" else size, declared, headers.get("warc-target-uri")
            number += 1
            if not left:
                break
        if source.run(4) != b"\r\n\r\n":
            raise ValueError("a record doesn't end where it should")


def read_chunks(archives: DataFrame, folder: str, *, chunk_bytes: int = CHUNK_BYTES, with_data: bool = True) -> DataFrame:
    """The rows of ``RECORD`` of the archives named in the column ``archive``: an archive is read by one task,
    a chunk at a time. ``intact``, on a record's last row, says if the payload has the declared digest.
    ``payload_bytes`` counts the bytes read so far; of a revisit, whose payload isn't there, it is the header's.

    A damaged archive is an error. ``with_data=False`` reads and digests the payloads but leaves them out.
    """
    bounded_batches(archives.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = pafs.FileSystem.from_uri(folder)
        schema = pa.schema([(f.name, {"long": pa.int64(), "integer": pa.int32(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_()}[f.dataType.typeName()]) for f in RECORD])
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with files.open_input_stream(f"{base}/{name}", compression=None) as stream:
                    rows, size = [], 0
                    for row in _records(_Bytes(_inflated(stream)), chunk_bytes):
                        rows.append(row if with_data else (*row[:2], None, *row[3:]))
                        size += len(rows[-1][2] or b"") + 200
                        if size > 4 * chunk_bytes:
                            yield _batch(rows, schema)
                            rows, size = [], 0
                    if rows:
                        yield _batch(rows, schema)

    return archives.select("archive").mapInArrow(run, RECORD)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def spread(spark: SparkSession, archives: DataFrame) -> DataFrame:
    """The archives over as many tasks as there are archives, up to the session's shuffle partitions."""
    return archives.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "archive")
