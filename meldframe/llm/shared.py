"""What the operators share: scratch tables, bounded Arrow batches and free column names."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

#: Rows of an Arrow batch sent to Python. Texts may be long: this bounds a worker's memory.
BATCH_ROWS = 512


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder shared by all executors, from ``spark.checkpoint.dir``.

    Only a local session, whose driver and executors are one process, falls back to a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return _local_folder()


@lru_cache(maxsize=1)
def _local_folder() -> str:
    """A temporary folder that goes with the process."""
    folder = tempfile.mkdtemp(prefix="meldframe-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return f"file://{folder}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; Spark's file system removes it when the driver's JVM ends."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{checkpoint_dir(spark)}/meldframe-{name}-{uuid.uuid4().hex}")
    files = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.deleteOnExit(hadoop)
    path = files.makeQualified(hadoop).toString()
    return "file://" + path.removeprefix("file:") if path.startswith("file:/") and not path.startswith("file://") else path


def delete_scratch(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


@contextmanager
def session_settings(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """The session with ``settings``, which get their old values back."""
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def kept_table(df: DataFrame, name: str, **options: str) -> tuple[DataFrame, str]:
    """``written``, and the table's path, for ``delete_scratch`` once it is no longer read."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with session_settings(spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}):
        df.write.options(**{"compression": "zstd"} | options).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def bucketed_table(df: DataFrame, key: str, name: str, **options: str) -> tuple[DataFrame, Callable[[], None]]:
    """``df`` written like ``kept_table``, in as many buckets by ``key`` as a shuffle has partitions, so that grouping
    it by the key needs no shuffle; and what drops it. Its name is known to the session's catalog until then."""
    spark = df.sparkSession
    path, table = scratch_path(spark, name), f"meldframe_{uuid.uuid4().hex}"
    with session_settings(spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}):
        writer = df.write.format("parquet").options(**{"compression": "zstd"} | options).option("path", path)
        writer.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key).saveAsTable(table)

    def drop() -> None:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
        delete_scratch(spark, path)

    return spark.table(table), drop


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as a Parquet table in the shared folder and read again: it cuts lineage, and
    survives the loss of executors. Nothing is computed twice, and the shuffle files go at once."""
    return kept_table(df, name)[0]


@lru_cache(maxsize=1)
def _zstd() -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def packed(values: np.ndarray) -> bytes:
    """The array's bytes by plane, compressed: planes of high bytes are mostly zeros."""
    if not len(values):
        return b""
    size, data = values.dtype.itemsize, np.ascontiguousarray(values).view(np.uint8)
    return _zstd()[0].compress(b"".join([np.ascontiguousarray(data[k::size]) for k in range(size)]))


def unpacked(data: bytes, kind: type) -> np.ndarray:
    if not data:
        return np.empty(0, kind)
    planes = np.frombuffer(_zstd()[1].decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of at most ``BATCH_ROWS`` rows from here on in this session: frames are evaluated later, and
    must then find the setting."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def release_memory() -> None:
    """Gives freed memory back to the system: worker processes outlive their tasks."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(_libc(), "malloc_trim", None):
        trim(0)


@lru_cache(maxsize=1)
def _libc():
    try:
        return ctypes.CDLL(None)
    except (OSError, TypeError):
        return None


def releasing(run):
    """A function of batches that releases memory at its task's end."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release_memory()

    return whole


def free_name(wanted: str, taken: Iterable[str]) -> str:
    used = {c.lower() for c in taken}
    while wanted.lower() in used:
        wanted += "_"
    return wanted


def require(df: DataFrame, *columns: str) -> None:
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
