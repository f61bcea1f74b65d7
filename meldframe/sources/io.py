"""Lazy dataset sources and sinks. Paths may be of any file system that Hadoop knows."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from functools import cached_property
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from meldframe.functions.naming import quoted
from meldframe.operators.keyed import as_list
from meldframe.session import get_spark
from meldframe.sources import versions

WriteData = DataFrame | Mapping[str, DataFrame]

# Formats by file extension, and compression suffixes that may follow one.
FORMATS = {
    ".parquet": "parquet",
    ".csv": "csv",
    ".tsv": "csv",
    ".json": "json",
    ".jsonl": "json",
    ".ndjson": "json",
    ".xlsx": "excel",
    ".xls": "excel",
    ".orc": "orc",
    ".avro": "avro",
    ".delta": "delta",
}
COMPRESSIONS = (".gz", ".snappy", ".zstd", ".zst", ".lz4", ".bz2", ".deflate")
_URI = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*://|/")


def format_of_name(path: str) -> str | None:
    """The format that a file's extension stands for, in any letter case; a trailing slash doesn't matter."""
    name = path.rstrip("/").rpartition("/")[2].lower()
    for suffix in COMPRESSIONS:
        name = name.removesuffix(suffix)
    dot = name.rfind(".")
    return FORMATS.get(name[dot:]) if dot >= 0 else None


def looks_like_table(path: str) -> bool:
    """Whether a name without a known extension is a catalog table's: no scheme and no separator in it."""
    return not _URI.match(path) and "/" not in path


def peek_format(path: str, spark: SparkSession) -> str | None:
    """The format of a folder by what it holds: a transaction log, a version log, or the first data file."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(hadoop):
        return None
    names = sorted(s.getPath().getName() for s in files.listStatus(hadoop))
    if "_delta_log" in names:
        return "delta"
    if versions.LOG in names:
        return "versioned"
    return next((f for n in names if not n.startswith(("_", ".")) and (f := format_of_name(n))), None)


class Input:
    """A dataset to read. Nothing is read, and no session needed, until ``dataframe()``."""

    def __init__(self, path: str, format: str | None = None, *, spark: SparkSession | None = None, **options: Any):
        self.path, self.format, self.options, self._spark = path, format, options, spark

    @classmethod
    def table(cls, name: str, **options: Any) -> Input:
        return cls(name, "table", **options)

    @cached_property
    def fmt(self) -> str:
        """The given format, else by extension, else by looking into the folder, else ``table`` or ``delta``."""
        if self.format:
            return self.format
        if found := format_of_name(self.path):
            return found
        if looks_like_table(self.path):
            return "table"
        return peek_format(self.path, get_spark(self._spark)) or "delta"

    def dataframe(self) -> DataFrame:
        spark, fmt = get_spark(self._spark), self.fmt
        if fmt == "excel":
            return _read_excel(spark, self.path, **self.options)
        if fmt == "table":
            return spark.read.options(**self.options).table(self.path)
        if fmt == "versioned":
            return versions.read(spark, self.path, **self.options)
        options = dict(self.options)
        if fmt == "csv":
            options = {"header": "true", "inferSchema": "false"} | ({"sep": "\t"} if _is_tsv(self.path) else {}) | options
        return spark.read.format(fmt).options(**options).load(self.path)

    read = dataframe

    def __repr__(self) -> str:
        return f"Input({self.path!r}, format={self.format!r})"


def _is_tsv(path: str) -> bool:
    name = path.rstrip("/").lower()
    for suffix in COMPRESSIONS:
        name = name.removesuffix(suffix)
    return name.endswith(".tsv")


class Output:
    """A dataset to write: a file folder, a catalog table, a versioned folder, or an Excel file."""

    def __init__(
        self,
        path: str,
        format: str | None = None,
        mode: str = "overwrite",
        partition_by: str | Iterable[str] | None = None,
        table_format: str = "delta",
        merge_on: str | Iterable[str] | None = None,
        **options: Any,
    ):
        self.path, self.format, self.mode, self.table_format, self.options = path, format, mode, table_format, options
        self.partition_by, self.merge_on = as_list(partition_by), as_list(merge_on)

    @classmethod
    def table(cls, name: str, *, mode: str = "overwrite", format: str = "delta", partition_by=None, merge_on=None, **options: Any) -> Output:
        return cls(name, "table", mode, partition_by, format, merge_on, **options)

    @property
    def fmt(self) -> str:
        return self.format or format_of_name(self.path) or "delta"

    def write(self, data: WriteData) -> None:
        if self.mode == "merge":
            if not self.merge_on:
                raise ValueError("mode 'merge' needs merge_on")
            if isinstance(data, Mapping):
                raise TypeError("a merge takes one DataFrame")
            self.merge_into(data, self.merge_on)
        elif self.fmt == "excel":
            if self.partition_by or self.mode != "overwrite":
                raise ValueError("an Excel file can only be overwritten, without partitions")
            _write_excel(data, self.path, **self.options)
        elif isinstance(data, Mapping):
            raise TypeError("only Excel files take several DataFrames")
        elif self.fmt == "table":
            writer = data.write.format(self.table_format).mode(self.mode).options(**self.options)
            (writer.partitionBy(*self.partition_by) if self.partition_by else writer).saveAsTable(self.path)
        elif self.fmt == "versioned":
            versions.VersionedTable(data.sparkSession, self.path).write(data, self.mode, partition_by=self.partition_by)
        else:
            options = ({"header": "true"} | ({"sep": "\t"} if _is_tsv(self.path) else {}) if self.fmt == "csv" else {}) | self.options
            writer = data.write.format(self.fmt).mode(self.mode).options(**options)
            (writer.partitionBy(*self.partition_by) if self.partition_by else writer).save(self.path)

    write_dataframe = write

    def merge_into(self, df: DataFrame, on: str | Iterable[str], when_matched_update: bool = True, when_not_matched_insert: bool = True) -> dict[str, int]:
        """An upsert by key into an existing target, all columns; the counts of rows by what happened to them."""
        from meldframe.operators.merge import target_of, upsert

        target = target_of(df.sparkSession, self.path)
        return upsert(target, df, as_list(on), update=when_matched_update, insert=when_not_matched_insert)

    def __repr__(self) -> str:
        return f"Output({self.path!r}, format={self.format!r}, mode={self.mode!r})"


def _read_excel(spark: SparkSession, path: str, sheet_name: Any = 0, **options: Any) -> DataFrame:
    """One sheet, read on the driver by pandas; a spreadsheet is small by nature."""
    import io

    import pandas as pd

    content = spark.read.format("binaryFile").load(path).select("content").first()[0]
    return spark.createDataFrame(pd.read_excel(io.BytesIO(bytes(content)), sheet_name=sheet_name, **options))


def _write_excel(data: WriteData, path: str, sheet_name: str = "Sheet1", **options: Any) -> None:
    import io

    import pandas as pd

    sheets = dict(data) if isinstance(data, Mapping) else {sheet_name: data}
    spark = next(iter(sheets.values())).sparkSession
    buffer = io.BytesIO()
    with pd.ExcelWriter(buffer) as writer:
        for name, df in sheets.items():
            df.toPandas().to_excel(writer, sheet_name=name, index=False, **options)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(hadoop, True)
    out.write(bytearray(buffer.getvalue()))
    out.close()


def table_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def quoted_table(name: str) -> str:
    return ".".join(quoted(p.strip("`")) for p in name.split("."))
