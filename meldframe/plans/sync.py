"""Incremental synchronization: snapshot or change feed for each source, with state and audit tables."""

from __future__ import annotations

import logging
from collections.abc import Iterable, Sequence
from datetime import datetime, timezone
from typing import Any, NamedTuple, TypedDict

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meldframe.operators.columns import clean_columns
from meldframe.operators.keyed import ordered_list_by_key
from meldframe.operators.merge import (
    DEFAULT_CDF_METADATA,
    change_plan,
    check_unambiguous,
    collapse_changes,
    plain_metadata,
    read_cdf,
    snapshot_plan,
    target_of,
    upsert,
)
from meldframe.plans.parallel import run_parallel
from meldframe.session import get_spark
from meldframe.sources.io import Input
from meldframe.sources.versions import VersionedTable, current_version

log = logging.getLogger(__name__)

INITIAL, SNAPSHOT, CURRENT, CHANGES, NO_CHANGES = "initial_snapshot", "snapshot_merge", "already_current", "cdf_merge", "cdf_noop"
UNKNOWN = -1
_ZERO = {"numTargetRowsInserted": 0, "numTargetRowsUpdated": 0, "numTargetRowsDeleted": 0, "numOutputRows": 0}

STATE = T.StructType([T.StructField(n, t, False) for n, t in (("src_key", T.StringType()), ("dst_table", T.StringType()), ("src_path", T.StringType()), ("last_delta_version", T.LongType()), ("sync_mode", T.StringType()), ("synced_at", T.TimestampType()))])
AUDIT = T.StructType(
    [T.StructField(n, T.StringType(), False) for n in ("src_key", "src_path", "dst_table", "sync_mode")]
    + [T.StructField(n, T.LongType(), False) for n in ("last_delta_version", "rows_inserted", "rows_updated", "rows_deleted", "rows_output")]
    + [T.StructField("audited_at", T.TimestampType(), False)]
)


class SyncSpec(TypedDict):
    src_key: str
    src_path: str
    dst_table: str
    pks: list[str]


class SyncResult(TypedDict, total=False):
    src_key: str
    src_path: str
    dst_table: str
    last_delta_version: int
    sync_mode: str
    metrics: dict[str, int]


class SyncAuditRow(TypedDict):
    src_key: str
    src_path: str
    dst_table: str
    sync_mode: str
    last_delta_version: int
    rows_inserted: int
    rows_updated: int
    rows_deleted: int
    rows_output: int
    audited_at: datetime


class Failure(NamedTuple):
    spec: SyncSpec
    error: Exception


def decide(last: int | None, target_exists: bool, current: int | None) -> tuple[str, int]:
    """What to do and which version to record. ``changes`` may still turn out to be none.

    An unknown last version (None or -1) and a source whose version went back call for a snapshot.
    """
    recorded = UNKNOWN if current is None else current
    if not target_exists:
        return INITIAL, recorded
    if last is None or last == UNKNOWN or current is None or current < last:
        return SNAPSHOT, recorded
    return (CURRENT, current) if last == current else (CHANGES, current)


class SyncState:
    """The last synchronized version of each source, in a table."""

    def __init__(self, table: str, *, format: str = "parquet", spark: SparkSession | None = None):
        self.table, self.format, self._spark = table, format, spark

    @property
    def spark(self) -> SparkSession:
        return get_spark(self._spark)

    def ensure(self) -> None:
        if not self.spark.catalog.tableExists(self.table):
            self.spark.createDataFrame([], STATE).write.format(self.format).saveAsTable(self.table)

    def get(self, src_key: str) -> int | None:
        if not self.spark.catalog.tableExists(self.table):
            return None
        row = self.spark.table(self.table).where(F.col("src_key") == src_key).select("last_delta_version").first()
        return None if row is None else row[0]

    def load_all(self) -> dict[str, int]:
        if not self.spark.catalog.tableExists(self.table):
            return {}
        return {r[0]: r[1] for r in self.spark.table(self.table).select("src_key", "last_delta_version").collect()}

    def upsert(self, result: SyncResult) -> None:
        self.upsert_all([result])

    def upsert_all(self, results: Iterable[SyncResult]) -> None:
        """One merge by ``src_key``; no results, no write."""
        now = datetime.now(timezone.utc).replace(tzinfo=None)
        rows = [(r["src_key"], r["dst_table"], r["src_path"], r["last_delta_version"], r["sync_mode"], now) for r in results]
        if rows:
            self.ensure()
            upsert(self.table, self.spark.createDataFrame(rows, STATE), ["src_key"])


class SyncAudit:
    """A row for each successful synchronization, appended to a table."""

    def __init__(self, table: str, *, format: str = "parquet", max_workers: int = 8, spark: SparkSession | None = None):
        self.table, self.format, self.max_workers, self._spark = table, format, max_workers, spark

    @property
    def spark(self) -> SparkSession:
        return get_spark(self._spark)

    def ensure(self) -> None:
        if not self.spark.catalog.tableExists(self.table):
            self.spark.createDataFrame([], AUDIT).write.format(self.format).saveAsTable(self.table)

    def append(self, results: Iterable[SyncResult]) -> list[SyncAuditRow]:
        """The counts are those of the result's own commit; modes that write nothing have zeros."""
        now = datetime.now(timezone.utc).replace(tzinfo=None)
        rows = [audit_row(r, now) for r in results]
        if rows:
            self.ensure()
            data = [tuple(r[f.name] for f in AUDIT.fields) for r in rows]
            self.spark.createDataFrame(data, AUDIT).write.format(self.format).mode("append").saveAsTable(self.table)
        return rows


def audit_row(result: SyncResult, at: datetime) -> SyncAuditRow:
    m = _ZERO | dict(result.get("metrics") or {})
    return {
        "src_key": result["src_key"],
        "src_path": result["src_path"],
        "dst_table": result["dst_table"],
        "sync_mode": result["sync_mode"],
        "last_delta_version": result["last_delta_version"],
        "rows_inserted": m["numTargetRowsInserted"],
        "rows_updated": m["numTargetRowsUpdated"],
        "rows_deleted": m["numTargetRowsDeleted"],
        "rows_output": m["numOutputRows"],
        "audited_at": at,
    }


_ASK = object()


def sync_delta_to_table(
    *,
    src_key: str,
    src_path: str,
    dst_table: str,
    pks: Sequence[str],
    state: SyncState,
    last_version: Any = _ASK,
    cdf_metadata_cols: Iterable[str] = DEFAULT_CDF_METADATA,
    table_format: str = "parquet",
    spark: SparkSession | None = None,
) -> SyncResult:
    """Brings one target up to its source; the state isn't written.

    Changes are read from the version after the last up to the one recorded, and snapshots as of that one. If Spark
    can't read the changes, for instance because they were cleaned up, a snapshot is merged; missing keys and a
    failure of the merge itself are raised.
    """
    spark = get_spark(spark)
    last = state.get(src_key) if last_version is _ASK else last_version
    current = current_version(spark, src_path)
    mode, recorded = decide(last, _exists(spark, dst_table), current)
    metrics = dict(_ZERO)

    def snapshot() -> DataFrame:
        source = Input(src_path, spark=spark)
        if current is not None and source.fmt in ("versioned", "delta"):
            source = Input(src_path, source.fmt, spark=spark, **{"version" if source.fmt == "versioned" else "versionAsOf": current})
        df = clean_columns(source.dataframe())
        if missing := [k for k in pks if k not in df.columns]:
            raise ValueError(f"{src_key}: keys missing in the source: {', '.join(missing)}")
        return df

    def merged() -> dict[str, int]:
        target, df = target_of(spark, dst_table), snapshot()
        check_unambiguous(target.read(), df, pks)
        return target.apply(snapshot_plan(target.read(), df, pks), SNAPSHOT)

    if mode == INITIAL:
        df = snapshot()
        if "/" in dst_table:
            VersionedTable(spark, dst_table).write(df)
        else:
            df.write.format(table_format).mode("overwrite").saveAsTable(dst_table)
        n = target_of(spark, dst_table).read().count()
        metrics |= {"numTargetRowsInserted": n, "numOutputRows": n}
    elif mode == SNAPSHOT:
        metrics |= merged()
    elif mode == CHANGES:
        try:
            feed = clean_columns(plain_metadata(read_cdf(src_path, last + 1, recorded, spark=spark), cdf_metadata_cols))
            lacking = [k for k in pks if k not in feed.columns]
            none = not lacking and (changes := collapse_changes(feed, pks, metadata_cols=cdf_metadata_cols)).isEmpty()
        except (PySparkException, Py4JJavaError) as error:
            log.warning("%s: no change feed (%s); merging a snapshot", src_key, error)
            mode = SNAPSHOT
            metrics |= merged()
        else:
            if lacking:
                raise ValueError(f"{src_key}: keys missing in the change feed: {', '.join(lacking)}")
            mode = NO_CHANGES if none else CHANGES
            if not none:
                target = target_of(spark, dst_table)
                metrics |= target.apply(change_plan(target.read(), changes, pks, metadata_cols=cdf_metadata_cols), CHANGES)
    return {"src_key": src_key, "src_path": src_path, "dst_table": dst_table, "last_delta_version": recorded, "sync_mode": mode, "metrics": metrics}


def _exists(spark: SparkSession, name: str) -> bool:
    return VersionedTable(spark, name).exists() if "/" in name else spark.catalog.tableExists(name)


def run_sync(
    specs: Iterable[SyncSpec],
    state: SyncState,
    *,
    max_workers: int = 4,
    pool: str | None = None,
    cdf_metadata_cols: Iterable[str] = DEFAULT_CDF_METADATA,
    audit: SyncAudit | None = None,
    spark: SparkSession | None = None,
) -> tuple[list[SyncResult], list[Failure]]:
    """Synchronizes all specs in parallel: one read of the state before, one merge of it and one audit append after."""
    spark = get_spark(spark)
    state.ensure()
    known, specs = state.load_all(), list(specs)
    jobs = [{**{k: s[k] for k in ("src_key", "src_path", "dst_table", "pks")}, "state": state, "last_version": known.get(s["src_key"]), "cdf_metadata_cols": cdf_metadata_cols, "spark": spark} for s in specs]
    results = run_parallel(sync_delta_to_table, jobs, max_workers, pool, spark=spark)
    done = [r for r in results if not isinstance(r, Exception)]
    failed = [Failure(s, r) for s, r in zip(specs, results, strict=True) if isinstance(r, Exception)]
    state.upsert_all(done)
    if audit is not None:
        audit.append(done)
    return done, failed


SPEC_COLUMNS = ("schema_name", "table_name", "column_name", "position")


def key_lists(metadata: DataFrame) -> DataFrame:
    """``schema_name, table_name, pks``: each table's key columns in order of position and name.

    Names are trimmed and lower-cased; rows with a blank name or a position that is no number are left out."""
    if missing := [c for c in SPEC_COLUMNS if c not in metadata.columns]:
        raise ValueError(f"metadata lacks {', '.join(missing)}")
    tidy = metadata.select(*(F.lower(F.trim(c)).alias(c) for c in SPEC_COLUMNS[:3]), F.expr("try_cast(trim(CAST(position AS string)) AS int)").alias("position"))
    tidy = tidy.where("schema_name <> '' and table_name <> '' and column_name <> '' and position is not null").dropDuplicates()
    return ordered_list_by_key(tidy, ["schema_name", "table_name"], "column_name", "position", alias="pks")


def load_specs(path: str, *, source: str = "{schema}/{table}", target: str = "{schema}_{table}", spark: SparkSession | None = None) -> list[SyncSpec]:
    """Specs from a CSV of key metadata; ``source`` and ``target`` are patterns of the schema's and table's names."""
    rows = key_lists(Input(path, "csv", spark=spark).dataframe()).orderBy("schema_name", "table_name").collect()
    out: list[SyncSpec] = []
    for r in rows:
        names = {"schema": r["schema_name"], "table": r["table_name"], "SCHEMA": r["schema_name"].upper(), "TABLE": r["table_name"].upper()}
        out.append({"src_key": f"{r['schema_name']}.{r['table_name']}", "src_path": source.format(**names), "dst_table": target.format(**names), "pks": list(r["pks"])})
    return out


