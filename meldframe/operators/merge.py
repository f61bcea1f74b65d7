"""MERGE as DataFrame algebra: one full outer join by key, each row classified and resolved by its class.

Keys compare with ``=``: a NULL key never matches. So a snapshot deletes the target's NULL-key rows and
inserts the source's, and upserts add them anew. Target columns that the source lacks keep their value
on update and are NULL on insert; source columns that the target lacks are an error.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from meldframe.functions.naming import free_name, quoted
from meldframe.operators.keyed import as_list
from meldframe.session import get_spark
from meldframe.sources.versions import CHANGE, VersionedTable, current_version

DEFAULT_CDF_METADATA = frozenset({"change_type", "commit_version", "commit_timestamp"})
ACTIONS = ("keep", "update", "delete", "insert", "skip")


class MergeConflict(ValueError):
    """Several source rows match one target row."""


def merge_condition(pks: Sequence[str], target_alias: str = "t", source_alias: str = "s") -> str:
    """``t.a = s.a AND ...``; names that need it are quoted."""
    plain = lambda c: c if c.isidentifier() else quoted(c)
    return " AND ".join(f"{target_alias}.{plain(k)} = {source_alias}.{plain(k)}" for k in as_list(pks))


def column_map(cols: Iterable[str], prefix: str = "s") -> dict[str, str]:
    return {c: f"{prefix}.{c if c.isidentifier() else quoted(c)}" for c in cols}


def classified(target: DataFrame, source: DataFrame, on: Sequence[str], matched: Column, unmatched_source: Column, unmatched_target: str, *, evolve_schema: bool = False, skip: Sequence[str] = ()) -> DataFrame:
    """A plan: the rows of both sides with their action in the first column, the resolved columns, and the target's row
    before, if there is one, in the last. The two are called ``_action`` and ``_before`` unless a column is.

    ``matched`` and ``unmatched_source`` are actions, as expressions over the source alias ``s``."""
    on = as_list(on)
    columns = [c for c in source.columns if c not in skip]
    if missing := [k for k in on if k not in target.columns or k not in source.columns]:
        raise ValueError(f"merge keys missing: {', '.join(missing)}")
    extra = [c for c in columns if c not in target.columns]
    if extra and not evolve_schema:
        raise ValueError(f"the target has no column {', '.join(extra)}")
    own = {n: free_name(n, target.columns, source.columns) for n in ("_in_target", "_in_source", "_action", "_before")}
    t = target.withColumn(own["_in_target"], F.lit(True)).alias("t")
    s = source.withColumn(own["_in_source"], F.lit(True)).alias("s")
    cond = F.lit(True)
    for k in on:
        cond = cond & (F.col(f"t.{quoted(k)}") == F.col(f"s.{quoted(k)}"))
    both = t.join(s, cond, "full_outer")
    in_t, in_s = F.col(f"t.{own['_in_target']}").isNotNull(), F.col(f"s.{own['_in_source']}").isNotNull()
    action = F.when(in_t & in_s, matched).when(in_s, unmatched_source).otherwise(F.lit(unmatched_target))
    both = both.withColumn(own["_action"], action)
    takes = F.col(own["_action"]).isin("update", "insert")
    out = []
    for c in [*target.columns, *extra]:
        old = F.col(f"t.{quoted(c)}") if c in target.columns else F.lit(None).cast(source.schema[c].dataType)
        new = F.col(f"s.{quoted(c)}").cast(target.schema[c].dataType) if c in target.columns and c in columns else F.col(f"s.{quoted(c)}") if c in columns else old
        out.append(F.when(takes, new).otherwise(old).alias(c))
    before = F.when(in_t, F.struct(*(F.col(f"t.{quoted(c)}").alias(c) for c in target.columns))).alias(own["_before"])
    return both.select(own["_action"], *out, before)


def action_of(plan: DataFrame) -> Column:
    return F.col(quoted(plan.columns[0]))


def check_unambiguous(target: DataFrame, source: DataFrame, on: Sequence[str]) -> None:
    """Raises ``MergeConflict`` if a key that several source rows have is in the target."""
    on = as_list(on)
    twice = source.groupBy(*(F.col(quoted(k)) for k in on)).agg(F.count("*").alias("_n")).where("_n > 1").drop("_n")
    if not twice.join(target.select(*(F.col(quoted(k)) for k in on)), on, "left_semi").isEmpty():
        raise MergeConflict("several source rows match one target row")


def snapshot_plan(target: DataFrame, source: DataFrame, on: Sequence[str], *, delete_unmatched: bool = True, evolve_schema: bool = False) -> DataFrame:
    return classified(target, source, on, F.lit("update"), F.lit("insert"), "delete" if delete_unmatched else "keep", evolve_schema=evolve_schema)


def upsert_plan(target: DataFrame, source: DataFrame, on: Sequence[str], *, update: bool = True, insert: bool = True, evolve_schema: bool = False) -> DataFrame:
    return classified(target, source, on, F.lit("update" if update else "keep"), F.lit("insert" if insert else "skip"), "keep", evolve_schema=evolve_schema)


def plain_metadata(cdf: DataFrame, metadata: Iterable[str] = DEFAULT_CDF_METADATA) -> DataFrame:
    """A change feed with its metadata columns under their names without a leading underscore."""
    names = [c[1:] if c.startswith("_") and c[1:] in metadata else c for c in cdf.columns]
    return cdf.toDF(*names)


def collapse_changes(cdf: DataFrame, on: Sequence[str], *, metadata_cols: Iterable[str] = DEFAULT_CDF_METADATA) -> DataFrame:
    """The last change of each key: by version and time, and within those anything but a delete wins. Pre-images and
    rows without a kind are no changes; NULL keys are one key here."""
    cdf = plain_metadata(cdf, metadata_cols)
    changes = cdf.where((F.col("change_type") != "update_preimage") & F.col("change_type").isNotNull())
    rank = free_name("_rank", changes.columns)
    order = Window.partitionBy(*(F.col(quoted(k)) for k in as_list(on))).orderBy(F.col("commit_version").desc(), F.col("commit_timestamp").desc(), (F.col("change_type") == "delete").asc())
    return changes.withColumn(rank, F.row_number().over(order)).where(F.col(rank) == 1).drop(rank)


def change_plan(target: DataFrame, changes: DataFrame, on: Sequence[str], *, metadata_cols: Iterable[str] = DEFAULT_CDF_METADATA) -> DataFrame:
    """The plan that applies collapsed changes: deletes, updates and inserts; deletes of absent keys do nothing."""
    gone = F.col("s.change_type") == "delete"
    return classified(target, changes, on, F.when(gone, "delete").otherwise("update"), F.when(gone, "skip").otherwise("insert"), "keep", skip=list(metadata_cols))


def result_of(plan: DataFrame) -> DataFrame:
    return plan.where(~action_of(plan).isin("delete", "skip")).select(*(F.col(quoted(c)) for c in plan.columns[1:-1]))


def _metrics(counts: dict[str, int]) -> dict[str, int]:
    return {
        "numTargetRowsInserted": counts.get("insert", 0),
        "numTargetRowsUpdated": counts.get("update", 0),
        "numTargetRowsDeleted": counts.get("delete", 0),
        "numOutputRows": sum(counts.get(a, 0) for a in ("keep", "update", "insert")),
    }


def metrics_of(plan: DataFrame) -> dict[str, int]:
    return _metrics({r["action"]: r["count"] for r in plan.groupBy(action_of(plan).alias("action")).count().collect()})


def observed(plan: DataFrame) -> tuple[DataFrame, Observation]:
    """The plan with its metrics counted while it runs."""
    seen = Observation()
    return plan.observe(seen, *(F.count_if(action_of(plan) == a).alias(a) for a in ACTIONS)), seen


def changes_of(plan: DataFrame) -> DataFrame:
    """The plan as a change feed: inserts, deletes, and updates with the row before and after. One pass."""
    columns, last = plan.columns[1:-1], quoted(plan.columns[-1])
    before = plan.schema[plan.columns[-1]].dataType.fieldNames()
    old = F.struct(*(F.col(f"{last}.{quoted(c)}").alias(c) if c in before else F.lit(None).cast(plan.schema[c].dataType).alias(c) for c in columns))
    new = F.struct(*(F.col(quoted(c)) for c in columns))
    row = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    action = action_of(plan)
    rows = F.when(action == "insert", F.array(row("insert", new))).when(action == "delete", F.array(row("delete", old)))
    rows = rows.when(action == "update", F.array(row("update_preimage", old), row("update_postimage", new)))
    each = plan.where(action.isin("insert", "delete", "update")).select(F.explode(rows).alias("row"))
    return each.select("row.value.*", F.col("row.kind").alias(CHANGE))


class CatalogTarget:
    """A catalog table. A merge writes its result beside the table, evaluated once and counted on the way, and then
    overwrites the table's rows: name, location, comment and properties stay. Where the second step fails, the
    result is still there, and the error names it. Readers need a pause while rows are replaced."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name = spark, name

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def apply(self, plan: DataFrame, operation: str) -> dict[str, int]:
        details = json.loads(self.spark.sql(f"DESCRIBE TABLE EXTENDED {self.name} AS JSON").first()[0])
        beside = f"{details['location'].rstrip('/')}__{operation}-{uuid.uuid4().hex}"
        counted, seen = observed(plan)
        result_of(counted).write.parquet(beside)
        ready = self.spark.read.schema(result_of(plan).schema).parquet(beside)
        try:
            ready.select(*(F.col(quoted(c)) for c in self.read().columns)).write.option("partitionOverwriteMode", "static").insertInto(self.name, overwrite=True)
        except Exception as error:
            error.add_note(f"the merged rows of {self.name} are in {beside}")
            raise
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(beside)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        return _metrics(seen.get)


class VersionedTarget:
    """A versioned folder: a merge is one commit, with its changes and metrics. The plan is written once, and all
    three are made from what was written."""

    def __init__(self, spark: SparkSession, path: str):
        self.table = VersionedTable(spark, path)
        self.base = self.table.version()

    def read(self) -> DataFrame:
        return self.table.read(self.base)

    def apply(self, plan: DataFrame, operation: str) -> dict[str, int]:
        spark, beside = plan.sparkSession, f"{self.table.path}/m={uuid.uuid4().hex}"
        counted, seen = observed(plan)
        counted.write.parquet(beside)
        ready, metrics = spark.read.schema(plan.schema).parquet(beside), _metrics(seen.get)
        try:
            self.table.commit(result_of(ready), changes_of(ready), operation, metrics, base=self.base)
        finally:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(beside)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        return metrics


class DeltaTarget:
    """A Delta table, where its engine is installed. A merge replaces the table's rows by the merged ones in one Delta
    commit: it rewrites the table, as Delta's own MERGE would not."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def read(self) -> DataFrame:
        return self.spark.read.format("delta").load(self.path)

    def apply(self, plan: DataFrame, operation: str) -> dict[str, int]:
        counted, seen = observed(plan)
        result_of(counted).write.format("delta").mode("overwrite").save(self.path)
        return _metrics(seen.get)


def target_of(spark: SparkSession, name: str):
    """The target that a table name or a path stands for; it must exist."""
    spark = get_spark(spark)
    if "/" not in name:
        if not spark.catalog.tableExists(name):
            raise ValueError(f"no table {name}")
        return CatalogTarget(spark, name)
    if VersionedTable(spark, name).exists() and current_version(spark, f"{name}") is not None:
        from meldframe.sources.io import peek_format

        return DeltaTarget(spark, name) if peek_format(name, spark) == "delta" else VersionedTarget(spark, name)
    raise ValueError(f"no versioned table at {name}")


def _target(target, df: DataFrame):
    return target_of(df.sparkSession, target) if isinstance(target, str) else target


def upsert(target, df: DataFrame, on: Sequence[str], *, update: bool = True, insert: bool = True) -> dict[str, int]:
    target = _target(target, df)
    now = target.read()
    if missing := [c for c in now.columns if c not in df.columns]:
        raise ValueError(f"an upsert writes all columns; the source lacks {', '.join(missing)}")
    check_unambiguous(now, df, on)
    return target.apply(upsert_plan(now, df, on, update=update, insert=insert), "upsert")


def snapshot_merge(target_table, df: DataFrame, on: Sequence[str], *, delete_unmatched: bool = True) -> dict[str, int]:
    """Makes the target equal to the snapshot: updates, inserts and, by default, deletes what the snapshot lacks."""
    target = _target(target_table, df)
    now = target.read()
    check_unambiguous(now, df, on)
    return target.apply(snapshot_plan(now, df, on, delete_unmatched=delete_unmatched), "snapshot_merge")


def cdf_merge(target_table, cdf: DataFrame, on: Sequence[str], *, metadata_cols: Iterable[str] = DEFAULT_CDF_METADATA) -> bool:
    """Applies the last change of each key to the target; False, and nothing written, if there is no change."""
    changes = collapse_changes(cdf, on, metadata_cols=metadata_cols)
    if changes.isEmpty():
        return False
    target = _target(target_table, cdf)
    target.apply(change_plan(target.read(), changes, on, metadata_cols=metadata_cols), "cdf_merge")
    return True


def read_cdf(src_path: str, start_version: int, end_version: int | None = None, *, spark: SparkSession | None = None) -> DataFrame:
    """The change feed of a versioned or Delta table from ``start_version`` on, up to ``end_version`` if given."""
    spark = get_spark(spark)
    from meldframe.sources.io import peek_format

    if peek_format(src_path, spark) == "delta":
        reader = spark.read.format("delta").option("readChangeFeed", "true").option("startingVersion", start_version)
        return (reader if end_version is None else reader.option("endingVersion", end_version)).load(src_path)
    return VersionedTable(spark, src_path).changes(start_version, end_version)


def current_delta_version(path: str, *, spark: SparkSession | None = None) -> int | None:
    return current_version(get_spark(spark), path)


