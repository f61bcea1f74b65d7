"""Catalog operators: the data dictionary, dropping tables, keyword search."""

from __future__ import annotations

import json
import logging
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meldframe.functions.naming import qualified, quoted
from meldframe.operators.keyed import as_list
from meldframe.plans.parallel import run_parallel
from meldframe.session import get_spark

log = logging.getLogger(__name__)

DICTIONARY = T.StructType(
    [
        T.StructField("db", T.StringType()),
        T.StructField("table", T.StringType()),
        T.StructField("table_location", T.StringType()),
        T.StructField("table_format", T.StringType()),
        T.StructField("column_name", T.StringType()),
        T.StructField("ordinal", T.IntegerType()),
        T.StructField("data_type", T.StringType()),
        T.StructField("nullable", T.BooleanType()),
        T.StructField("is_partition", T.BooleanType()),
        T.StructField("comment", T.StringType()),
    ]
)

SEARCH = T.StructType(
    [
        T.StructField("table_name", T.StringType(), False),
        T.StructField("column_name", T.StringType(), False),
        T.StructField("match_count", T.LongType(), False),
        T.StructField("sample_values", T.ArrayType(T.StringType()), False),
    ]
)


def _properties(spark: SparkSession, name: str) -> tuple[str | None, str | None]:
    found = json.loads(spark.sql(f"DESCRIBE TABLE EXTENDED {name} AS JSON").first()[0])
    return found.get("location"), found.get("provider")


def scan_databases(dbs: str | Sequence[str], *, max_workers: int = 8, pool: str | None = None, spark: SparkSession | None = None) -> DataFrame:
    """A row for each column of each table of ``dbs``; names that begin with ``__``, temporary tables and views are
    left out, and so are tables that can't be described."""
    spark = get_spark(spark)
    jobs = [{"db": db, "table": t.name} for db in as_list(dbs) for t in spark.catalog.listTables(db) if not (t.isTemporary or t.tableType == "VIEW" or t.name.startswith("__"))]

    def scan(db: str, table: str) -> list[tuple]:
        name = qualified(db, table)
        location, provider = _properties(spark, name)
        columns = spark.catalog.listColumns(name)
        return [(db, table, location, provider, c.name, i, c.dataType, c.nullable, c.isPartition, c.description) for i, c in enumerate(columns)]

    results = run_parallel(scan, jobs, max_workers, pool, spark=spark)
    return spark.createDataFrame([row for r in results if not isinstance(r, Exception) for row in r], DICTIONARY)


def write_dictionary(dbs: str | Sequence[str], target_table: str | None = None, *, max_workers: int = 8, pool: str | None = None, format: str = "parquet", spark: SparkSession | None = None) -> str:
    """Overwrites ``target_table`` (``<first db>.__data_dictionary``) with ``scan_databases`` and returns its name."""
    name = target_table or f"{as_list(dbs)[0]}.__data_dictionary"
    scan_databases(dbs, max_workers=max_workers, pool=pool, spark=spark).write.format(format).mode("overwrite").option("overwriteSchema", "true").saveAsTable(name)
    return name


def drop_database_tables(
    database: str,
    *,
    tables: Iterable[str] | None = None,
    include_views: bool = False,
    max_workers: int = 8,
    pool: str | None = None,
    dry_run: bool = False,
    spark: SparkSession | None = None,
) -> list[str]:
    """Drops the database's tables, only those named in ``tables`` if given; the qualified names, dropped or, in a dry
    run, to be dropped. Temporary tables always stay, views unless asked for. A failed drop is raised."""
    spark = get_spark(spark)
    wanted = None if tables is None else set(as_list(tables))
    chosen = [t for t in spark.catalog.listTables(database) if not t.isTemporary and (wanted is None or t.name in wanted) and (include_views or t.tableType != "VIEW")]
    names = [f"{database}.{t.name}" for t in chosen]
    if not dry_run:
        jobs = [{"name": qualified(database, t.name), "kind": "VIEW" if t.tableType == "VIEW" else "TABLE"} for t in chosen]
        for result in run_parallel(lambda name, kind: spark.sql(f"DROP {kind} IF EXISTS {name}"), jobs, max_workers, pool, spark=spark):
            if isinstance(result, Exception):
                raise result
    return names


def keyword_hits(df: DataFrame, table_name: str, keyword: str, *, columns: Iterable[str] | None = None, case_sensitive: bool = False, sample_rows: int = 1) -> DataFrame:
    """A row of ``SEARCH`` for each string column with hits. One pass over the table counts all columns.

    The samples are the smallest ``sample_rows`` different values with the keyword, so they are the same in
    every run. One sample is a minimum, which tasks take before anything is shuffled; for more of them the
    different values with hits are shuffled by value.
    """
    if not keyword:
        raise ValueError("keyword must not be empty")
    if sample_rows < 0:
        raise ValueError("sample_rows must not be negative")
    wanted = None if columns is None else set(as_list(columns))
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and (wanted is None or f.name in wanted)]
    spark = df.sparkSession
    if not texts:
        return spark.createDataFrame([], SEARCH)
    needle = F.lit(keyword if case_sensitive else keyword.lower())
    value = lambda c: F.col(quoted(c))
    hit = lambda c: F.coalesce((value(c) if case_sensitive else F.lower(value(c))).contains(needle), F.lit(False))
    if sample_rows <= 1:
        found = df.agg(F.array(*(F.struct(F.lit(c).alias("column_name"), F.count_if(hit(c)).alias("match_count"), F.min(F.when(hit(c), value(c))).alias("least")) for c in texts)).alias("x"))
        each = found.select(F.explode("x").alias("x")).select("x.*").where("match_count > 0")
        samples = F.array("least") if sample_rows else F.array().cast("array<string>")
        return each.select(F.lit(table_name).alias("table_name"), "column_name", "match_count", samples.alias("sample_values"))
    cells = F.array(*(F.when(hit(c), F.struct(F.lit(c).alias("column_name"), value(c).alias("value"))) for c in texts))
    hits = df.select(F.explode(F.filter(cells, lambda x: x.isNotNull())).alias("x")).select("x.*")
    counted = hits.groupBy("column_name", "value").count()
    counts = counted.groupBy("column_name").agg(F.sum("count").alias("match_count"))
    ranked = counted.withColumn("rank", F.row_number().over(Window.partitionBy("column_name").orderBy("value"))).where(F.col("rank") <= sample_rows)
    samples = ranked.groupBy("column_name").agg(F.array_sort(F.collect_list("value")).alias("sample_values"))
    none = F.array().cast("array<string>")
    return counts.join(samples, "column_name", "left").select(F.lit(table_name).alias("table_name"), "column_name", "match_count", F.coalesce("sample_values", none).alias("sample_values"))


def search_database(
    database: str,
    keyword: str,
    *,
    tables: Iterable[str] | None = None,
    columns: Iterable[str] | None = None,
    case_sensitive: bool = False,
    sample_rows: int = 1,
    limit_tables: int | None = None,
    spark: SparkSession | None = None,
) -> DataFrame:
    """Where a keyword occurs: one plan that reads each table once. Names in ``tables`` with a dot are taken as they are;
    temporary views are left out unless named."""
    spark = get_spark(spark)
    if not keyword:
        raise ValueError("keyword must not be empty")
    if sample_rows < 0 or (limit_tables is not None and limit_tables < 0):
        raise ValueError("limits must not be negative")
    names = [t.name for t in spark.catalog.listTables(database) if not t.isTemporary] if tables is None else as_list(tables)
    if limit_tables is not None:
        names = names[:limit_tables]
    result = spark.createDataFrame([], SEARCH)
    for n in names:
        name = n if "." in n else f"{database}.{n}"
        df = spark.table(name if "." in n else qualified(database, n))
        result = result.unionByName(keyword_hits(df, name, keyword, columns=columns, case_sensitive=case_sensitive, sample_rows=sample_rows))
    return result
