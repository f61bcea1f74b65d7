"""The library's registered queries and their reference SQL.

Sources of merges and change feeds are derived from the tables by rule, so that SQL can derive them too.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meldframe.functions.text import ACCENTED, PLAIN, normalize_text
from meldframe.operators import merge
from meldframe.operators.catalog import SEARCH, drop_database_tables, keyword_hits, scan_databases, search_database
from meldframe.operators.columns import clean_columns
from meldframe.operators.keyed import latest_by_key, ordered_list_by_key
from meldframe.operators.matching import fill_missing_from_match, fuzzy_match, infer_key_from_text, ml_fuzzy_match, ngram_match
from meldframe.plans.sync import SyncAudit, SyncState, decide, load_specs, run_sync
from meldframe.sources.io import Input, Output

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@lru_cache(maxsize=1)
def _local_folder() -> str:
    """A temporary folder that goes with the process."""
    folder = tempfile.mkdtemp(prefix="meldframe-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return f"file://{folder}"


def _scratch(spark: SparkSession) -> str:
    """A new folder under the shared checkpoint folder; a temporary one only for a local session without it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a shared folder")
        base = _local_folder()
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/meldframe-{uuid.uuid4().hex}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return path.toString()


@query("SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC NULLS LAST, event_id DESC NULLS LAST) = 1")
def latest_event_per_user(spark, sf_dir):
    return latest_by_key(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"])


@query("SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts ASC NULLS FIRST, event_id ASC NULLS FIRST) = 1")
def earliest_event_per_user(spark, sf_dir):
    return latest_by_key(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], descending=False)


@query("SELECT o_orderkey AS order_key, o_custkey AS order_key_1, o_orderstatus AS status, o_totalprice AS _2024_total, o_orderpriority AS _ FROM orders")
def renamed_columns(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return clean_columns(orders.select(F.col("o_orderkey").alias("Order Key"), F.col("o_custkey").alias("Örder-Key"), F.col("o_orderstatus").alias(" STATUS "), F.col("o_totalprice").alias("2024 Total"), F.col("o_orderpriority").alias("%%")))


_NORM = f"trim(regexp_replace(translate(lower(coalesce({{0}}, '')), '{ACCENTED}', '{PLAIN}'), '[^a-z0-9]+', ' ', 'g'))"


@query(f"SELECT doc_id, {_NORM.format('text')} AS norm FROM documents")
def normalized_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", normalize_text("text").alias("norm"))


def _names(spark, sf_dir, *more):
    part = table(spark, sf_dir, "part")
    return part.select(F.col("p_name").alias("name"), *more).distinct()


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("match_score", F.round("match_score", 6)).withColumn("match_distance", F.round(F.col("match_distance").cast("double"), 6))


_PAIRS = f"""
    n AS (SELECT DISTINCT p_name AS name, {_NORM.format('p_name')} AS norm FROM part),
    pairs AS (
        SELECT a.name AS left_id, b.name AS right_id, a.name AS left_value, b.name AS right_value, a.norm AS left_norm, b.norm AS right_norm,
            levenshtein(a.norm, b.norm) AS d, 1.0 - levenshtein(a.norm, b.norm) / greatest(length(a.norm), length(b.norm))::DOUBLE AS s
        FROM n a JOIN n b ON substring(a.norm, 1, 2) = substring(b.norm, 1, 2)
        WHERE length(a.norm) >= 2 AND length(b.norm) >= 2
    ),
    ranked AS (
        SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY s DESC, d, right_id)::INTEGER AS match_rank
        FROM pairs WHERE s >= 0.6 {{0}}
    )"""
_MATCH = "left_id, right_id, left_value, right_value, left_norm, right_norm, d::DOUBLE AS match_distance, round(s, 6) AS match_score, match_rank"


@query(f"WITH {_PAIRS.format('')} SELECT {_MATCH} FROM ranked")
def fuzzy_all(spark, sf_dir):
    names = _names(spark, sf_dir)
    return _rounded(fuzzy_match(names, names, left_on="name", right_on="name", left_id="name", right_id="name", threshold=0.6, keep_all_candidates=True))


@query(f"""
    WITH n AS (SELECT DISTINCT p_name AS name FROM part),
    p AS (
        SELECT a.name AS left_id, b.name AS right_id, levenshtein({_NORM.format('a.name')}, {_NORM.format('b.name[:-2]')}) AS d,
            1.0 - levenshtein({_NORM.format('a.name')}, {_NORM.format('b.name[:-2]')}) / greatest(length({_NORM.format('a.name')}), length({_NORM.format('b.name[:-2]')}))::DOUBLE AS s
        FROM n a JOIN n b ON substring({_NORM.format('a.name')}, 1, 2) = substring({_NORM.format('b.name[:-2]')}, 1, 2)
    )
    SELECT left_id, right_id, d AS distance, round(s, 6) AS score FROM p WHERE s >= 0.6 AND d <= 6
    QUALIFY row_number() OVER (PARTITION BY left_id ORDER BY s DESC, d, right_id) = 1
""")
def fuzzy_best(spark, sf_dir):
    """Each name against all names without their last letter."""
    names = _names(spark, sf_dir)
    short = names.withColumn("cut", F.expr("substring(name, 1, length(name) - 1)"))
    found = fuzzy_match(names, short, left_on="name", right_on="cut", left_id="name", right_id="name", threshold=0.6, max_distance=6)
    return found.select("left_id", "right_id", F.col("match_distance").cast("long").alias("distance"), F.round("match_score", 6).alias("score"))


@query(f"""
    WITH n AS (SELECT DISTINCT p_name AS name, p_brand AS brand, {_NORM.format('p_name')} AS norm FROM part),
    p AS (
        SELECT a.name || '/' || a.brand AS left_id, b.name || '/' || b.brand AS right_id, levenshtein(a.norm, b.norm) AS d,
            1.0 - levenshtein(a.norm, b.norm) / greatest(length(a.norm), length(b.norm))::DOUBLE AS s
        FROM n a JOIN n b ON a.brand = b.brand
    )
    SELECT left_id, right_id, d AS distance, round(s, 6) AS score,
        row_number() OVER (PARTITION BY left_id ORDER BY s DESC, d, right_id)::INTEGER AS match_rank FROM p WHERE s >= 0.7
""")
def fuzzy_blocked(spark, sf_dir):
    names = _names(spark, sf_dir, F.col("p_brand").alias("brand")).withColumn("id", F.concat_ws("/", "name", "brand"))
    found = fuzzy_match(names, names, left_on="name", right_on="name", left_id="id", right_id="id", block_on="brand", threshold=0.7, keep_all_candidates=True)
    return found.select("left_id", "right_id", F.col("match_distance").cast("long").alias("distance"), F.round("match_score", 6).alias("score"), "match_rank")


_REFERENCE = "ref AS (SELECT p_name AS name, min(p_partkey) AS key, min(p_type) AS kind FROM part GROUP BY p_name)"
_BEST = f"""
    best AS (
        SELECT l.p_partkey AS id, r.key AS rkey, r.name AS rname, r.kind AS rkind, levenshtein({_NORM.format('l.p_name')}, {_NORM.format('r.name')}) AS d,
            1.0 - levenshtein({_NORM.format('l.p_name')}, {_NORM.format('r.name')}) / greatest(length({_NORM.format('l.p_name')}), length({_NORM.format('r.name')}))::DOUBLE AS s
        FROM part l JOIN ref r ON substring({_NORM.format('l.p_name')}, 1, 2) = substring({_NORM.format('r.name')}, 1, 2)
        WHERE s >= 0.8 QUALIFY row_number() OVER (PARTITION BY l.p_partkey ORDER BY s DESC, d, r.key) = 1
    )"""


def _reference(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("key"), F.min("p_type").alias("kind"))


@query(f"""
    WITH {_REFERENCE}, {_BEST}
    SELECT p_partkey, p_name, CASE WHEN p_partkey % 5 = 0 THEN rkind ELSE p_type END AS kind, rkey AS _match_right_id, rname AS _match_right_text, round(s, 6) AS _match_score, d AS _match_distance
    FROM part LEFT JOIN best ON id = p_partkey
""")
def fill_from_match(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", F.when(F.col("p_partkey") % 5 != 0, F.col("p_type")).alias("kind"))
    filled = fill_missing_from_match(part, _reference(spark, sf_dir), left_on="p_name", right_on="name", fill_cols="kind", left_id="p_partkey", right_id="key")
    return filled.withColumn("_match_score", F.round("_match_score", 6)).withColumn("_match_distance", F.col("_match_distance").cast("long"))


def _keyless(spark, sf_dir, edit: bool):
    name = F.concat("p_name", F.when(F.col("p_partkey") % 2 == 0, "x").otherwise("")) if edit else F.upper("p_name")
    return table(spark, sf_dir, "part").select("p_partkey", name.alias("label"), F.when(F.col("p_partkey") % 3 != 0, F.col("p_partkey")).alias("key"))


@query(f"""
    WITH {_REFERENCE}
    SELECT p_partkey, upper(p_name) AS label, CASE WHEN p_partkey % 3 <> 0 THEN p_partkey ELSE ref.key END AS key,
        CASE WHEN p_partkey % 3 = 0 THEN ref.key END AS _match_inferred_key, CASE WHEN p_partkey % 3 = 0 THEN ref.name END AS _match_right_text,
        CASE WHEN p_partkey % 3 = 0 THEN 1.0::DOUBLE END AS _match_score, CASE WHEN p_partkey % 3 = 0 THEN 0.0::DOUBLE END AS _match_distance
    FROM part LEFT JOIN ref ON ref.name = p_name
""")
def infer_key_exact(spark, sf_dir):
    return infer_key_from_text(_keyless(spark, sf_dir, False), _reference(spark, sf_dir), key_col="key", text_col="label", reference_text_col="name", left_id="p_partkey", method="levenshtein")


@query(f"""
    WITH {_REFERENCE},
    l AS (SELECT p_partkey, p_name || CASE WHEN p_partkey % 2 = 0 THEN 'x' ELSE '' END AS label, p_partkey % 3 = 0 AS missing FROM part),
    c AS (
        SELECT l.p_partkey AS id, r.key AS rkey, r.name AS rname, levenshtein(l.label, r.name) AS d, 1.0 - levenshtein(l.label, r.name) / greatest(length(l.label), length(r.name))::DOUBLE AS s
        FROM l JOIN ref r ON substring(l.label, 1, 2) = substring(r.name, 1, 2) WHERE missing AND s >= 0.8
        QUALIFY row_number() OVER (PARTITION BY l.p_partkey ORDER BY s DESC, d, r.key) = 1
    )
    SELECT p_partkey, label, CASE WHEN missing THEN rkey ELSE p_partkey END AS key, rkey AS _match_inferred_key, rname AS _match_right_text, round(s, 6) AS _match_score, d::DOUBLE AS _match_distance
    FROM l LEFT JOIN c ON id = p_partkey
""")
def infer_key_edit(spark, sf_dir):
    found = infer_key_from_text(_keyless(spark, sf_dir, True), _reference(spark, sf_dir), key_col="key", text_col="label", reference_text_col="name", left_id="p_partkey", method="edit_distance")
    return found.withColumn("_match_score", F.round("_match_score", 6))


@query(f"""
    WITH n AS (SELECT DISTINCT p_name AS name, replace({_NORM.format('p_name')}, ' ', '') AS t FROM part),
    g AS (SELECT name, list_distinct([substring(t, i, 3) FOR i IN range(1, length(t) - 1)]) AS g FROM n),
    p AS (SELECT a.name AS left_id, b.name AS right_id, len(list_intersect(a.g, b.g)) AS i, len(a.g) + len(b.g) - len(list_intersect(a.g, b.g)) AS u FROM g a, g b)
    SELECT left_id, right_id, round(i / u::DOUBLE, 6) AS score FROM p WHERE i / u::DOUBLE >= 0.4 AND left_id <> right_id
""")
def jaccard_pairs(spark, sf_dir):
    names = _names(spark, sf_dir)
    found = ngram_match(names, names, left_on="name", right_on="name", left_id="name", right_id="name", threshold=0.4, keep_all_candidates=True)
    return found.where("left_id <> right_id").select("left_id", "right_id", F.round("match_score", 6).alias("score"))


@query(f"""
    WITH n AS (SELECT DISTINCT p_name AS name, {_NORM.format('p_name')} AS norm FROM part),
    g AS (SELECT name, norm, list_distinct([substring(replace(norm, ' ', ''), i, 3) FOR i IN range(1, length(replace(norm, ' ', '')) - 1)]) AS g FROM n),
    p AS (
        SELECT a.name AS left_id, b.name AS right_id, a.norm AS left_norm, b.norm AS right_norm,
            len(list_intersect(a.g, b.g)) / (len(a.g) + len(b.g) - len(list_intersect(a.g, b.g)))::DOUBLE AS s
        FROM g a, g b
    )
    SELECT left_id, right_id, left_id AS left_value, right_id AS right_value, left_norm, right_norm, round(1 - s, 6) AS match_distance, round(s, 6) AS match_score,
        row_number() OVER (PARTITION BY left_id ORDER BY s DESC, right_id)::INTEGER AS match_rank
    FROM p WHERE s >= 0.4
""")
def lsh_pairs(spark, sf_dir):
    """MinHash finds all pairs of this table, so SQL can tell them exactly."""
    names = _names(spark, sf_dir)
    return _rounded(ml_fuzzy_match(names, names, left_on="name", right_on="name", left_id="name", right_id="name", threshold=0.4, num_hash_tables=12, keep_all_candidates=True))


def _target(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")


def _source(spark, sf_dir):
    """Every order, of which a third under a key that is new to the target."""
    key = F.when(F.col("o_orderkey") % 3 == 0, -F.col("o_orderkey")).otherwise(F.col("o_orderkey"))
    return table(spark, sf_dir, "orders").select(key.alias("o_orderkey"), "o_custkey", (F.col("o_totalprice") * 2).alias("o_totalprice"))


_SOURCE_KEY = "CASE WHEN o_orderkey % 3 = 0 THEN -o_orderkey ELSE o_orderkey END AS o_orderkey"
_SIDES = f"""
    t AS (SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus FROM orders),
    s AS (SELECT {_SOURCE_KEY}, o_custkey, o_totalprice * 2 AS o_totalprice FROM orders)"""


@query(f"WITH {_SIDES} SELECT s.o_orderkey, s.o_custkey, s.o_totalprice, t.o_orderstatus FROM s LEFT JOIN t USING (o_orderkey)")
def snapshot_merge(spark, sf_dir):
    return merge.result_of(merge.snapshot_plan(_target(spark, sf_dir), _source(spark, sf_dir), ["o_orderkey"]))


@query(f"WITH {_SIDES} SELECT coalesce(s.o_orderkey, t.o_orderkey) AS o_orderkey, coalesce(s.o_custkey, t.o_custkey) AS o_custkey, coalesce(s.o_totalprice, t.o_totalprice) AS o_totalprice, t.o_orderstatus FROM t FULL JOIN s ON s.o_orderkey = t.o_orderkey")
def upsert(spark, sf_dir):
    return merge.result_of(merge.upsert_plan(_target(spark, sf_dir), _source(spark, sf_dir), ["o_orderkey"]))


@query(f"WITH {_SIDES} SELECT * FROM t UNION ALL SELECT o_orderkey, o_custkey, o_totalprice, NULL FROM s WHERE o_orderkey NOT IN (SELECT o_orderkey FROM t)")
def insert_only(spark, sf_dir):
    return merge.result_of(merge.upsert_plan(_target(spark, sf_dir), _source(spark, sf_dir), ["o_orderkey"], update=False))


@query(f"""
    WITH {_SIDES}, k AS (SELECT t.o_orderkey IS NOT NULL AS in_t, s.o_orderkey IS NOT NULL AS in_s FROM t FULL JOIN s ON s.o_orderkey = t.o_orderkey)
    SELECT count(*) FILTER (in_t AND in_s) AS updated, count(*) FILTER (in_s AND NOT in_t) AS inserted, count(*) FILTER (in_t AND NOT in_s) AS deleted FROM k
""")
def merge_metrics(spark, sf_dir):
    plan = merge.snapshot_plan(_target(spark, sf_dir), _source(spark, sf_dir), ["o_orderkey"])
    return plan.agg(*(F.count_if(merge.action_of(plan) == a).alias(n) for a, n in (("update", "updated"), ("insert", "inserted"), ("delete", "deleted"))))


def _feed(spark, sf_dir):
    kind = F.when(F.col("event_id") % 7 == 0, "delete").when(F.col("event_id") % 7 == 1, "update_preimage").otherwise("update_postimage")
    return table(spark, sf_dir, "events").select("user_id", "value", kind.alias("_change_type"), F.floor(F.col("event_id") / 10).alias("_commit_version"), F.col("ts").alias("_commit_timestamp"))


_FEED = """
    f AS (
        SELECT user_id, value, CASE event_id % 7 WHEN 0 THEN 'delete' WHEN 1 THEN 'update_preimage' ELSE 'update_postimage' END AS change_type,
            floor(event_id / 10)::BIGINT AS commit_version, ts AS commit_timestamp FROM events
    ),
    c AS (
        SELECT * FROM f WHERE change_type <> 'update_preimage'
        QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY commit_version DESC, commit_timestamp DESC, change_type = 'delete') = 1
    )"""


@query(f"WITH {_FEED} SELECT * FROM c")
def cdf_collapse(spark, sf_dir):
    return merge.collapse_changes(_feed(spark, sf_dir), ["user_id"])


@query(f"""
    WITH {_FEED}, t AS (SELECT c_custkey AS user_id, c_acctbal AS value FROM customer)
    SELECT coalesce(c.user_id, t.user_id) AS user_id, CASE WHEN c.user_id IS NULL THEN t.value ELSE c.value END AS value
    FROM t FULL JOIN c ON c.user_id = t.user_id WHERE c.change_type IS DISTINCT FROM 'delete'
""")
def cdf_apply(spark, sf_dir):
    target = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_acctbal").alias("value"))
    return merge.result_of(merge.change_plan(target, merge.collapse_changes(_feed(spark, sf_dir), ["user_id"]), ["user_id"]))


@query("SELECT l_orderkey, array_to_string(list(l_suppkey ORDER BY l_linenumber, l_suppkey), ',') AS suppliers FROM lineitem GROUP BY l_orderkey")
def ordered_keys(spark, sf_dir):
    listed = ordered_list_by_key(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_suppkey", "l_linenumber", alias="suppliers")
    return listed.withColumn("suppliers", F.array_join(F.col("suppliers").cast("array<string>"), ","))


@query("""
    SELECT last, dst, current, CASE WHEN NOT dst THEN 'initial_snapshot' WHEN last IS NULL OR last = -1 OR current IS NULL OR current < last THEN 'snapshot_merge'
        WHEN last = current THEN 'already_current' ELSE 'cdf_merge' END AS mode, coalesce(current, -1) AS recorded
    FROM (VALUES (NULL), (-1), (0), (3), (5)) AS l(last), (VALUES (true), (false)) AS d(dst), (VALUES (NULL), (0), (3), (7)) AS c(current)
""")
def sync_decisions(spark, sf_dir):
    grid = [(last, dst, current) for last in (None, -1, 0, 3, 5) for dst in (True, False) for current in (None, 0, 3, 7)]
    return spark.createDataFrame([(*g, *decide(*g)) for g in grid], "last int, dst boolean, current int, mode string, recorded int")


#: Every string column of every table.
_TEXTS = {"part": ("p_name", "p_brand", "p_type"), "customer": ("c_name", "c_mktsegment"), "orders": ("o_orderstatus", "o_orderpriority"), "nation": ("n_name",), "region": ("r_name",), "supplier": ("s_name",), "lineitem": ("l_returnflag", "l_linestatus"), "events": ("event_type", "props"), "documents": ("text", "lang", "source"), "benchmark": ("text",), "pages": ("url", "html"), "conversations": ("role", "text")}


@query(
    "SELECT * FROM ("
    + " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) AS match_count, min({c}) AS sample FROM {t} WHERE contains(lower({c}), 'er')" for t, columns in _TEXTS.items() for c in columns
    )
    + ") WHERE match_count > 0"
)
def keyword_search(spark, sf_dir):
    found = spark.createDataFrame([], SEARCH)
    for name in _TEXTS:
        found = found.unionByName(keyword_hits(table(spark, sf_dir, name), name, "ER"))
    return found.select("table_name", "column_name", "match_count", F.element_at("sample_values", 1).alias("sample"))


def _round_trip(spark, df, path, fmt=None, **options):
    Output(path, fmt, **options).write(df)
    return Input(path, fmt, spark=spark).dataframe()


@query("SELECT n_nationkey::VARCHAR AS n_nationkey, n_name, n_regionkey::VARCHAR AS n_regionkey FROM nation")
def csv_round_trip(spark, sf_dir):
    return _round_trip(spark, table(spark, sf_dir, "nation"), f"{_scratch(spark)}/nation.csv")


@query("SELECT n_nationkey::VARCHAR AS n_nationkey, n_name, n_regionkey::VARCHAR AS n_regionkey FROM nation")
def tsv_round_trip(spark, sf_dir):
    return _round_trip(spark, table(spark, sf_dir, "nation"), f"{_scratch(spark)}/nation.tsv")


@query("SELECT n_nationkey::BIGINT AS n_nationkey, n_name, n_regionkey::BIGINT AS n_regionkey FROM nation")
def json_round_trip(spark, sf_dir):
    return _round_trip(spark, table(spark, sf_dir, "nation"), f"{_scratch(spark)}/nation.jsonl")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def orc_round_trip(spark, sf_dir):
    return _round_trip(spark, table(spark, sf_dir, "nation"), f"{_scratch(spark)}/nation.orc")


@query("SELECT event_id, user_id, value, event_type FROM events")
def partitioned_round_trip(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "value", "event_type").repartition("event_type")
    return _round_trip(spark, events, f"{_scratch(spark)}/events.parquet", partition_by="event_type")


def _versioned(spark, sf_dir):
    """A versioned table of all orders, into which ``_source`` was merged."""
    path = f"{_scratch(spark)}/orders"
    Output(path, "versioned").write(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice"))
    Output(path, mode="merge", merge_on="o_orderkey").write(_source(spark, sf_dir))
    return path


@query(f"WITH {_SIDES} SELECT * FROM s UNION ALL SELECT o_orderkey, o_custkey, o_totalprice FROM t WHERE o_orderkey NOT IN (SELECT o_orderkey FROM s)")
def versioned_upsert(spark, sf_dir):
    return Input(_versioned(spark, sf_dir), spark=spark).dataframe()


@query(f"""
    WITH {_SIDES}, m AS (SELECT s.o_orderkey, t.o_orderkey IS NOT NULL AS known FROM s LEFT JOIN t USING (o_orderkey))
    SELECT kind AS _change_type, count(*) AS n FROM m, (VALUES ('update_preimage', true), ('update_postimage', true), ('insert', false)) AS k(kind, of) WHERE known = of GROUP BY 1
""")
def versioned_changes(spark, sf_dir):
    return merge.read_cdf(_versioned(spark, sf_dir), 1, spark=spark).groupBy("_change_type").agg(F.count("*").alias("n"))


@contextmanager
def _database(spark, *tables: tuple[str, DataFrame]):
    """A database made for a query, which goes again."""
    db = f"meldframe_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {db}")
    try:
        for name, df in tables:
            df.write.format("parquet").saveAsTable(f"{db}.{name}")
        yield db
    finally:
        spark.sql(f"DROP DATABASE {db} CASCADE")


def _here(df: DataFrame) -> DataFrame:
    """A result of a few rows, taken before its tables go."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def _synced(spark, sf_dir) -> tuple[str, DataFrame]:
    """A target that followed all orders through a snapshot, no news and a merge of ``_source``, and its audit."""
    source, target = f"{_scratch(spark)}/orders", f"{_scratch(spark)}/target"
    Output(source, "versioned").write(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice"))
    spec = {"src_key": "orders", "src_path": source, "dst_table": target, "pks": ["o_orderkey"]}
    with _database(spark) as db:
        state, audit = SyncState(f"{db}.state", spark=spark), SyncAudit(f"{db}.audit", spark=spark)
        for news in (False, False, True):
            if news:
                Output(source, mode="merge", merge_on="o_orderkey").write(_source(spark, sf_dir))
            _, failed = run_sync([spec], state, audit=audit, spark=spark)
            if failed:
                raise failed[0].error
        return target, _here(spark.table(f"{db}.audit").drop("audited_at", "src_path", "dst_table"))


@query(f"WITH {_SIDES} SELECT * FROM s UNION ALL SELECT o_orderkey, o_custkey, o_totalprice FROM t WHERE o_orderkey NOT IN (SELECT o_orderkey FROM s)")
def synchronized(spark, sf_dir):
    return Input(_synced(spark, sf_dir)[0], spark=spark).dataframe()


@query("""
    WITH n AS (SELECT count(*) AS n, count(*) FILTER (o_orderkey % 3 = 0 AND o_orderkey <> 0) AS new FROM orders)
    SELECT 'orders' AS src_key, mode AS sync_mode, version::BIGINT AS last_delta_version, CASE mode WHEN 'initial_snapshot' THEN n WHEN 'cdf_merge' THEN new ELSE 0 END AS rows_inserted,
        CASE mode WHEN 'cdf_merge' THEN n - new ELSE 0 END AS rows_updated, 0::BIGINT AS rows_deleted, CASE mode WHEN 'initial_snapshot' THEN n WHEN 'cdf_merge' THEN n + new ELSE 0 END AS rows_output
    FROM n, (VALUES ('initial_snapshot', 0), ('already_current', 0), ('cdf_merge', 1)) AS m(mode, version)
""")
def sync_audit(spark, sf_dir):
    return _synced(spark, sf_dir)[1]


@query("""
    SELECT 'sales.' || t AS src_key, 'lake/sales/' || t AS src_path, 'sales_' || t AS dst_table, pks FROM (VALUES ('lines', 'order_id,line'), ('orders', 'id')) AS x(t, pks)
""")
def specs(spark, sf_dir):
    rows = [("Sales", " Orders", "ID", "1"), ("sales", "lines", "line", "2"), ("sales", "lines", "order_id", "1"), ("sales", "lines", "order_id", "1"), ("sales", "lines", "", "3"), ("sales", "lines", "x", "no")]
    path = f"{_scratch(spark)}/keys.csv"
    Output(path).write(spark.createDataFrame(rows, "schema_name string, table_name string, column_name string, position string"))
    found = load_specs(path, source="lake/{schema}/{table}", spark=spark)
    return spark.createDataFrame([(x["src_key"], x["src_path"], x["dst_table"], ",".join(x["pks"])) for x in found], "src_key string, src_path string, dst_table string, pks string")


@query("""
    SELECT * FROM (
        SELECT 'nation' AS name, 'n_name' AS column_name, count(*) AS match_count, min(n_name) AS sample FROM nation WHERE contains(lower(n_name), 'io')
        UNION ALL SELECT 'region', 'r_name', count(*), min(r_name) FROM region WHERE contains(lower(r_name), 'io')
    ) WHERE match_count > 0
""")
def database_search(spark, sf_dir):
    with _database(spark, *((n, table(spark, sf_dir, n)) for n in ("nation", "region"))) as db:
        found = search_database(db, "IO", spark=spark)
        return _here(found.select(F.substring_index("table_name", ".", -1).alias("name"), "column_name", "match_count", F.element_at("sample_values", 1).alias("sample")))


@query("SELECT * FROM (VALUES ('dropped', 'region'), ('left', 'nation')) AS x(what, name)")
def dropped_tables(spark, sf_dir):
    with _database(spark, *((n, table(spark, sf_dir, n)) for n in ("nation", "region"))) as db:
        would = drop_database_tables(db, dry_run=True, spark=spark)
        gone = drop_database_tables(db, tables=["region"], spark=spark)
        left = [t.name for t in spark.catalog.listTables(db)]
        if len(would) != 2:
            raise ValueError(f"a dry run named {would}")
        return spark.createDataFrame([("dropped", n.split(".")[-1]) for n in gone] + [("left", n) for n in left], "what string, name string")


@query("""
    SELECT t AS "table", c AS column_name, i::INTEGER AS ordinal, k AS data_type, true AS nullable, false AS is_partition
    FROM (VALUES ('nation', 'n_nationkey', 0, 'int'), ('nation', 'n_name', 1, 'string'), ('nation', 'n_regionkey', 2, 'int'), ('region', 'r_regionkey', 0, 'int'), ('region', 'r_name', 1, 'string')) AS x(t, c, i, k)
""")
def dictionary(spark, sf_dir):
    with _database(spark, *((n, table(spark, sf_dir, n)) for n in ("nation", "region"))) as db:
        return scan_databases(db, spark=spark).select("table", "column_name", "ordinal", "data_type", "nullable", "is_partition")
