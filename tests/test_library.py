import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

import meldframe as m
from meldframe.functions.naming import snake_case, unique_names
from meldframe.operators import merge
from meldframe.plans import sync
from meldframe.sources.io import Input, Output, format_of_name
from meldframe.operators.catalog import keyword_hits
from meldframe.operators.matching import ngram_match
from meldframe.sources.versions import CommitConflict, VersionedTable, current_version


@pytest.fixture
def db(spark):
    spark.sql("DROP DATABASE IF EXISTS test_db CASCADE")
    spark.sql("CREATE DATABASE test_db")
    m.set_spark(spark)
    yield "test_db"
    m.set_spark(None)
    spark.sql("DROP DATABASE test_db CASCADE")


def test_names(spark):
    df = spark.createDataFrame([(1, 2, 3)], ["ID", "Value ($)", "Value"])
    assert m.clean_columns(df).columns == ["id", "value", "value_1"]
    clean = m.clean_columns(m.clean_columns(df))
    assert m.clean_columns(clean) is clean
    assert unique_names(["name", "Name", "name_1"]) == ["name", "name_1", "name_1_1"]
    assert [snake_case(x) for x in ("Été", "", "%%", "2x", "łø")] == ["ete", "_", "_", "_2x", "_"]


@given(st.lists(st.text(max_size=6), max_size=8))
def test_names_are_unique(names):
    assert len(set(unique_names(names))) == len(names)


def test_dedupe(spark):
    df = spark.createDataFrame([(1, "old", "2026-01-01"), (1, "new", "2026-01-02"), (2, "only", "2026-01-01"), (2, "null", None)], "id long, value string, updated_at string")
    assert {r.id: r.value for r in m.dedupe(df, ["id"], ["updated_at"]).collect()} == {1: "new", 2: "only"}
    assert {r.id: r.value for r in m.dedupe(df, "id", "updated_at", descending=False).collect()} == {1: "old", 2: "null"}
    with pytest.raises(ValueError):
        m.dedupe(df, [], ["updated_at"])


def test_normalize(spark):
    rows = spark.createDataFrame([(" A-B  C! ",), ("Café Au Lait!",), (None,), ("O'Brien's",)], "v string")
    assert [r[0] for r in rows.select(m.normalize_text("v")).collect()] == ["a b c", "cafe au lait", "", "o brien s"]


def test_fuzzy_edges(spark):
    left = spark.createDataFrame([(1, None, "g"), (2, "x", "g"), (3, "abcdef", "g"), (4, "abcdef", None)], "id long, value string, grp string")
    right = spark.createDataFrame([(9, "abcdeg", "g"), (8, "abcdeh", "g"), (7, "abcdef", None)], "id long, name string, grp string")
    got = m.fuzzy_match(left, right, left_on="value", right_on="name", left_id="id", right_id="id", block_on="grp").collect()
    assert [(r.left_id, r.right_id, r.match_distance) for r in got] == [(3, 8, 1)]
    every = m.fuzzy_match(left, right, left_on="value", right_on="name", left_id="id", right_id="id", keep_all_candidates=True).collect()
    assert sorted((r.left_id, r.right_id, r.match_rank) for r in every) == [(3, 7, 1), (3, 8, 2), (3, 9, 3), (4, 7, 1), (4, 8, 2), (4, 9, 3)]
    for bad in ({"threshold": 1.5}, {"min_chars": 0}):
        with pytest.raises(ValueError):
            m.fuzzy_match(left, right, left_on="value", right_on="name", **bad)


def test_infer_and_fill(spark):
    left = spark.createDataFrame([(None, "A B C")], "id long, value string")
    reference = spark.createDataFrame([(7, "abc"), (None, "abc")], "id long, value_ref string")
    row = m.infer_key_from_text(left, reference, key_col="id", text_col="value", reference_text_col="value_ref", method="ml").first()
    assert (row.id, row._match_inferred_id, row._match_score, row._match_distance) == (7, 7, 1.0, 0.0)
    keyless = m.infer_key_from_text(left.select("value"), reference, key_col="id", text_col="value", reference_text_col="value_ref")
    assert keyless.columns[:2] == ["value", "id"] and keyless.schema["id"].dataType.typeName() == "long"
    with pytest.raises(ValueError):
        m.infer_key_from_text(left, reference, key_col="id", text_col="value", reference_text_col="value_ref", method="other")
    own = spark.createDataFrame([("abcd", "kept"), ("abcd", None), ("zzzz", "lost")], "v string, attr string")
    other = spark.createDataFrame([("abce", "new")], "v string, attr string")
    filled = m.fill_missing_from_match(own, other, left_on="v", right_on="v", fill_cols="attr", threshold=0.7)
    assert sorted((r.v, r.attr, r._match_right_text) for r in filled.collect() if r.attr) == [("abcd", "kept", "abce"), ("abcd", "new", "abce"), ("zzzz", "lost", None)]
    over = m.fill_missing_from_match(own, other, left_on="v", right_on="v", fill_cols="attr", threshold=0.7, overwrite=True)
    assert sorted(str(r.attr) for r in over.collect()) == ["None", "new", "new"]


def test_sql_builders():
    assert m.merge_condition(["id", "fk_id"]) == "t.id = s.id AND t.fk_id = s.fk_id"
    assert m.column_map(["id", "value"]) == {"id": "s.id", "value": "s.value"}


def _rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_merges(spark, db):
    source = spark.createDataFrame([(1, "new"), (3, "insert")], "id long, value string")
    spark.createDataFrame([(1, "old"), (2, "delete")], "id long, value string").write.saveAsTable("test_db.t")
    metrics = m.snapshot_merge("test_db.t", source, ["id"])
    assert _rows(spark.table("test_db.t")) == [(1, "new"), (3, "insert")]
    assert metrics == {"numTargetRowsInserted": 1, "numTargetRowsUpdated": 1, "numTargetRowsDeleted": 1, "numOutputRows": 2}
    Output.table("test_db.t", mode="merge", merge_on="id").write(spark.createDataFrame([(3, "x"), (4, "y")], "id long, value string"))
    assert _rows(spark.table("test_db.t")) == [(1, "new"), (3, "x"), (4, "y")]
    with pytest.raises(merge.MergeConflict):
        m.upsert("test_db.t", spark.createDataFrame([(3, "a"), (3, "b")], "id long, value string"), ["id"])
    with pytest.raises(ValueError):
        Output.table("test_db.t", mode="merge").write(source)


def test_null_keys_and_narrow_sources(spark):
    target = spark.createDataFrame([(None, "t", 1), (1, "a", 2)], "id long, value string, own int")
    source = spark.createDataFrame([(None, "s"), (1, "b"), (2, "c")], "id long, value string")
    plan = merge.snapshot_plan(target, source, ["id"])
    assert _rows(merge.result_of(plan)) == sorted([(None, "s", None), (1, "b", 2), (2, "c", None)], key=repr)
    with pytest.raises(ValueError):
        merge.snapshot_plan(target, source.withColumn("more", F.lit(1)), ["id"])


def test_change_feed(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    VersionedTable(spark, path).write(spark.createDataFrame([(1, "a"), (2, "b")], "id long, value string"))
    feed = spark.createDataFrame(
        [(1, "x", "update_preimage", 1), (1, "c", "update_postimage", 1), (2, None, "delete", 2), (9, None, "delete", 2), (3, "n", "delete", 3), (3, "n", "insert", 3), (4, "z", None, 3)],
        "id long, value string, _change_type string, _commit_version long",
    ).withColumn("_commit_timestamp", F.lit("2026-01-01").cast("timestamp"))
    assert m.cdf_merge(path, feed, ["id"]) is True
    assert _rows(m.Input(path, spark=spark).dataframe()) == [(1, "c"), (3, "n")]
    assert m.cdf_merge(path, feed.limit(0), ["id"]) is False
    assert current_version(spark, path) == 1
    kinds = {(r.id, r._change_type) for r in m.read_cdf(path, 1, spark=spark).collect()}
    assert kinds == {(1, "update_preimage"), (1, "update_postimage"), (2, "delete"), (3, "insert")}


def test_version_probe_of_a_foreign_log(spark, tmp_path):
    log = tmp_path / "d" / "_delta_log"
    log.mkdir(parents=True)
    assert current_version(spark, f"file://{tmp_path}/d") is None
    (log / "_last_checkpoint").write_text('{"version": 10}')
    (log / "00000000000000000012.json").write_text("{}")
    assert current_version(spark, f"file://{tmp_path}/d") == 12


@pytest.mark.parametrize(
    ("path", "expected"),
    [("a/b.PARQUET", "parquet"), ("x.csv.gz", "csv"), ("x.tsv/", "csv"), ("part-0.snappy.parquet", "parquet"), ("db.table", None), ("folder", None), ("a.xls", "excel"), ("a.ndjson", "json")],
)
def test_formats(path, expected):
    assert format_of_name(path) == expected


def test_inputs_and_outputs(spark, db, tmp_path):
    df = spark.createDataFrame([(1, "a")], "id long, value string")
    Output.table("test_db.t", format="parquet").write(df)
    assert _rows(Input.table("test_db.t", spark=spark).dataframe()) == [(1, "a")]
    folder = f"file://{tmp_path}/bare"
    Output(folder, "json").write(df)
    assert Input(folder, spark=spark).fmt == "json"
    assert Input("some.table").fmt == "table"
    with pytest.raises(TypeError):
        Output(folder, "json").write({"a": df})


def test_transforms(spark, db, tmp_path):
    spark.createDataFrame([(1, 10), (2, 20)], "id long, value long").write.saveAsTable("test_db.src")

    @m.transform_df(output=Output.table("test_db.dst", format="parquet"), src=Input.table("test_db.src"))
    def big(src):
        return src.where("value > 10")

    assert _rows(big.compute()) == [(2, 20)] == _rows(spark.table("test_db.dst"))

    @m.transform_df(output=Output("x"), src=Input.table("test_db.src"))
    def nothing(src):
        return None

    with pytest.raises(ValueError):
        nothing()

    @m.transform(output=Output.table("test_db.dst2", format="parquet"), src=Input.table("test_db.src"))
    def copy(src, output):
        output.write(src.dataframe())

    copy()
    assert spark.table("test_db.dst2").count() == 2
    for bad in (lambda: m.transform_df(output="x"), lambda: m.transform(), lambda: m.transform(output=Output("x"), outputs={}), lambda: m.transform(outputs={"a": Output("x")}, a=Input("y"))):
        with pytest.raises(TypeError):
            bad()


def test_parallel(spark):
    def job(n, name=None):
        if n == 2:
            raise KeyError(n)
        return n * 10

    got = m.run_parallel(job, [{"n": 1}, {"n": 2, "name": "two"}, {"n": 3}])
    assert got[0] == 10 and isinstance(got[1], KeyError) and got[2] == 30
    assert m.run_parallel(job, []) == []
    with pytest.raises(KeyError):
        m.run_parallel(job, [{"n": 2}, {"n": 1}], fail_fast=True)
    spark.sparkContext.setLocalProperty("spark.scheduler.pool", "before")
    assert m.run_parallel(lambda n: spark.sparkContext.getLocalProperty("spark.scheduler.pool"), [{"n": 1}], pool="p", spark=spark) == ["p"]
    assert spark.sparkContext.getLocalProperty("spark.scheduler.pool") == "before"
    spark.sparkContext.setLocalProperty("spark.scheduler.pool", None)


def test_catalog(spark, db):
    spark.createDataFrame([(1, "Blue whale"), (2, "blue"), (3, None)], "id long, value string").write.saveAsTable("test_db.table_a")
    spark.sql("CREATE VIEW test_db.v AS SELECT 1 AS x")
    assert {(r.table, r.column_name, r.data_type) for r in m.scan_databases(db).collect()} == {("table_a", "id", "bigint"), ("table_a", "value", "string")}
    m.write_dictionary(db)
    assert spark.table("test_db.__data_dictionary").count() == 2
    hits = [tuple(r) for r in m.search_database(db, "BLUE", sample_rows=5).collect()]
    assert hits == [("test_db.table_a", "value", 2, ["Blue whale", "blue"])]
    assert m.search_database(db, "BLUE", case_sensitive=True).isEmpty()
    with pytest.raises(ValueError):
        m.search_database(db, "")
    assert m.drop_database_tables(db, tables=["table_a"], dry_run=True) == ["test_db.table_a"]
    assert spark.catalog.tableExists("test_db.table_a")
    m.drop_database_tables(db)
    assert [t.name for t in spark.catalog.listTables(db)] == ["v"]


def test_sync(spark, db, tmp_path):
    path, table = f"file://{tmp_path}/src", "test_db.dst"
    source = VersionedTable(spark, path)
    state, audit = m.SyncState("test_db.state"), m.SyncAudit("test_db.audit")
    spec = {"src_key": "k", "src_path": path, "dst_table": table, "pks": ["id"]}
    lost = {"src_key": "bad", "src_path": f"{path}-none", "dst_table": "test_db.none", "pks": ["id"]}

    def run(*specs):
        done, failed = m.run_sync(specs, state, audit=audit, spark=spark)
        return [r["sync_mode"] for r in done], [f.spec["src_key"] for f in failed]

    source.write(spark.createDataFrame([(1, "a"), (2, "b")], "Id long, Value string"))
    assert run(spec, lost) == (["initial_snapshot"], ["bad"])
    assert run(spec) == (["already_current"], [])
    merge.upsert(path, spark.createDataFrame([(2, "B"), (3, "c")], "Id long, Value string"), ["Id"])
    assert run(spec) == (["cdf_merge"], [])
    assert _rows(spark.table(table)) == [(1, "a"), (2, "B"), (3, "c")]
    source.commit(source.read(), None, "nothing", {})
    assert run(spec) == (["cdf_noop"], [])
    assert state.get("k") == 2 and state.load_all() == {"k": 2} and state.get("other") is None
    state.upsert({**spec, "last_delta_version": -1, "sync_mode": "x"})
    assert run(spec) == (["snapshot_merge"], [])
    rows = spark.table("test_db.audit").orderBy("audited_at").collect()
    assert [(r.sync_mode, r.rows_inserted, r.rows_updated) for r in rows] == [("initial_snapshot", 2, 0), ("already_current", 0, 0), ("cdf_merge", 1, 1), ("cdf_noop", 0, 0), ("snapshot_merge", 0, 3)]


def test_specs(spark, tmp_path):
    (tmp_path / "keys.csv").write_text("schema_name,table_name,column_name,position\nS, T ,B,2\nS,T,a,1\nS,T,a,1\nS,T,,3\nS,T,c,x\nS,U,k,1\n")
    got = m.load_specs(f"file://{tmp_path}/keys.csv", source="root/{SCHEMA}/{TABLE}", spark=spark)
    assert [(s["src_key"], s["src_path"], s["pks"]) for s in got] == [("s.t", "root/S/T", ["a", "b"]), ("s.u", "root/S/U", ["k"])]


def test_stream(spark, tmp_path):
    from meldframe.streaming.changes import merge_stream, read_change_stream

    target, feed = f"file://{tmp_path}/t", f"{tmp_path}/feed"
    VersionedTable(spark, target).write(spark.createDataFrame([(1, "a")], "id long, value string"))
    changes = spark.createDataFrame([(1, "b", "update_postimage", 1), (2, "c", "insert", 1)], "id long, value string, change_type string, commit_version long").withColumn("commit_timestamp", F.lit("2026-01-01").cast("timestamp"))
    changes.write.parquet(feed)
    merge_stream(read_change_stream(spark, feed, changes.schema), target, ["id"], f"{tmp_path}/checkpoint").awaitTermination(60)
    assert _rows(Input(target, spark=spark).dataframe()) == [(1, "b"), (2, "c")]


def test_decisions():
    assert sync.decide(None, False, None) == ("initial_snapshot", -1)
    assert sync.decide(5, True, 3) == ("snapshot_merge", 3)
    assert sync.decide(3, True, 3) == ("already_current", 3)
    assert sync.decide(3, True, 4) == ("cdf_merge", 4)


def test_a_lost_commit_leaves_no_trace(spark, tmp_path):
    """Two writers start from one version: one wins, and the other's rows and changes are seen nowhere."""
    path = f"{tmp_path}/t"
    frame = lambda *rows: spark.createDataFrame(rows, "id long, value string")
    VersionedTable(spark, path).write(frame((1, "a"), (2, "b")))
    first, second = merge.target_of(spark, path), merge.target_of(spark, path)
    assert first.apply(merge.upsert_plan(first.read(), frame((1, "won")), ["id"]), "upsert")["numTargetRowsUpdated"] == 1
    with pytest.raises(CommitConflict):
        second.apply(merge.upsert_plan(second.read(), frame((2, "lost"), (9, "lost")), ["id"]), "upsert")
    table = VersionedTable(spark, path)
    assert table.version() == 1 and _rows(table.read()) == [(1, "won"), (2, "b")]
    assert sorted((r["value"], r["_change_type"]) for r in table.changes(1).collect()) == [("a", "update_preimage"), ("won", "update_postimage")]
    stray = table.vacuum(10, older_than=-3600)
    assert len(stray) == 2 and _rows(table.read()) == [(1, "won"), (2, "b")] and _rows(table.read(0)) == [(1, "a"), (2, "b")]
    assert table.changes(0).count() == 4


def test_appends_add_folders_and_vacuum_frees_old_ones(spark, tmp_path):
    path = f"{tmp_path}/t"
    table = VersionedTable(spark, path)
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, value string")
    table.write(df, partition_by=["value"])
    table.write(df.select("value", "id"), "append")
    info = table.commit_info()
    assert len(info["data"]) == 2 and info["metrics"] == {"numOutputRows": 2}
    assert _rows(table.read()) == [(1, "a"), (1, "a"), (2, "b"), (2, "b")] and table.changes(1).count() == 2
    with pytest.raises(ValueError):
        table.write(df.drop("value"), "append")
    table.write(df.limit(0))
    assert table.read().isEmpty() and table.changes(2).where("_change_type = 'delete'").count() == 4
    assert len(table.vacuum(1, older_than=-3600)) == 0  # the last overwrite's changes read them all
    table.write(df)
    assert len(table.vacuum(1, older_than=-3600)) == 2 and _rows(table.read()) == [(1, "a"), (2, "b")]


def test_a_merge_computes_its_source_once_for_the_plan(spark, tmp_path):
    path, counter = f"{tmp_path}/t", spark.sparkContext.accumulator(0)
    VersionedTable(spark, path).write(spark.range(100).selectExpr("id", "'old' AS value"))

    def seen(batches):
        for batch in batches:
            counter.add(batch.num_rows)
            yield batch

    source = spark.range(50, 150).selectExpr("id", "'new' AS value").mapInArrow(seen, "id long, value string")
    assert merge.upsert(path, source, ["id"]) == {"numTargetRowsInserted": 50, "numTargetRowsUpdated": 50, "numTargetRowsDeleted": 0, "numOutputRows": 150}
    assert counter.value <= 200  # the check for ambiguous keys, and the plan


def test_helper_columns_give_way_and_tables_keep_their_properties(spark, db):
    spark.sql("CREATE TABLE test_db.odd (id BIGINT, _action STRING COMMENT 'own', _before STRING, _in_target STRING) USING parquet COMMENT 'kept' TBLPROPERTIES ('a'='b')")
    schema = "id long, _action string, _before string, _in_target string"
    spark.createDataFrame([(1, "x", "y", "z"), (2, "x", "y", "z")], schema).write.insertInto("test_db.odd")
    metrics = m.snapshot_merge("test_db.odd", spark.createDataFrame([(2, "p", "q", "r"), (3, "p", "q", "r")], schema), ["id"])
    assert metrics == {"numTargetRowsInserted": 1, "numTargetRowsUpdated": 1, "numTargetRowsDeleted": 1, "numOutputRows": 2}
    assert _rows(spark.table("test_db.odd")) == [(2, "p", "q", "r"), (3, "p", "q", "r")]
    told = spark.sql("DESCRIBE TABLE EXTENDED test_db.odd").collect()
    assert {r["col_name"]: r["data_type"] for r in told}["Comment"] == "kept" and any("a=b" in (r["data_type"] or "") for r in told)


def test_best_matches_of_a_hot_text(spark):
    left = spark.createDataFrame([(i, "acme") for i in range(30)], "id long, name string")
    right = spark.createDataFrame([(100 + i, "acme") for i in range(30)], "key long, name string")
    best = m.fuzzy_match(left, right, left_on="name", right_on="name", left_id="id", right_id="key")
    assert {(r.right_id, r.match_rank) for r in best.collect()} == {(100, 1)} and best.count() == 30
    with pytest.raises(ValueError):
        ngram_match(left, right, left_on="name", right_on="name", threshold=0)


def test_keys_missing_in_a_feed_are_an_error(spark, db, tmp_path):
    path = f"{tmp_path}/source"
    VersionedTable(spark, path).write(spark.createDataFrame([(1, "a")], "id long, value string"))
    args = {"src_key": "k", "src_path": path, "dst_table": "test_db.fed", "state": sync.SyncState("test_db.state", spark=spark), "spark": spark}
    assert sync.sync_delta_to_table(pks=["id"], last_version=None, **args)["sync_mode"] == "initial_snapshot"
    VersionedTable(spark, path).write(spark.createDataFrame([(2, "b")], "id long, value string"), "append")
    with pytest.raises(ValueError, match="missing"):
        sync.sync_delta_to_table(pks=["nope"], last_version=0, **args)
    assert sync.sync_delta_to_table(pks=["id"], last_version=0, **args)["sync_mode"] == "cdf_merge"
    assert _rows(spark.table("test_db.fed")) == [(1, "a"), (2, "b")]


def test_samples_of_a_search(spark):
    df = spark.createDataFrame([("Beta", 1), ("alpha", 2), ("beta", 3), ("beta", 4), (None, 5)], "word string, n long")
    hits = lambda k, **o: [(r.match_count, r.sample_values) for r in keyword_hits(df, "t", k, **o).collect()]
    assert hits("ETA") == [(3, ["Beta"])] and hits("ETA", sample_rows=0) == [(3, [])] and hits("eta", sample_rows=5) == [(3, ["Beta", "beta"])]
    assert hits("gamma") == [] and hits("Beta", case_sensitive=True) == [(1, ["Beta"])]
