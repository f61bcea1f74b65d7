import hashlib
import random

import pytest
from pyspark.sql import functions as F

from meldframe.llm import warc
from meldframe.llm.shared import session_settings, written

PAGES = "page_id long, url string, html string, data string"


def archived(spark, rows, tmp_path, chunk_bytes=warc.CHUNK_BYTES, archive_bytes=warc.ARCHIVE_BYTES):
    folder = f"file://{tmp_path}/warc"
    chunked = warc.chunks(warc.decide(spark.createDataFrame(rows, PAGES), "page_id", "html", "url"), chunk_bytes=chunk_bytes)
    archives = written(warc.write_archives(chunked, folder, archive_bytes=archive_bytes), "archives")
    return archives, warc.read_chunks(warc.spread(spark, archives), folder, chunk_bytes=chunk_bytes)


def test_payloads_come_back_whole(spark, tmp_path):
    r = random.Random(1)
    texts = [None, "", "x", "a\r\n\r\nWARC/1.1\r\n" * 20, "é" * 5000, "".join(chr(r.randint(0, 0x7FF)) for _ in range(30_000)), "copy" * 40, "copy" * 40, "tiny", "tiny"]
    rows = [(i, f"http://x/{i}\r\nInjected: 1", t, "own") for i, t in enumerate(texts)] + [(6, "u", texts[6], "own"), (None, None, texts[6], "own")]
    archives, read = archived(spark, rows, tmp_path, chunk_bytes=1000, archive_bytes=20_000)
    got = read.collect()
    payloads, last = {}, {}
    for row in sorted(got, key=lambda x: (x.record is None, x.record or 0, x.chunk)):
        if row.record_type == "response" and row.record != 6:
            payloads[row.record] = payloads.get(row.record, b"") + bytes(row.data)
            assert row.digest_so_far == hashlib.sha256(payloads[row.record]).hexdigest()
            assert len(row.data) <= 1000
        if row.last:
            last.setdefault(row.record, []).append(row)
            assert row.intact
    assert {k: v.decode() for k, v in payloads.items()} == {i: t or "" for i, t in enumerate(texts) if i not in (6, 7)}
    assert [x.record_type for x in last[6]] == ["response", "response"]
    for key in (7, None):
        (row,) = last[key]
        assert (row.record_type, row.refers_to, row.payload_bytes) == ("revisit", 6, 160)
        assert row.payload_digest == hashlib.sha256(texts[6].encode()).hexdigest()
    assert [last[i][0].record_type for i in (8, 9)] == ["response", "response"]
    assert archives.agg(F.sum("records")).first()[0] == len(rows)


def test_empty_table_and_damage(spark, tmp_path):
    archives, read = archived(spark, [], tmp_path)
    assert archives.isEmpty() and read.isEmpty()
    archives, read = archived(spark, [(1, "u", "payload" * 10_000, "own")], tmp_path)
    name = archives.first().archive
    path = tmp_path / "warc" / name
    path.write_bytes(path.read_bytes()[:-40])
    with pytest.raises(Exception, match="ends inside"):
        read.collect()


def test_chunks_out_of_place_are_an_error(spark, tmp_path):
    rows = [(i, "u", f"{i}" * 500, "own") for i in range(4)]
    chunked = warc.chunks(warc.decide(spark.createDataFrame(rows, PAGES), "page_id", "html", "url"), chunk_bytes=100).coalesce(1)
    for broken in (chunked.orderBy("chunk"), chunked.where("chunk <> 2"), chunked.where("chunk < 4"), chunked.where("not (record = 1 and chunk = 0)")):
        with pytest.raises(Exception, match="isn't where it should be|lacks chunks"):
            warc.write_archives(broken, f"file://{tmp_path}/warc").collect()


def test_a_hot_digest_is_split(spark, tmp_path):
    """Copies of one page make most rows; the join's final plan deals their partition out to several tasks."""
    rows = [(i, "u", ("same page " * 60 if i % 3 else f"page {i} " * 60), "own") for i in range(6000)]
    spark.createDataFrame(rows, PAGES).repartition(8).write.parquet(f"{tmp_path}/pages")
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.shuffle.partitions": "16",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    }
    with session_settings(spark, settings):
        joined = warc.decide(spark.read.parquet(f"{tmp_path}/pages"), "page_id", "html", "url")
        joined.write.format("noop").mode("overwrite").save()
        joined.collect()
        assert "isSkew=true" in joined._jdf.queryExecution().executedPlan().toString() or "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
        assert joined.where("type = 'revisit' and refers_to = 1").count() == 3999
