"""Crawl transitions, and streams against their batch forms."""

import hashlib

import pytest
from pyspark.sql import functions as F

from lexigrid.operators import crawl
from lexigrid.streaming import crawl as crawl_stream
from lexigrid.streaming import index as index_stream

NOW = 1_000_000


def results(spark, rows):
    return spark.createDataFrame(rows, crawl_stream.RESULTS)


@pytest.fixture
def state(spark):
    records = spark.createDataFrame([("http://A.org/x#y", "en", 1), ("http://a.org/x", "en", 1), ("http://b.org", None, 2), (" ", "en", 3)], "url string, lang string, pageid int")
    return crawl.upsert(crawl.empty_state(spark), crawl.seeds(records, "/c/ruwiki/m.json"), NOW)


def test_seeds(spark, state):
    got = {r.norm_url: r for r in state.collect()}
    assert sorted(got) == ["http://a.org/x", "http://b.org/"]
    assert got["http://b.org/"].source == "ruwiki" and got["http://a.org/x"].fail_count == 0
    again = crawl.upsert(state, crawl.seeds(spark.createDataFrame([("http://a.org/x", "en", 1)], "url string, lang string, pageid int")), NOW + 5)
    assert {(r.norm_url, r.created_at, r.updated_at) for r in again.collect()} == {("http://a.org/x", NOW, NOW + 5), ("http://b.org/", NOW, NOW)}


def test_transitions(spark, state):
    first = crawl.apply_results(state, results(spark, [("http://a.org/x", 200, "v1", "e", None, None, NOW), ("http://b.org/", 503, None, None, None, None, NOW)]), NOW)
    got = {r.norm_url: r for r in first.collect()}
    a, b = got["http://a.org/x"], got["http://b.org/"]
    assert (a.status_code, a.fetched_at, a.next_refetch_at, a.etag, a.changed, a.content_hash) == (200, NOW, NOW + 604800, "e", None, hashlib.sha256(b"v1").hexdigest())
    assert (b.last_error, b.next_retry_at, b.fail_count, b.status_code) == ("HTTP 503", NOW + 900, 1, None)
    assert crawl.due(first, NOW + 899).count() == 0
    assert [r.norm_url for r in crawl.due(first, NOW + 900).collect()] == ["http://b.org/"]
    later = NOW + 604800
    assert {(r.norm_url, r.job) for r in crawl.due(first, later).collect()} == {("http://a.org/x", "refetch"), ("http://b.org/", "first_fetch")}
    same = crawl.apply_results(first, results(spark, [("http://a.org/x", 200, "v1", None, None, None, later)]), later).where("norm_url = 'http://a.org/x'").first()
    assert (same.fetched_at, same.last_checked_at) == (NOW, later)
    new = crawl.apply_results(first, results(spark, [("http://a.org/x", 200, "v2", None, None, None, later)]), later).where("norm_url = 'http://a.org/x'").first()
    assert (new.fetched_at, new.changed, new.html, new.etag) == (later, True, "v2", "e")


def test_leases(spark, state):
    taken = crawl.take(state, NOW, 1, "me")
    assert taken.count() == 1 and taken.first().lock.until == NOW + 600
    locked = state.drop("lock").join(taken.select("norm_url", "lock"), "norm_url", "left").select(state.columns)
    assert crawl.due(locked, NOW).count() == 1 and crawl.due(locked, NOW + 600).count() == 2
    done = results(spark, [(taken.first().norm_url, 200, "x", None, None, None, NOW)])
    assert crawl.apply_results(locked, done, NOW, owner="other").where("fetched_at is not null").count() == 0
    assert crawl.apply_results(locked, done, NOW, owner="me").where("fetched_at is not null and lock is null").count() == 1


ROWS = [("http://a.org/x", 200, "v1", None, None, None, NOW), ("http://b.org/", None, None, None, None, "boom", NOW), ("http://a.org/x", 200, "v2", None, None, None, NOW + 9)]


def test_fold_stream(spark, state, tmp_path):
    root, source = str(tmp_path / "state"), str(tmp_path / "in")
    state.write.parquet(crawl_stream.version_path(root, 0))
    for n, part in enumerate((ROWS[:2], ROWS[2:])):
        results(spark, part).coalesce(1).write.mode("append").parquet(source)
        crawl_stream.apply_stream(spark.readStream.schema(crawl_stream.RESULTS).parquet(source), root, str(tmp_path / "cp")).awaitTermination()
        assert crawl_stream.latest(spark, root) == n + 1
    batch = crawl.apply_results(crawl.apply_results(state, results(spark, ROWS[:2]), NOW), results(spark, ROWS[2:]), NOW + 9)
    assert sorted(map(str, crawl_stream.read_state(spark, root).collect())) == sorted(map(str, batch.collect()))
    crawl_stream.import_seeds(spark, spark.createDataFrame([("http://c.org/", "en")], "url string, lang string"), root, NOW)
    assert crawl_stream.read_state(spark, root).count() == 3


def test_state_store(spark, tmp_path):
    source = str(tmp_path / "in")
    results(spark, ROWS).coalesce(1).write.parquet(source)
    out = crawl_stream.change_stream(spark.readStream.schema(crawl_stream.RESULTS).parquet(source))
    out.writeStream.format("memory").queryName("changes").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).outputMode("append").start().awaitTermination()
    got = {(r.norm_url, r.fetched_at): (r.changed, r.fail_count, r.next_retry_at) for r in spark.table("changes").collect()}
    assert got == {("http://a.org/x", NOW): (None, 0, None), ("http://a.org/x", NOW + 9): ("true", 0, None), ("http://b.org/", None): (None, 1, NOW + 900)}


def test_index_stream(spark, tmp_path):
    source, root = str(tmp_path / "in"), str(tmp_path / "rows")
    schema = "doc_id bigint, text string"
    for part in ([(1, "a b"), (2, "b")], [(1, "c"), (3, None)], [(2, "")]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        index_stream.append_stream(spark.readStream.schema(schema).parquet(source), root, str(tmp_path / "cp")).awaitTermination()
    assert sorted(tuple(r) for r in index_stream.current(spark, root).collect()) == [("c", 1)]
    index_stream.compact(spark, root, str(tmp_path / "compact"))
    assert index_stream.current(spark, str(tmp_path / "compact")).where(F.col("term") == "c").count() == 1


def test_config(tmp_path):
    (tmp_path / "c.yaml").write_text("logic:\n  lock_ttl_sec: 5\nseeds:\n  metadata_paths: [a.json]\n")
    c = crawl.CrawlConfig.read(str(tmp_path / "c.yaml"))
    assert (c.lock_ttl_sec, c.retry_after_sec, c.metadata_paths) == (5, 900, ["a.json"])
