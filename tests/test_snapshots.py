"""Persisted upserts and the extraction cache."""

import os

import pytest
from pyspark.sql import functions as F

from korbwerk.sources.snapshots import ExtractionCache, Snapshot

ROW = "market long, name string, price double"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_upsert_touches_only_changed_partitions(spark, tmp_path):
    s = Snapshot(spark, f"file://{tmp_path}/s", ROW, ["market", "name"], "market")
    assert s.version() == 0 and rows_of(s.read()) == []
    first = [(1, "a", 1.0), (1, "b", 2.0), (2, "a", 3.0), (None, "x", 4.0), (3, None, None), (1, "a", 0.5)]
    assert s.upsert(spark.createDataFrame(first, ROW).withColumn("extra", F.lit(1))) == 1
    state = [(1, "a", 1.0), (1, "b", 2.0), (2, "a", 3.0), (None, "x", 4.0), (3, None, None)]
    assert rows_of(s.read()) == sorted(state, key=repr)
    assert s.upsert(spark.createDataFrame(first[1:5] + first[:1], ROW)) == 1  # a rerun changes nothing
    assert s.upsert(spark.createDataFrame([(1, "a", 9.0), (None, "x", 5.0), (4, "n", 1.0)], ROW)) == 2
    assert rows_of(s.read()) == sorted([(1, "a", 9.0), (1, "b", 2.0), (2, "a", 3.0), (None, "x", 5.0), (3, None, None), (4, "n", 1.0)], key=repr)
    assert len(os.listdir(tmp_path / "s/data/market=2")) == 1 and len(os.listdir(tmp_path / "s/data/market=1")) == 2
    assert s.upsert(spark.createDataFrame([], ROW)) == 2
    with pytest.raises(ValueError):
        Snapshot(spark, str(tmp_path), ROW, ["name"], "market")


def test_killed_and_rival_jobs_leave_the_state(spark, tmp_path, monkeypatch):
    s = Snapshot(spark, f"file://{tmp_path}/s", ROW, ["market", "name"], "market")
    s.upsert(spark.createDataFrame([(1, "a", 1.0)], ROW))
    rival = Snapshot(spark, f"file://{tmp_path}/s", ROW, ["market", "name"], "market")
    before = s._path

    def late(*parts):
        if parts == ("commits", "2"):  # another job commits between this one's reading and its rename
            monkeypatch.setattr(s, "_path", before)
            rival.upsert(spark.createDataFrame([(1, "a", 2.0)], ROW))
        return before(*parts)

    monkeypatch.setattr(s, "_path", late)
    with pytest.raises(RuntimeError):
        s.upsert(spark.createDataFrame([(1, "a", 3.0), (7, "lost", 1.0)], ROW))
    assert s.version() == 2 and rows_of(s.read()) == [(1, "a", 2.0)]


def test_cache_computes_each_content_once_a_version(spark, tmp_path):
    cache = ExtractionCache(spark, f"file://{tmp_path}/c", "string")
    seen = []

    def extract(new):
        seen.append(sorted(r.sha256 for r in new.collect()))
        return new.where("text <> ''").select("sha256", F.split("text", " ").alias("result"))

    docs = spark.createDataFrame([("aa1", "x y"), ("aa1", "x y"), ("bb2", ""), ("cc3", None), (None, "z")], "sha256 string, text string")
    want = [("aa1", ["x", "y"]), ("bb2", []), ("cc3", [])]
    assert rows_of(cache.extracted(docs, "v1", extract)) == want and seen == [["aa1", "bb2", "cc3"]]
    assert rows_of(cache.extracted(docs, "v1", extract)) == want and len(seen) == 1
    more = docs.unionByName(spark.createDataFrame([("aa4", "n")], docs.schema))
    assert rows_of(cache.extracted(more, "v1", extract)) == sorted([*want, ("aa4", ["n"])]) and seen[1:] == [["aa4"]]
    assert rows_of(cache.extracted(docs, "v2", extract)) == want and seen[2:] == [["aa1", "bb2", "cc3"]]
    assert cache.extracted(docs.limit(0), "v3", extract).collect() == [] and len(seen) == 3


def test_news_are_worked_out_once(spark, tmp_path):
    s = Snapshot(spark, f"file://{tmp_path}/s", ROW, ["market", "name"], "market")
    calls = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(x):
        calls.add(1)
        return x

    batch = spark.createDataFrame([(i, "a", float(i)) for i in range(5)], ROW).withColumn("price", counted(F.col("price")))
    assert s.upsert(batch) == 1 and calls.value == 5
    assert len(rows_of(s.read())) == 5 and os.listdir(tmp_path / "s/staged") == []


def test_market_snapshot_has_a_bounded_number_of_folders(spark, tmp_path, monkeypatch):
    from korbwerk.plans import catalog, persisted

    rows = spark.range(400).selectExpr("id AS l_suppkey", "id % 7 AS l_partkey", "timestamp'1995-01-01' AS l_shipdate", "10D AS l_extendedprice", "2D AS l_quantity", "'N' AS l_returnflag", "1 AS l_linenumber")
    rows.write.parquet(f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr(persisted, "fresh_root", lambda spark, name: f"file://{tmp_path}/s")
    assert catalog.QUERIES["k4_market_snapshot"](spark, str(tmp_path)).count() == 400
    assert len([f for f in os.listdir(tmp_path / "s/data") if "=" in f]) <= persisted.SHARDS
