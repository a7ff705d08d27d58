"""Keyed store: change files by bucket, tombstones, compaction, versions published whole."""

import os
import uuid

import pytest
from contactloom.operators.store import KeyedStore
from contactloom.plans import queries as Q
from contactloom.session import shared_dir

SCHEMA = "k string, v long, at long"


def _store(spark, buckets=8):
    return KeyedStore(spark, f"{shared_dir(spark)}/test-store/{uuid.uuid4().hex}", ["k"], ["at"], buckets)


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def _segment_buckets(store, version):
    segment = store.manifest(version)["segments"][-1]["id"]
    folder = f"{store.path}/segments/{segment}".removeprefix("file:")
    return sorted(name for name in os.listdir(folder) if name.startswith("_bucket="))


def test_upserts_deletes_and_latest_wins(spark):
    store = _store(spark)
    store.commit(spark.createDataFrame([(f"k{i}", i, 1) for i in range(100)], SCHEMA))
    # Within a commit the greatest ``at`` wins; across commits the newer commit.
    store.commit(spark.createDataFrame([("k1", 10, 5), ("k1", 11, 7), ("k2", 20, 0), ("new", 1, 1)], SCHEMA))
    store.commit(deletes=spark.createDataFrame([("k3",), ("absent",)], "k string"))
    got = dict((k, v) for k, v, _ in _rows(store.read()))
    assert got["k1"] == 11 and got["k2"] == 20 and got["new"] == 1 and "k3" not in got and len(got) == 100
    assert dict((k, v) for k, v, _ in _rows(store.read(version=1)))["k1"] == 1
    assert "k3" in dict((k, v) for k, v, _ in _rows(store.read(version=2)))


def test_a_commit_writes_only_the_buckets_it_touches(spark):
    store = _store(spark, buckets=16)
    store.commit(spark.createDataFrame([(f"k{i}", i, 1) for i in range(500)], SCHEMA))
    assert len(_segment_buckets(store, 1)) == 16
    store.commit(spark.createDataFrame([("k7", 70, 2)], SCHEMA))
    assert len(_segment_buckets(store, 2)) == 1
    # Reading some keys reads only their buckets, and gives the same rows.
    keys = spark.createDataFrame([("k7",), ("k8",)], "k string")
    assert _rows(store.read(keys=keys)) == [("k7", 70, 2), ("k8", 8, 1)]


def test_a_half_written_commit_leaves_the_last_version_whole(spark):
    store = _store(spark)
    store.commit(spark.createDataFrame([(f"k{i}", i, 1) for i in range(50)], SCHEMA))
    before = _rows(store.read())
    # The files of version 2 are written, but it stops before its manifest is.
    store._segment(spark.createDataFrame([("k1", 99, 9), ("k2", 98, 9)], SCHEMA).selectExpr("*", "false AS _deleted"), 2)
    assert store.versions() == [1]
    assert _rows(store.read()) == before
    # The next commit takes version 2 and does not see the stray files.
    store.commit(spark.createDataFrame([("k3", 97, 9)], SCHEMA))
    got = dict((k, v) for k, v, _ in _rows(store.read()))
    assert got["k1"] == 1 and got["k3"] == 97


def test_compaction_keeps_the_rows_and_drops_tombstones(spark):
    store = _store(spark)
    store.commit(spark.createDataFrame([(f"k{i}", i, 1) for i in range(40)], SCHEMA))
    store.commit(spark.createDataFrame([("k1", 5, 2)], SCHEMA), spark.createDataFrame([("k2",)], "k string"))
    before = _rows(store.read())
    version = store.compact()
    assert len(store.manifest(version)["segments"]) == 1 and _rows(store.read()) == before
    raw = spark.read.parquet(f"{store.path}/segments/{store.manifest()['segments'][0]['id']}")
    assert raw.filter("_deleted").count() == 0


def test_empty_store_has_no_version(spark):
    store = _store(spark)
    assert store.versions() == []
    with pytest.raises(FileNotFoundError):
        store.read()


def test_jobs_upsert_equals_the_stream(spark):
    sf = "/root/testdata/sf0.001"
    assert sorted(map(tuple, Q.jobs_upsert(spark, sf).collect()), key=str) == sorted(
        map(tuple, Q.stream_job_state(spark, sf).collect()), key=str
    )
