"""Results published as one version: both tables or neither."""

import uuid

import pytest
from contactloom.operators import results
from contactloom.operators.store import Published
from contactloom.plans import queries as Q
from contactloom.session import shared_dir


def _results(spark, n, scan):
    records = spark.createDataFrame(
        [(f"k{i}", scan, None, 1, 1, 1) for i in range(n)], results.RECORD_SCHEMA
    )
    emails = spark.createDataFrame([(f"k{i}", scan, f"a{i}@x.org") for i in range(n)], results.EMAIL_SCHEMA)
    return results.Results(records, emails)


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_a_stop_between_the_two_tables_leaves_the_old_version_whole(spark):
    path = f"{shared_dir(spark)}/test-publish/{uuid.uuid4().hex}"
    assert results.publish_results(_results(spark, 5, "s1"), path) == 1
    before = results.read_published(spark, path)
    old = (_rows(before.records), _rows(before.emails))
    # A writer of version 2 wrote the records and stopped before the addresses.
    _results(spark, 7, "s2").records.write.parquet(f"{path}/versions/2-stopped/records")
    again = results.read_published(spark, path)
    assert (_rows(again.records), _rows(again.emails)) == old
    assert results.publish_results(_results(spark, 7, "s2"), path) == 2
    new = results.read_published(spark, path)
    assert {r.scan_id for r in new.records.collect()} == {"s2"} and new.emails.count() == 7
    assert results.read_published(spark, path, version=1).records.count() == 5


def test_nothing_published(spark):
    with pytest.raises(FileNotFoundError):
        Published(spark, f"{shared_dir(spark)}/test-publish/{uuid.uuid4().hex}").read()


def test_cache_publish_equals_cache_upsert(spark):
    sf = "/root/testdata/sf0.001"
    assert _rows(Q.cache_publish(spark, sf)) == _rows(Q.cache_upsert(spark, sf))
