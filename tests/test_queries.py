"""Every registered query against its SQL twin, and the shape of some plans."""

import re
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
import __spark_entry__ as driver
from contactloom.plans.oracles import ORACLES
from contactloom.plans.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
TABLES = ("pages", "documents", "events")
# Expiry follows the watermark of each micro-batch of a stream: no SQL twin; tests/test_keyed.py checks it.
NO_TWIN: set[str] = {"stream_expiry"}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    return connection


def rows_by_name(rows, names):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(tuple(str(row[i]) for i in order) for row in rows)


def test_every_query_has_a_twin():
    assert set(QUERIES) - set(ORACLES) == NO_TWIN
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) <= set(driver.queries()) and set(ORACLES) <= set(driver.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, duck, name):
    df = driver.queries()[name](spark, SMALL)
    expected = duck.execute(driver.oracle_sql()[name])
    names = [column[0] for column in expected.description]
    assert sorted(df.columns) == sorted(names)
    assert rows_by_name(df.collect(), df.columns) == rows_by_name(expected.fetchall(), names)


def test_entry(spark):
    assert driver.entry(spark).count() > 0


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


BUILT_IN = (
    "url_parts", "url_key", "document_emails", "dedup_emails", "validate_seeds", "validate_requests",
    "cache_hits", "cache_upsert", "job_state", "job_expiry", "job_outcome_rows", "delivery_outcomes",
)


@pytest.mark.parametrize("name", BUILT_IN)
def test_built_in_plans(spark, name):
    text = plan(driver.queries()[name](spark, SMALL))
    assert not re.search("EvalPython|InPandas|CartesianProduct|BroadcastNestedLoop", text)


def test_scans_read_only_what_they_need(spark):
    assert "FileScan parquet [page_id#" in plan(driver.queries()["url_parts"](spark, SMALL))
    text = plan(driver.queries()["page_emails"](spark, SMALL))
    assert re.search(r"ArrowEvalPython.*\n.*Filter .*Contains\(html", text)
    assert "page_id" not in text
