"""The derived tables, with the figures known for them."""

import pytest
from pyspark.sql import functions as F

from contactloom.operators import jobs as J
from contactloom.plans import derived as D

FOLDED = {
    "sf0.001": (75, 2, 27, 20, 19, 7, 3, 13),
    "sf0.01": (749, 10, 330, 174, 179, 56, 29, 120),
}


@pytest.mark.parametrize("rows", [1_000_000, 5])
@pytest.mark.parametrize("sf", FOLDED)
def test_fold(spark, sf, rows):
    """The same with ordinary windows and with every job cut into ranges."""
    events = D.job_events(D.table(spark, f"/root/testdata/{sf}", "events"))
    jobs = J.fold_jobs(events, D.as_of(D.JOBS_AS_OF), rows=rows)
    counts = jobs.agg(
        F.count(F.lit(1)),
        *[F.count_if(F.col("status") == s) for s in J.JOB_STATES],
        F.count_if("active"),
        F.count_if("visible"),
    ).first()
    assert tuple(counts) == FOLDED[sf]


def test_site_numbers(spark, sf_dir):
    pages = D.table(spark, sf_dir, "pages")
    site = D.site(pages)
    assert site.count() == 250
    per_host = site.groupBy("host").agg(
        F.min("k").alias("low"), F.max("k").alias("high"), F.count_distinct("k").alias("c"),
        F.max("n").alias("n"),
    )
    assert per_host.filter("low <> 0 or high + 1 <> n or c <> n").count() == 0
