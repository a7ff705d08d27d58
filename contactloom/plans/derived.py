"""Inputs derived from the given tables: sites, seeds, stored results, job and delivery logs.

The given pages hardly link to each other, so crawls run on a link graph laid over
their hosts. Page ``k`` of a host links to ``k+1``, ``2k+1``, ``2k+2`` and its parent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from contactloom.functions.urls import url_key
from contactloom.operators.skew import Ordered, Total, spread_join

AS_OF = "2024-01-15 00:00:00"
JOBS_AS_OF = "2024-01-31 00:00:00"
# Consecutive page ids numbered by one task.
_BLOCK = 1 << 18


def as_of(text: str = AS_OF) -> Column:
    return F.lit(text).cast("timestamp")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def site(pages: DataFrame) -> DataFrame:
    """Pages numbered within their host: ``page_id, host, k, n``.

    A host is numbered in blocks of page ids, so that a dominant host spans many tasks;
    only block counts are summed up per host.
    """
    hosts = pages.select(
        "page_id",
        F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1).alias("host"),
        F.floor(F.col("page_id") / _BLOCK).alias("block"),
    )
    by_host = Window.partitionBy("host")
    counts = (
        hosts.groupBy("host", "block")
        .count()
        .select(
            "host",
            "block",
            F.sum("count").over(by_host).alias("n"),
            F.coalesce(
                F.sum("count").over(
                    by_host.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
                ),
                F.lit(0),
            ).alias("before"),
        )
    )
    within = Window.partitionBy("host", "block").orderBy("page_id")
    return hosts.join(counts, ["host", "block"]).select(
        "page_id",
        "host",
        (F.col("before") + F.row_number().over(within) - 1).alias("k"),
        "n",
    )


def _path(k: Column) -> Column:
    contact = (k % 5 == 0) & (k > 0)
    return F.concat(F.when(contact, F.lit("/contact/p")).otherwise(F.lit("/p")), k.cast("string"))


def site_url(host: Column, k: Column) -> Column:
    return F.concat(F.lit("https://"), host, _path(k))


def site_pages(pages: DataFrame) -> DataFrame:
    """The link graph as HTML: ``page_id, host, k, url, status, html``."""
    k, n, host = F.col("k"), F.col("n"), F.col("host")
    none = F.lit("")

    def anchor(target: Column, exists: Column) -> Column:
        return F.when(
            exists, F.concat(F.lit('<a href="'), _path(target), F.lit('">go</a> '))
        ).otherwise(none)

    parent = F.floor((k - 1) / 2)
    html = F.concat(
        F.lit("<html><head>"),
        F.when(
            (k % 11 == 7) & (2 * k + 1 < n),
            F.concat(
                F.lit('<meta http-equiv="refresh" content="0; url='), _path(2 * k + 1), F.lit('">')
            ),
        ).otherwise(none),
        F.lit("</head><body>"),
        anchor(k + 1, k + 1 < n),
        anchor(2 * k + 1, 2 * k + 1 < n),
        anchor(2 * k + 2, 2 * k + 2 < n),
        anchor(parent, k > 0),
        F.when(
            k % 3 == 0,
            F.concat(
                F.lit('<a href="https://other.invalid/contact">x</a> <a href="mailto:hidden@'),
                host,
                F.lit('">m</a> '),
            ),
        ).otherwise(none),
        F.lit("<p> Write to "),
        F.when(k % 2 == 0, F.lit("INFO.")).otherwise(F.lit("info.")),
        (k % 7).cast("string"),
        F.lit("@"),
        host,
        F.lit(" </p></body></html>"),
    )
    return site(pages).select(
        "page_id",
        "host",
        "k",
        site_url(host, k).alias("url"),
        F.when(k % 13 == 12, 404).otherwise(200).alias("status"),
        html.alias("html"),
    )


def seeds(pages: DataFrame) -> DataFrame:
    """Four spellings of the first page of every host: ``seed_id, url, requested_at``."""
    first = (
        pages.select(
            "page_id", F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1).alias("host")
        )
        .groupBy("host")
        .agg(F.min("page_id").alias("page_id"))
    )
    host = F.col("host")
    spellings = F.array(
        F.concat(F.lit("https://"), host, F.lit("/p0")),
        F.concat(host, F.lit("/p0")),
        F.concat(F.lit("https://"), F.upper(host), F.lit("/p0/")),
        F.concat(F.lit("http://"), host, F.lit("/p0?x=1")),
    )
    return (
        first.select("page_id", F.posexplode(spellings).alias("spelling", "url"))
        .withColumn("seed_id", F.col("page_id") * 4 + F.col("spelling"))
        .select(
            "seed_id",
            "url",
            (as_of() + F.make_dt_interval(secs=F.col("seed_id"))).alias("requested_at"),
        )
    )


def scan_seeds(pages: DataFrame) -> DataFrame:
    """The seeds and, once each, all other pages of the hosts."""
    others = site(pages).filter("k > 0").select(
        (F.col("page_id") * 4).alias("seed_id"),
        site_url(F.col("host"), F.col("k")).alias("url"),
        (as_of() + F.make_dt_interval(secs=F.col("page_id") * 4)).alias("requested_at"),
    )
    return seeds(pages).unionByName(others)


def faulty_seeds(pages: DataFrame) -> DataFrame:
    """The given URLs, five of six spoilt in some way: ``seed_id, url``."""
    url, kind = F.col("url"), F.col("page_id") % 6
    return pages.select(
        F.col("page_id").alias("seed_id"),
        F.when(kind == 1, F.regexp_replace(url, "^https?://", ""))
        .when(kind == 2, F.lit(""))
        .when(kind == 3, F.regexp_replace(url, "://", "://bad host."))
        .when(kind == 4, F.lit("https://"))
        .when(kind == 5, F.concat(url, F.lit("#%zz")))
        .otherwise(url)
        .alias("url"),
    )


def snapshots(pages: DataFrame) -> DataFrame:
    """Every page, and for every third an older copy with a negative id."""
    older = pages.filter(F.col("page_id") % 3 == 0).select(
        (-F.col("page_id") - 1).alias("page_id"), "url", F.lit("<p>old</p>").alias("html")
    )
    return pages.select("page_id", "url", "html").unionByName(older)


def rewritten(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New results for two of three stored ones; every other of them is out of date."""
    records, _ = results(pages)
    number = F.substring("scan_id", 2, 20).cast("long")
    kept = records.filter(number % 3 < 2).select(
        "key",
        F.concat(F.lit("w"), F.substring("scan_id", 2, 20)).alias("scan_id"),
        (F.col("cached_at") + F.make_dt_interval(days=F.when(number % 3 == 0, 1).otherwise(-1)))
        .alias("cached_at"),
        F.lit(2).alias("depth"),
        F.lit(1).alias("pages_visited"),
        F.lit(1).alias("n_emails"),
    )
    return kept, kept.select("key", "scan_id", F.concat("scan_id", F.lit("@new.org")).alias("email"))


def results(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored results of every site page: records and their addresses."""
    base = site(pages).select(
        url_key(site_url(F.col("host"), F.col("k"))).alias("key"),
        F.concat(F.lit("r"), F.col("page_id").cast("string")).alias("scan_id"),
        (
            F.lit("2022-11-01 00:00:00").cast("timestamp")
            + F.make_dt_interval(days=(F.col("k") * 7).cast("int"))
        ).alias("cached_at"),
        "host",
        "k",
    )
    mails = F.when(F.col("k") % 10 == 9, F.array().cast("array<string>")).otherwise(
        F.filter(
            F.array(
                F.concat(F.lit("info."), (F.col("k") % 7).cast("string"), F.lit("@"), F.col("host")),
                F.when(F.col("k") % 2 == 0, F.concat(F.lit("office@"), F.col("host"))),
            ),
            lambda mail: mail.isNotNull(),
        )
    )
    records = base.select(
        "key",
        "scan_id",
        "cached_at",
        F.lit(3).alias("depth"),
        (F.col("k") + 1).cast("int").alias("pages_visited"),
        F.size(mails).alias("n_emails"),
    )
    emails = base.select("key", "scan_id", F.explode(mails).alias("email"))
    return records, emails


def requests(pages: DataFrame) -> DataFrame:
    """Request messages as JSON text, broken in various ways: ``request_id, body``."""
    kind = F.col("seed_id") % 8
    number = F.col("seed_id").cast("string")
    url = F.concat(
        F.lit('"url": "'),
        F.when(kind == 3, F.lit("")).otherwise(F.col("url")),
        F.when(kind == 5, F.lit("\\u0001")).otherwise(F.lit("")),
        F.lit('"'),
    )
    hook = F.concat(
        F.lit('"webhook_url": "http://hook.invalid'),
        F.when(kind == 7, F.lit(":x")).otherwise(F.lit("")),
        F.lit("/"),
        number,
        F.lit('"'),
    )
    callback = F.concat(F.lit('"callback_id": "cb-'), number, F.lit('"'))
    fields = F.concat_ws(
        ", ",
        F.when(kind != 2, url),
        F.when(kind != 4, hook),
        F.when(kind != 6, callback),
    )
    body = F.when(kind == 1, F.concat(F.lit("{"), url, F.lit(", "))).otherwise(
        F.concat(F.lit("{"), fields, F.lit("}"))
    )
    return seeds(pages).select(F.col("seed_id").alias("request_id"), body.alias("body"))


def job_events(events: DataFrame) -> DataFrame:
    """Job log: ``job_id, ts, seq, action``; one job per user and week."""
    ts = F.col("ts").cast("timestamp")
    rows = events.select(
        F.concat(
            F.col("user_id").cast("string"),
            F.lit("-"),
            F.date_format(F.date_trunc("week", ts), "yyyyMMdd"),
        ).alias("job_id"),
        ts.alias("ts"),
        F.col("event_id").alias("seq"),
        "event_type",
    )
    first = rows.groupBy("job_id").agg(F.min_by("seq", F.struct("ts", "seq")).alias("first"))
    return spread_join(rows, first, ["job_id"]).select(
        "job_id",
        "ts",
        "seq",
        F.when(F.col("seq") == F.col("first"), "enqueue")
        .when(F.col("event_type") == "purchase", "complete")
        .when(F.col("event_type") == "error", "fail")
        .when(F.col("event_type") == "click", "cancel")
        .otherwise("start")
        .alias("action"),
    )


def outcomes(events: DataFrame, pages: DataFrame) -> DataFrame:
    """Finished scans: ``job_id, url, webhook_url, callback_id, crawl_seconds``.

    The scanned page is the one numbered like the user, if there is one.
    """
    rows = events.select(
        F.concat(F.lit("job-"), F.col("event_id").cast("string")).alias("job_id"),
        F.col("user_id").alias("page_id"),
        "event_id",
        (F.col("value") * 10).alias("crawl_seconds"),
    )
    urls = site(pages).select("page_id", site_url(F.col("host"), F.col("k")).alias("known"))
    number = F.col("page_id").cast("string")
    return spread_join(rows, urls, ["page_id"], how="left").select(
        "job_id",
        F.when(F.col("event_id") % 50 == 49, F.concat(F.lit("https://bad host/"), number))
        .otherwise(F.coalesce("known", F.concat(F.lit("https://new.invalid/u"), number)))
        .alias("url"),
        F.when(F.col("event_id") % 4 == 3, F.lit(""))
        .otherwise(F.concat(F.lit("https://hook.invalid/"), number))
        .alias("webhook_url"),
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("cb-"), number)).alias("callback_id"),
        "crawl_seconds",
    )


def attempts(events: DataFrame) -> DataFrame:
    """Delivery log: ``job_id, attempt, http_status``; one message per user and day."""
    ts = F.col("ts").cast("timestamp")
    rows = events.select(
        F.concat(
            F.col("user_id").cast("string"), F.lit("-"), F.date_format(ts, "yyyyMMdd")
        ).alias("job_id"),
        ts.alias("ts"),
        F.col("event_id").alias("seq"),
        F.when(F.col("event_type") == "purchase", 200)
        .when(F.col("event_type") == "view", 204)
        .when(F.col("event_type") == "click", 302)
        .when(F.col("event_type") == "error", 500)
        .alias("http_status"),
    )
    numbered = Ordered(rows, ["job_id"], ["ts", "seq"]).running({"attempt": Total(F.lit(1))})
    return numbered.result().select(
        "job_id", F.col("attempt").cast("int").alias("attempt"), "http_status"
    )
