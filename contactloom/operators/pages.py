"""From page markup to addresses and links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactloom.functions.emails import extract_emails, lower_hits, may_hold_email
from contactloom.functions.html import parse_page
from contactloom.functions.urls import (
    canonical_url,
    link_cost,
    parse_meta_refresh,
    resolve_url,
    url_host,
)
from contactloom.sources.pages import ok_pages


def parse_pages(pages: DataFrame, *carried: str, mail_only: bool = True) -> DataFrame:
    """Read every fetched page once: ``url, body, hrefs, target`` and ``carried`` columns.

    ``target`` is where a page refresh leads, if it names a usable URL. With
    ``mail_only`` bodies without an ``@`` are empty.
    """
    parsed = ok_pages(pages).select(
        canonical_url(F.col("url")).alias("url"),
        parse_page(F.col("html"), mail_only=mail_only).alias("page"),
        *carried,
    )
    return parsed.filter(F.col("url").isNotNull()).select(
        "url",
        F.col("page.body").alias("body"),
        F.col("page.hrefs").alias("hrefs"),
        parse_meta_refresh(F.col("page.refresh"), F.col("url")).alias("target"),
        *carried,
    )


def page_contents(pages: DataFrame, *carried: str) -> DataFrame:
    """What a crawl needs of a page: ``url, hits, hrefs, target``.

    A page that is left by a refresh gives neither addresses nor links of its own.
    """
    own = F.col("target").isNull()
    return parse_pages(pages, *carried).select(
        "url",
        F.when(own, lower_hits(extract_emails(F.col("body"))))
        .otherwise(F.array().cast("array<string>"))
        .alias("hits"),
        F.when(own, F.col("hrefs")).otherwise(F.array().cast("array<string>")).alias("hrefs"),
        "target",
        *carried,
    )


def split_redirects(parsed: DataFrame) -> DataFrame:
    """Pages that are left by a refresh, with the target."""
    return parsed.filter(F.col("target").isNotNull()).select("url", "target")


def page_links(contents: DataFrame) -> DataFrame:
    """Links in document order: ``src, pos, href, dst, kind``; unparseable ones dropped."""
    moved = F.col("target").isNotNull()
    return (
        contents.select(
            F.col("url").alias("src"),
            F.when(moved, F.lit("refresh")).otherwise(F.lit("link")).alias("kind"),
            F.posexplode(F.when(moved, F.array("target")).otherwise(F.col("hrefs"))).alias(
                "pos", "href"
            ),
        )
        .withColumn(
            "dst",
            F.when(F.col("kind") == "refresh", F.col("href")).otherwise(
                resolve_url(F.col("src"), F.col("href"))
            ),
        )
        .filter(F.col("dst").isNotNull())
        .select("src", "pos", "href", "dst", "kind")
    )


def same_host(links: DataFrame) -> DataFrame:
    """Links that stay on the host of their page; port and case count, the scheme does not."""
    return links.filter(url_host(F.col("src")) == url_host(F.col("dst")))


def site_edges(contents: DataFrame) -> DataFrame:
    """The link graph a crawl may walk: ``src, pos, dst, cost``."""
    return same_host(page_links(contents)).select(
        "src", "pos", "dst", link_cost(F.col("dst"), F.col("kind")).alias("cost")
    )


def page_emails(contents: DataFrame) -> DataFrame:
    """Distinct addresses per page: ``url, email``."""
    return contents.select("url", F.explode(F.array_distinct("hits")).alias("email"))


def mail_pages(pages: DataFrame, *carried: str) -> DataFrame:
    """Contents of only those pages whose markup may hold an address.

    The test runs in the scan stage; all other pages never reach Python.
    """
    return page_contents(pages.filter(may_hold_email(F.col("html"))), *carried)


def email_hits(contents: DataFrame) -> DataFrame:
    """Address matches per host, repeats counted."""
    return (
        contents.groupBy(url_host(F.col("url")).alias("host"))
        .agg(F.sum(F.size("hits")).cast("long").alias("hits"))
        .filter(F.col("hits") > 0)
    )


def page_preview(parsed: DataFrame) -> DataFrame:
    """First 200 characters of the body on one line, and the number of matches."""
    return parsed.filter(F.col("target").isNull()).select(
        "url",
        F.translate(F.substring("body", 1, 200), "\n", " ").alias("preview"),
        F.size(extract_emails(F.col("body"))).alias("hits"),
    )
