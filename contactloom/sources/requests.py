"""Requests as they come in: checks of start URLs, reading of JSON bodies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactloom.functions.binding import let
from contactloom.functions.records import REQUEST_JSON
from contactloom.functions.urls import default_scheme, is_parseable


def _missing(text: Column) -> Column:
    return F.coalesce(text, F.lit("")) == ""


def validate_seeds(seeds: DataFrame) -> DataFrame:
    """Add ``target``, the URL with its scheme, and ``error``, NULL if all is well."""
    target = default_scheme(F.col("url"))
    return seeds.withColumns(
        {
            # Error texts.
            "target": F.when(~_missing(F.col("url")), target),
            "error": F.when(_missing(F.col("url")), F.lit("Missing 'url' parameter")).when(
                ~is_parseable(target), F.lit("Invalid URL provided")
            ),
        }
    )


def parse_requests(df: DataFrame, body: str = "body") -> DataFrame:
    """Fields of JSON bodies and ``bad_json``; the fields are NULL where it is set.

    A body is bad if it is no JSON object or a field of it is not text.
    """
    fields = [field.split()[0] for field in REQUEST_JSON.split(", ")]
    # Within brackets, text after the end of the value is an error too.
    boxed = F.try_parse_json(F.concat(F.lit("["), F.col(body), F.lit("]")))

    def kind(value: Column, path: str) -> Column:
        return F.schema_of_variant(F.try_variant_get(value, path, "variant"))

    def is_good(value: Column) -> Column:
        whole = kind(value, "$[0]")
        good = kind(value, "$[1]").isNull() & (whole.startswith("OBJECT") | (whole == "VOID"))
        for name in fields:
            part = F.coalesce(kind(value, f"$[0].{name}"), F.lit("VOID"))
            good = good & part.isin("STRING", "VOID")
        return F.coalesce(good, F.lit(False))

    record = F.from_json(body, REQUEST_JSON)
    row = let(
        F.struct(boxed.alias("value"), record.alias("r")),
        lambda read: let(
            is_good(read["value"]),
            lambda good: F.struct(
                (~good).alias("bad_json"),
                *[F.when(good, read["r"][name]).alias(name) for name in fields],
            ),
        ),
    )
    # As a generated row the fields are read once, however often they are used later.
    return df.select("*", F.inline(F.array(row)))


def validate_requests(requests: DataFrame) -> DataFrame:
    """Add ``target`` and ``error``; the first failing check names the error.

    Of the webhook URL only the syntax is checked, so nearly any text passes.
    """
    url, webhook = F.col("url"), F.col("webhook_url")
    target = default_scheme(url)
    checks = F.coalesce(
        F.when(F.col("bad_json"), F.lit("Invalid JSON format")),
        F.when(_missing(url), F.lit("Missing 'url' field")),
        F.when(_missing(webhook), F.lit("Missing 'webhook_url' field")),
        F.when(~is_parseable(target), F.lit("Invalid URL format")),
        F.when(~is_parseable(webhook), F.lit("Invalid webhook_url format")),
    )
    return requests.withColumns(
        {"target": F.when(~_missing(url), target), "error": checks}
    )
