"""JSON forms of records and messages, and time arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from contactloom.functions.binding import let

# Field names of the JSON forms.
RESULT_JSON = (
    "emails array<string>, timestamp timestamp, crawl_info struct<depth: int, pages_visited: int>"
)
REQUEST_JSON = "url string, webhook_url string, callback_id string"
JOB_STATES = ("queued", "processing", "completed", "failed", "cancelled")


def to_record(*columns: Column) -> Column:
    """JSON text of a record; NULL fields are left out."""
    return F.to_json(F.struct(*columns))


def from_record(text: Column) -> Column:
    """Result record of a JSON text; NULL when the text is no JSON object of that shape.

    Fields may be missing or null, and so may the whole value; a field of another type makes
    the text unreadable.
    """

    def good(value: Column) -> Column:
        def kind(path: str) -> Column:
            part = F.schema_of_variant(F.try_variant_get(value, path, "variant"))
            return F.coalesce(part, F.lit("VOID"))

        whole, when = kind("$"), F.try_variant_get(value, "$.timestamp", "string")
        return (
            ((whole == "VOID") | whole.startswith("OBJECT"))
            & kind("$.emails").isin("VOID", "ARRAY<STRING>", "ARRAY<VOID>")
            & kind("$.timestamp").isin("VOID", "STRING")
            & (when.isNull() | F.try_to_timestamp(when).isNotNull())
            & ((kind("$.crawl_info") == "VOID") | kind("$.crawl_info").startswith("OBJECT"))
            & kind("$.crawl_info.depth").isin("VOID", "BIGINT")
            & kind("$.crawl_info.pages_visited").isin("VOID", "BIGINT")
        )

    readable = let(F.try_parse_json(text), lambda value: value.isNotNull() & good(value))
    return F.when(readable, F.from_json(text, RESULT_JSON, {"mode": "PERMISSIVE"}))


def elapsed_seconds(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / 1_000_000


def expires_at(written: Column, days: int) -> Column:
    return written + F.make_dt_interval(days=F.lit(days))


def duration_text(seconds: Column) -> Column:
    """Short text of a time span, for example ``396µs``, ``2.3s`` or ``1m30.5s``."""
    nanos = F.round(seconds * 1_000_000_000).cast("long")
    whole = F.floor(nanos / 1_000_000_000)

    def number(value: Column) -> Column:
        text = F.regexp_replace(value.cast("decimal(38, 9)").cast("string"), r"0+$", "")
        return F.regexp_replace(text, r"\.$", "")

    hours, minutes = F.floor(whole / 3600), F.floor(whole / 60) % 60
    rest = number((nanos % 60_000_000_000) / 1_000_000_000)
    return (
        F.when(nanos == 0, F.lit("0s"))
        .when(nanos < 1_000, F.concat(nanos.cast("string"), F.lit("ns")))
        .when(nanos < 1_000_000, F.concat(number(nanos / 1_000), F.lit("µs")))
        .when(nanos < 1_000_000_000, F.concat(number(nanos / 1_000_000), F.lit("ms")))
        .otherwise(
            F.concat(
                F.when(hours > 0, F.concat(hours.cast("string"), F.lit("h"))).otherwise(F.lit("")),
                F.when(whole >= 60, F.concat(minutes.cast("string"), F.lit("m"))).otherwise(
                    F.lit("")
                ),
                rest,
                F.lit("s"),
            )
        )
    )
