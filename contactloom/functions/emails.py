"""Finding and cleaning addresses; built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from contactloom.functions.urls import trim_blanks

# Fixed value: what counts as an address. There is no check of the top-level domain.
ADDRESS = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"

# The same matches in linear time: a local part is tried only where a run of its
# characters begins (or right after the last match) and is never given back.
_LINEAR = r"(?:\G|(?<![a-zA-Z0-9._%+-]))[a-zA-Z0-9._%+-]++@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"

# Numeric character references of the @ sign.
_AT_SIGN = r"&#(?:0*64(?![0-9])|[xX]0*40(?![0-9A-Fa-f]))"


def may_hold_email(html: Column) -> Column:
    """Cheap test that no page with an address in its text fails.

    An @ in the text needs an @ in the markup, or a reference to it. Plain substring tests
    come first; the pattern only sees pages with numeric references.
    """
    numeric = html.contains("&#") & html.rlike(_AT_SIGN)
    return html.contains("@") | html.contains("&commat") | numeric


def extract_emails(text: Column) -> Column:
    """All addresses in order of appearance, repeats included."""
    return F.when(
        text.contains("@"), F.regexp_extract_all(text, F.lit(_LINEAR), F.lit(0))
    ).otherwise(F.array().cast("array<string>"))


def lower_hits(hits: Column) -> Column:
    return F.transform(hits, F.lower)


def normalize_email(email: Column) -> Column:
    """Lower case, blanks at both ends removed."""
    return trim_blanks(F.lower(email))


def dedup_emails(emails: Column, enabled: bool = True) -> Column:
    """Normalised, without empties and repeats, sorted bytewise; unchanged if disabled."""
    if not enabled:
        return emails
    clean = F.filter(F.transform(emails, normalize_email), lambda email: email != "")
    return F.array_sort(F.array_distinct(clean))


def sort_emails(emails: Column) -> Column:
    return F.sort_array(emails)


def omit_empty(items: Column) -> Column:
    """NULL for an empty list, so that a JSON message leaves the field out."""
    return F.when(F.size(items) > 0, items)
