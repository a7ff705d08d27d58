"""URL functions as Column expressions; nothing here leaves the JVM.

A URL that cannot be parsed gives NULL. The canonical text of a URL is its identity:
lower-case scheme, host as written, query and fragment kept, characters that are not
legal in a path or fragment percent-encoded.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from contactloom.functions.binding import let
from contactloom.functions.keywords import shortest_words

# scheme, authority, path, query with its mark, fragment with its mark. Without a
# scheme, three slashes start a path; with one, they mean an empty authority.
_SPLIT = (
    r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?"
    r"(//(?!/)[^/?#]*|(?<=:)//)?([^?#]*)(\?[^#]*)?(#.*)?$"
)
_UNRESERVED = r"A-Za-z0-9\-_.~"
_PATH_LEGAL = _UNRESERVED + r"!$&'()*+,;=:@\[\]%/"
_PATH_KEPT = _UNRESERVED + r"$&+,/:;=@"
_FRAGMENT_LEGAL = _PATH_LEGAL + "?"
_FRAGMENT_KEPT = _PATH_KEPT + r"?!()*"
_HOST_KEPT = _UNRESERVED + r"!$&'()*+,;=:\[\]<>" + '"'
_BAD_HOST = rf"[\x00-\x7F&&[^{_HOST_KEPT}%]]|%(?!25|[89A-Fa-f][0-9A-Fa-f])"
_BRACKETED = r"^\[[^\]]*\](?::[0-9]*)?\z"
_BAD_PORT = r":[^:]*[^0-9:][^:]*\z"
_USERINFO = rf"^[{_UNRESERVED}!$&'()*+,;=:%@]*$"
_CONTROL = r"[\x00-\x1F\x7F]"
_BAD_ESCAPE = r"%(?![0-9A-Fa-f]{2})"
_DOT_SEGMENT = r"(?:^|/)\.\.?(?:/|$)"
# The same in a whole URL or link, where the path may be followed by a query or fragment.
_DOT_IN_LINK = r"(?:^|/)\.\.?(?:/|$|[?#])"
_BLANKS = r"[\x09-\x0D\x85\p{Z}]+"

# URLs that are their own canonical text, and links that only need the origin put in
# front. Nearly all URLs are of these two forms and skip the general way.
_PLAIN_PATH = _UNRESERVED + r"!$&'()*+,;=:@/"
_PLAIN_URL = (
    r"^https?://[A-Za-z0-9.\-_]+(?::[0-9]+)?"
    rf"(?:/[{_PLAIN_PATH}]*)?(?:\?[^#\x00-\x1F\x7F]*)?(?:#[{_PLAIN_PATH}]+)?\z"
)
_PLAIN_LINK = rf"^/(?!/)[{_PLAIN_PATH}]*\z"
_REST = 1 << 30


def trim_blanks(text: Column) -> Column:
    """Strip all Unicode blanks from both ends (SQL ``trim`` strips spaces only)."""
    return F.regexp_replace(text, rf"^{_BLANKS}|{_BLANKS}\z", "")


def default_scheme(url: Column) -> Column:
    """Put ``https://`` in front unless the text starts with http:// or https://."""
    return F.when(url.rlike("^https?://"), url).otherwise(F.concat(F.lit("https://"), url))


def _pieces(url: Column) -> Column:
    """Raw parts of a URL or URL reference; ``opaque`` marks forms such as ``mailto:x``."""
    authority = F.substring(F.regexp_extract(url, _SPLIT, 2), 3, _REST)
    path = F.regexp_extract(url, _SPLIT, 3)
    scheme = F.regexp_extract(url, _SPLIT, 1)
    rooted = F.regexp_extract(url, _SPLIT, 2) != ""
    return F.struct(
        url.alias("text"),
        F.lower(scheme).alias("scheme"),
        rooted.alias("rooted"),
        F.regexp_extract(authority, r"(?s)^(.*@)", 1).alias("user"),
        F.regexp_extract(authority, r"(?s)([^@]*)$", 1).alias("host"),
        path.alias("path"),
        F.regexp_extract(url, _SPLIT, 4).alias("query"),
        F.regexp_extract(url, _SPLIT, 5).alias("fragment"),
        ((scheme != "") & ~rooted & ~path.startswith("/")).alias("opaque"),
    )


def _well_formed(url: Column) -> Column:
    """Whether the pieces make up the syntax of a URL or URL reference."""
    colon_first = (url["scheme"] == "") & ~url["rooted"] & url["path"].rlike(r"^[^/]*:")
    path = F.when(url["opaque"], F.lit("")).otherwise(url["path"])
    return (
        ~url["text"].rlike(_CONTROL)
        & ~colon_first
        & ~F.concat(path, url["fragment"], url["user"]).rlike(_BAD_ESCAPE)
        & ~url["host"].rlike(_BAD_HOST)
        & F.when(url["host"].startswith("["), url["host"].rlike(_BRACKETED)).otherwise(
            ~url["host"].rlike(_BAD_PORT)
        )
        & url["user"].rlike(_USERINFO)
    )


def is_parseable(url: Column) -> Column:
    """Whether the text has the syntax of a URL or URL reference."""
    return url.rlike(_PLAIN_URL) | let(_pieces(url), _well_formed)


def _reescape(text: Column, kept: str) -> Column:
    """Decode and encode again: only ``kept`` characters stay as they are."""
    tokens = F.regexp_extract_all(
        text, F.lit(rf"%[0-9A-Fa-f]{{2}}|[{kept}]+|[^{kept}%]+"), F.lit(0)
    )

    def encode(token: Column) -> Column:
        letter = F.char(F.conv(F.substring(token, 2, 2), 16, 10).cast("int"))
        escaped = F.replace(
            F.replace(F.url_encode(token), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")
        )
        return (
            F.when(
                token.startswith("%"),
                F.when(token.rlike("^%[0-7]") & letter.rlike(f"^[{kept}]$"), letter).otherwise(
                    F.upper(token)
                ),
            )
            .when(token.rlike(f"^[{kept}]"), token)
            .otherwise(escaped)
        )

    return F.array_join(F.transform(tokens, encode), "")


def _escaped(text: Column, legal: str, kept: str) -> Column:
    return F.when(text.rlike(f"^[{legal}]*\\z"), text).otherwise(_reescape(text, kept))


def _ready(url: Column) -> Column:
    """The pieces in canonical form; an empty fragment disappears."""
    fragment = F.substring(url["fragment"], 2, _REST)
    return F.struct(
        url["scheme"].alias("scheme"),
        url["user"].alias("user"),
        F.when(url["host"].rlike(r"^[\x21-\x7E]*\z"), url["host"])
        .otherwise(_reescape(url["host"], _HOST_KEPT))
        .alias("host"),
        F.when(url["opaque"], url["path"])
        .otherwise(_escaped(url["path"], _PATH_LEGAL, _PATH_KEPT))
        .alias("path"),
        url["query"].alias("query"),
        F.when(fragment == "", fragment)
        .otherwise(F.concat(F.lit("#"), _escaped(fragment, _FRAGMENT_LEGAL, _FRAGMENT_KEPT)))
        .alias("fragment"),
        url["opaque"].alias("opaque"),
    )


def _assemble(scheme: Column, url: Column, path: Column) -> Column:
    """Text of an absolute URL, given its canonical pieces and its final path."""
    slash = F.when((path != "") & ~path.startswith("/"), F.lit("/")).otherwise(F.lit(""))
    authority = F.when(url["opaque"], F.lit("")).otherwise(
        F.concat(F.lit("//"), url["user"], url["host"], slash)
    )
    return F.concat(scheme, F.lit(":"), authority, path, url["query"], url["fragment"])


def canonical_url(url: Column) -> Column:
    """Identity of a page; NULL when the text cannot be parsed."""

    def general(parts: Column) -> Column:
        return F.when(
            _well_formed(parts),
            let(_ready(parts), lambda own: _assemble(own["scheme"], own, own["path"])),
        )

    return F.when(url.rlike(_PLAIN_URL), url).otherwise(let(_pieces(url), general))


def url_host(url: Column) -> Column:
    """Host with port, without user part, case kept; empty where there is none."""
    return F.regexp_extract(
        url, r"^(?:(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//)(?:[^/?#]*@)?([^/?#@]*)", 1
    )


def decode_path(path: Column) -> Column:
    """Percent-decoded path; a plus sign stays a plus sign."""
    return F.when(~path.contains("%"), path).otherwise(
        F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    )


def url_path(url: Column) -> Column:
    """Decoded path."""
    return F.when(
        url.rlike(_PLAIN_URL), F.regexp_extract(url, r"^[a-z]+://[^/?#]*([^?#]*)", 1)
    ).otherwise(
        let(
            _pieces(url),
            lambda parts: F.when(parts["opaque"], F.lit("")).otherwise(decode_path(parts["path"])),
        )
    )


def url_parts(url: Column) -> Column:
    """Struct of scheme, host, decoded path, query and fragment; NULL if unparseable."""

    def named(parts: Column) -> Column:
        return F.when(
            _well_formed(parts),
            F.struct(
                parts["scheme"].alias("scheme"),
                parts["host"].alias("host"),
                F.when(parts["opaque"], F.lit(""))
                .otherwise(decode_path(parts["path"]))
                .alias("path"),
                F.substring(parts["query"], 2, _REST).alias("query"),
                decode_path(F.substring(parts["fragment"], 2, _REST)).alias("fragment"),
            ),
        )

    return let(_pieces(url), named)


def _without_dots(path: Column) -> Column:
    """Resolve ``.`` and ``..`` segments of a path."""

    def step(kept: Column, segment: Column) -> Column:
        return (
            F.when(segment == ".", kept)
            .when(segment == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0))))
            .otherwise(F.concat(kept, F.array(segment)))
        )

    kept = F.aggregate(F.split(path, "/", -1), F.array().cast("array<string>"), step)
    tail = F.when(path.rlike(r"(?:^|/)\.\.?\z"), F.lit("/")).otherwise(F.lit(""))
    return F.regexp_replace(F.concat(F.lit("/"), F.array_join(kept, "/"), tail), "^//", "/")


def _tidy_path(path: Column) -> Column:
    return (
        F.when(path.rlike(_DOT_SEGMENT), _without_dots(path))
        .when((path == "") | path.startswith("/"), path)
        .otherwise(F.concat(F.lit("/"), path))
    )


def _resolve(base: Column, ref: Column) -> Column:
    """The general way, on the raw pieces of ``base`` and the canonical ones of ``ref``."""
    absolute = (ref["scheme"] != "") | (ref["host"] != "")
    same_page = (ref["path"] == "") & (ref["query"] == "")
    path = (
        F.when(absolute | ref["path"].startswith("/"), ref["path"])
        .when(ref["path"] == "", base["path"])
        .otherwise(F.concat(F.regexp_extract(base["path"], r"^(.*/)", 1), ref["path"]))
    )
    tidy = F.when(ref["opaque"], path).otherwise(let(path, _tidy_path))
    scheme = F.when(ref["scheme"] != "", ref["scheme"]).otherwise(base["scheme"])
    relative = F.concat(
        base["scheme"],
        F.lit("://"),
        base["user"],
        base["host"],
        tidy,
        F.when(same_page, base["query"]).otherwise(ref["query"]),
        F.when(same_page & (ref["fragment"] == ""), base["fragment"]).otherwise(ref["fragment"]),
    )
    return F.when(absolute, _assemble(scheme, ref, tidy)).otherwise(relative)


def resolve_url(base: Column, ref: Column) -> Column:
    """``ref`` as seen from the page ``base`` (a canonical URL), in canonical form."""
    dotted = ref.rlike(_DOT_IN_LINK)

    def general(parts: Column) -> Column:
        both = F.struct(_pieces(base).alias("base"), _ready(parts).alias("ref"))
        resolved = let(both, lambda pair: _resolve(pair["base"], pair["ref"]))
        return F.when(_well_formed(parts), resolved)

    return (
        F.when(
            ref.rlike(_PLAIN_LINK) & ~dotted,
            F.concat(F.regexp_extract(base, r"^([a-z][^:/?#]*://[^/?#]*)", 1), ref),
        )
        .when(ref.rlike(_PLAIN_URL) & ~dotted, ref)
        .otherwise(let(_pieces(ref), general))
    )


def is_contact_path(path: Column) -> Column:
    """Whether a decoded path holds one of the contact words, anywhere in it."""
    return F.lower(path).rlike("|".join(re.escape(word) for word in shortest_words()))


def link_cost(url: Column, kind: Column | None = None) -> Column:
    """Depth spent by following a link: none for contact pages and page refreshes."""
    free = is_contact_path(url_path(url))
    if kind is not None:
        free = free | (kind == "refresh")
    return F.when(free, F.lit(0)).otherwise(F.lit(1))


def refresh_candidates(content: Column) -> Column:
    """URL texts of a refresh directive, in order; the part before the first ; never counts."""
    parts = F.transform(F.split(content, ";", -1), trim_blanks)
    later = F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1)))
    marked = F.filter(later, lambda part: F.lower(F.substring(part, 1, 4)) == "url=")
    return F.transform(marked, lambda part: trim_blanks(F.substring(part, 5, 1 << 30)))


def parse_meta_refresh(content: Column, base: Column) -> Column:
    """Target of a refresh directive, or NULL when none of its parts gives a URL."""
    resolved = F.transform(refresh_candidates(content), lambda ref: resolve_url(base, ref))
    return F.get(F.filter(resolved, lambda url: url.isNotNull()), F.lit(0))


def url_key(url: Column) -> Column:
    """Hash under which the result of a URL is kept.

    Lower-case host and decoded path, one closing slash removed; scheme, user part,
    query and fragment do not count. Escapes are decoded byte by byte, so paths that
    are no valid UTF-8 keep distinct keys. Unparseable text is hashed as it is.
    """
    simple_path = F.regexp_extract(url, r"^[a-z]+://[^/?#]*([^?#]*?)/?(?:[?#].*)?\z", 1)

    def general(parts: Column) -> Column:
        tokens = F.regexp_extract_all(
            parts["path"], F.lit("%[0-9A-Fa-f]{2}|[^%]+"), F.lit(0)
        )
        path_hex = F.array_join(
            F.transform(
                tokens,
                lambda token: F.when(
                    token.startswith("%"), F.upper(F.substring(token, 2, 2))
                ).otherwise(F.hex(token)),
            ),
            "",
        )
        whole = F.concat(F.hex(F.lower(decode_path(parts["host"]))), path_hex)
        return (
            F.when(~_well_formed(parts), F.sha2(parts["text"], 256))
            .when(parts["opaque"], F.sha2(F.lit(""), 256))
            .otherwise(F.sha2(F.unhex(F.regexp_replace(whole, "2F$", "")), 256))
        )

    return F.when(
        url.rlike(_PLAIN_URL), F.sha2(F.concat(F.lower(url_host(url)), simple_path), 256)
    ).otherwise(let(_pieces(url), general))


def url_key_raw(url: Column, compat: bool = False) -> Column:
    """Key of a URL that may lack its scheme, as given to invalidation.

    By default the scheme is put in first, so both spellings share a key. With
    ``compat`` the text is taken as it is: the host is then part of the path and keeps
    its case, and ``host:port`` reads as a scheme with an empty path.
    """
    return url_key(url if compat else default_scheme(url))
