"""One pass over the markup of a page, batch-wise in Arrow.

Built-in expressions cannot follow HTML (quoted attributes, raw-text elements,
character references), so this is the one place where rows visit Python.
"""

from __future__ import annotations

import html as markup
import re
import sys
from collections.abc import Iterator
from html import entities

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

# Ship the parser with the job, so that executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Markup that is held as Python text at a time.
SLICE_BYTES = 1_000_000
PARSED = "struct<body: string, hrefs: array<string>, refresh: string>"
_ARROW = [pa.string(), pa.list_(pa.string()), pa.string()]

_TAG = re.compile(
    r"""</?([a-zA-Z][^ \t\n\f\r/>]*+)"""
    r"""((?:[ \t\n\f\r/]++|[^ \t\n\f\r/>=][^ \t\n\f\r/>=]*+(?:[ \t\n\f\r]*+=[ \t\n\f\r]*+"""
    r"""(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^ \t\n\f\r>"'][^ \t\n\f\r>]*+|(?=>)))?+|=)*+)>"""
)
_NAME_START = re.compile(r"/?[a-zA-Z]")
_ATTRIBUTE = re.compile(
    r"""([^ \t\n\f\r/>=][^ \t\n\f\r/>=]*)"""
    r"""(?:[ \t\n\f\r]*=[ \t\n\f\r]*(?:"([^"]*)"|'([^']*)'|([^ \t\n\f\r>]+)))?"""
)
_COMMENT = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))", re.DOTALL)
_BOGUS = re.compile(r"<(?:[!?]|/[^a-zA-Z>])[^>]*(?:>|\Z)|</>")
_REFERENCE = re.compile(r"&(#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*)(;|(?![=A-Za-z0-9]))")

# Elements whose content is text up to their end tag, and whether references count in it.
_RAW_TEXT = {
    "script": False, "style": False, "xmp": False, "iframe": False, "noembed": False,
    "noframes": False, "noscript": False, "title": True, "textarea": True,
}
_RAW_END = {name: re.compile(rf"</{name}(?=[ \t\n\f\r/>])", re.IGNORECASE) for name in _RAW_TEXT}
# Elements that stay in the head while no body has begun.
_HEAD_ONLY = {
    "html", "head", "title", "style", "script", "noscript", "noframes",
    "meta", "link", "base", "basefont", "bgsound", "template",
}


def _value(text: str) -> str:
    """Attribute value with its character references decoded."""

    def decode(match: re.Match) -> str:
        name = match[1]
        if name[0] != "#" and name + match[2] not in entities.html5:
            return match[0]
        return markup.unescape(match[0])

    return _REFERENCE.sub(decode, text) if "&" in text else text


def _attributes(text: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, double, single, bare in _ATTRIBUTE.findall(text):
        found.setdefault(name.lower(), double or single or bare)
    return found


def read_page(page: str) -> tuple[str, list[str], str | None]:
    """Body text, link targets in document order, content of the first refresh tag."""
    texts: list[str] = []
    hrefs: list[str] = []
    refresh: str | None = None
    in_body = False
    templates = 0
    at, end = 0, len(page)

    def add(text: str, references: bool = True) -> None:
        nonlocal in_body
        if not in_body and not templates and text.strip(" \t\n\f\r"):
            in_body = True
        if in_body:
            texts.append(markup.unescape(text) if references and "&" in text else text)

    while at < end:
        mark = page.find("<", at)
        if mark < 0:
            add(page[at:])
            break
        if mark > at:
            add(page[at:mark])
        following = page[mark + 1 : mark + 3]
        if _NAME_START.match(following):
            tag = _TAG.match(page, mark)
            if tag is None:  # the page ends inside a tag
                break
            at = tag.end()
            name = tag[1].lower()
            if following[0] == "/":
                templates -= name == "template" and templates > 0
                continue
            if name == "frameset" and not in_body:
                break
            if not in_body and not templates and name not in _HEAD_ONLY:
                in_body = True
            if name == "a":
                link = _attributes(tag[2]).get("href")
                if link is not None:
                    hrefs.append(_value(link))
            elif name == "meta" and refresh is None:
                attributes = _attributes(tag[2])
                if _value(attributes.get("http-equiv", "")) == "refresh":
                    refresh = _value(attributes.get("content", ""))
            elif name == "template":
                templates += 1
            elif name == "plaintext":
                add(page[at:], references=False)
                break
            if name in ("pre", "listing", "textarea") and page.startswith("\n", at):
                at += 1
            if name in _RAW_TEXT:
                closing = _RAW_END[name].search(page, at)
                stop = closing.start() if closing else end
                if in_body and stop > at:
                    add(page[at:stop], references=_RAW_TEXT[name])
                at = stop
        else:
            other = _COMMENT.match(page, mark) or _BOGUS.match(page, mark)
            if other is None:
                add("<")
                at = mark + 1
            else:
                at = other.end()
    return "".join(texts), hrefs, refresh or None


def _slices(pages: pa.Array) -> Iterator[pa.Array]:
    """Runs of pages of about ``SLICE_BYTES`` of markup; a longer page is a run of its own."""
    sizes = pc.fill_null(pc.binary_length(pages), 0).to_pylist()
    begin = held = 0
    for at, size in enumerate(sizes):
        if at > begin and held + size > SLICE_BYTES:
            yield pages.slice(begin, at - begin)
            begin, held = at, 0
        held += size
    yield pages.slice(begin)


def _parse(pages: pa.Array, body_if: str) -> pa.Array:
    bodies, links, refreshes = [], [], []
    for page in pages.to_pylist():
        body, hrefs, refresh = read_page((page or "").replace("\r\n", "\n").replace("\r", "\n"))
        bodies.append(body if body_if in body else "")
        links.append(hrefs)
        refreshes.append(refresh)
    columns = [pa.array(c, type=t) for c, t in zip((bodies, links, refreshes), _ARROW, strict=True)]
    return pa.StructArray.from_arrays(columns, names=["body", "hrefs", "refresh"])


def parse_page(page: Column, mail_only: bool = False) -> Column:
    """Struct of body text, hrefs and refresh content of a page.

    With ``mail_only`` a body without any ``@`` comes back empty, which spares the
    way back from Python for most text. Pages are read and sent back in slices, so what Python
    holds beside a batch of Arrow does not depend on the number of pages in it.
    """
    body_if = "@" if mail_only else ""

    @F.arrow_udf(PARSED)
    def parse(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for pages in _slices(batch):
                yield _parse(pages, body_if)

    return parse(page)


def body_text(page: Column) -> Column:
    """Text below ``body``, joined without separators, script text included."""
    return parse_page(page)["body"]


def page_hrefs(page: Column) -> Column:
    """``href`` of every link in document order."""
    return parse_page(page, mail_only=True)["hrefs"]


def meta_refresh(page: Column) -> Column:
    """Content of the first refresh tag, or NULL."""
    return parse_page(page, mail_only=True)["refresh"]
