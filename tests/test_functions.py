"""Golden cases of the column functions."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from contactloom.functions import emails as E
from contactloom.functions import html as H
from contactloom.functions import urls as U
from contactloom.functions.keywords import CONTACT_WORDS, shortest_words

BASE = "https://Ex.com/a/b?q=1#f"


def column(spark, values, build, kind="string"):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"i int, v {kind}").repartition(2)
    return [r.out for r in df.select("i", build(F.col("v")).alias("out")).orderBy("i").collect()]


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def test_default_scheme(spark):
    got = column(spark, ["ex.com", "http://ex.com", "HTTP://ex.com"], U.default_scheme)
    assert got == ["https://ex.com", "http://ex.com", "https://HTTP://ex.com"]


RESOLVED = {
    "/x": "https://Ex.com/x",
    "x": "https://Ex.com/a/x",
    "../x": "https://Ex.com/x",
    "../../../x": "https://Ex.com/x",
    "./x/./y/..": "https://Ex.com/a/x/",
    "/a/../b/.": "https://Ex.com/b/",
    "//h.org/p": "https://h.org/p",
    "//h.org": "https://h.org",
    "#top": "https://Ex.com/a/b?q=1#top",
    "": "https://Ex.com/a/b?q=1#f",
    "?z": "https://Ex.com/a/b?z",
    "?": "https://Ex.com/a/b?",
    "#": "https://Ex.com/a/b?q=1#f",
    "HTTP://Other.com/Y": "http://Other.com/Y",
    "http://o.com": "http://o.com",
    "/%zz": None,
    "x%": None,
    "1:2": None,
    ":x": None,
    "/a b": "https://Ex.com/a%20b",
    "/ü": "https://Ex.com/%C3%BC",
    "/%c3%bc": "https://Ex.com/%c3%bc",
    "/%2f b*": "https://Ex.com//%20b%2A",
    "/%e9 x": "https://Ex.com/%E9%20x",
    "/a|b": "https://Ex.com/a%7Cb",
    "/a\nb": None,
    "http://h:x/": None,
    "http://h:80/": "http://h:80/",
    "http://a b/": None,
    "http://[::1]:8/p": "http://[::1]:8/p",
    "http://u:p@h/x": "http://u:p@h/x",
    "/x#a b": "https://Ex.com/x#a%20b",
    "/x#%zz": None,
    "/x?%zz y": "https://Ex.com/x?%zz y",
    "///x": "https://Ex.com///x",
    "https://h/a/..?x=1": "https://h/?x=1",
    "https://h/a/.#f": "https://h/a/#f",
    "http://ü.de/x": "http://%C3%BC.de/x",
}


def test_resolve(spark):
    got = column(spark, list(RESOLVED), lambda c: U.resolve_url(F.lit(BASE), c))
    assert dict(zip(RESOLVED, got, strict=True)) == RESOLVED


def test_opaque_links_have_no_host(spark):
    refs = ["mailto:a@b.co", "javascript:x", "tel:1", "https:foo"]
    got = column(spark, refs, lambda c: U.url_host(U.resolve_url(F.lit(BASE), c)))
    assert got == [""] * 4


def test_resolve_on_bare_host(spark):
    got = column(spark, ["x", "", "/x"], lambda c: U.resolve_url(F.lit("https://h"), c))
    assert got == ["https://h/x", "https://h", "https://h/x"]


KEYS = {
    "https://Ex.com/": "ex.com",
    "http://ex.com?x=1": "ex.com",
    "https://ex.com/#a": "ex.com",
    "https://u@ex.com/": "ex.com",
    "https://ex.com/A//": "ex.com/A/",
    "https://ex.com:8080/x": "ex.com:8080/x",
    "https://ex.com/a+b": "ex.com/a+b",
    "https://ex.com/%C3%BC": "ex.com/ü",
    "https://ex.com/caf%E9": b"ex.com/caf\xe9",
    "https://ex.com/caf%E8": b"ex.com/caf\xe8",
    "https://ex.com/x%2F": "ex.com/x",
    "https://ex.com/%zz": "https://ex.com/%zz",
    "https://": "",
    "https:///x": "/x",
}


def test_key(spark):
    got = column(spark, list(KEYS), U.url_key)
    assert dict(zip(KEYS, got, strict=True)) == {k: sha(v) for k, v in KEYS.items()}


def test_raw_key(spark):
    urls = ["example.com/x", "Example.com/x", "example.com:8080/x"]
    assert column(spark, urls, U.url_key_raw) == [
        sha("example.com/x"), sha("example.com/x"), sha("example.com:8080/x"),
    ]
    assert column(spark, urls, lambda c: U.url_key_raw(c, compat=True)) == [
        sha("example.com/x"), sha("Example.com/x"), sha(""),
    ]


def test_parts(spark):
    urls = ["HTTPS://u:p@Ex_1.com:8/a%20b|c?x=1#y", "a\x01b"]
    got = column(spark, urls, U.url_parts)
    assert tuple(got[0]) == ("https", "Ex_1.com:8", "/a b|c", "x=1", "y")
    assert got[1] is None


CONTACT = {
    "https://h/Contact": True, "https://h/de/IMPRESSUM": True, "https://h/über-uns": True,
    "https://h/%C3%BCber-uns": True, "https://h/sometimes": True, "https://h/wirtschaft": True,
    "https://h/information": True, "https://h/": False, "https://h/products": False,
    "https://h/x?page=contact": False,
}


def test_contact_path(spark):
    got = column(spark, list(CONTACT), lambda c: U.is_contact_path(U.url_path(c)))
    assert dict(zip(CONTACT, got, strict=True)) == CONTACT
    assert len(CONTACT_WORDS) == len(set(CONTACT_WORDS)) == 79
    assert len(shortest_words()) == 59


REFRESH = {
    "0; url=/x": "https://h/x",
    "0;URL= /x ": "https://h/x",
    "30": None,
    "url=/x": None,
    "0; url = /x": None,
    "0; foo; url=/x": "https://h/x",
    "0; url=/x;y": "https://h/x",
    "0; url='/x'": "https://h/'/x'",
    "0; url=": "https://h/a",
    "0; url=/%zz; url=/y": "https://h/y",
}


def test_meta_refresh(spark):
    got = column(spark, list(REFRESH), lambda c: U.parse_meta_refresh(c, F.lit("https://h/a")))
    assert dict(zip(REFRESH, got, strict=True)) == REFRESH


BODIES = {
    "<p>A@B.com, c@d.org.</p>": ["a@b.com", "c@d.org"],
    "<table><td>a@b.com</td><td>Call</td>": ["a@b.comcall"],
    "a&#64;b.com": ["a@b.com"],
    "a&commat;b.com": ["a@b.com"],
    '<a href="mailto:x@y.zz">mail</a>': [],
    '<p title="x>a@b.com">t</p>': [],
    "<!-- a@b.com -->": [],
    "<!--> a@b.com -->": ["a@b.com"],
    '<body><script>"a@b.com<b>"</script>': ["a@b.com"],
    "<body><noscript><b>a@b.com</b></noscript>": ["a@b.com"],
    '<head><script>"a@b.com"</script></head><body>x': [],
    "<title>a@b.com</title><body>x": [],
    "<body><title>a@b.com</title>": ["a@b.com"],
    "logo@2x.png": ["logo@2x.png"],
    "a@b.c a@b @b.com": [],
    "ü.x@b.com": [".x@b.com"],
    "a@b.com_x@y.org": ["a@b.com", "_x@y.org"],
    "a@b.com@c.org": ["a@b.com"],
    "<body>text a@b.com and no end": ["a@b.com"],
    "x</body></html> a@b.com": ["a@b.com"],
    "1 < 2 a@b.com": ["a@b.com"],
    "a@b.com<i": ["a@b.com"],
    "": [],
}


def test_page_mails(spark):
    build = lambda c: E.lower_hits(E.extract_emails(H.body_text(c)))
    got = column(spark, list(BODIES), build)
    assert dict(zip(BODIES, got, strict=True)) == BODIES


def test_mail_filter_keeps_every_hit(spark):
    kept = column(spark, list(BODIES), E.may_hold_email)
    assert all(flag for flag, mails in zip(kept, BODIES.values(), strict=True) if mails)


def test_links_and_refresh(spark):
    page = (
        "<head><META http-equiv=Refresh content='1'><meta http-equiv='refresh' content='0; url=/n'>"
        "<noscript><a href=/no></noscript></head><A HREF='/a?x=1&amp;y=2&copy=3'>1</a>"
        '<a name=q>2</a><a href>3</a><a title="<a href=/q>" href = /b >4</a><!--<a href=/c>-->'
        '<script>"<a href=/d>"</script><a href="/e" href="/f"/>5<area href=/g><a href="/cut'
    )
    (row,) = column(spark, [page], H.parse_page)
    assert row.hrefs == ["/a?x=1&y=2&copy=3", "", "/b", "/e"]
    assert row.refresh == "0; url=/n"
    assert row.body == '1234"<a href=/d>"5'


def test_text_after_marks_that_are_no_tags_is_kept():
    page = "<body>one</é>two <ö>three a@b.com <a href=/k>four"
    text, links, _ = H.read_page(page)
    assert "two" in text and "four" in text and links == ["/k"]


def test_long_runs_stay_linear(spark):
    text = "a" * 300_000 + " x@y.org"
    assert column(spark, [text], E.extract_emails) == [["x@y.org"]]
    assert H.read_page("<a " + "x=" * 100_000)[1] == []


def test_dedup(spark):
    mails = [[" A@b.co\n", "a@b.co", "", "Z@z.zz", "0@z.zz", " q@z.zz"], []]
    got = column(spark, mails, E.dedup_emails, "array<string>")
    assert got == [["0@z.zz", "a@b.co", "q@z.zz", "z@z.zz"], []]
    assert column(spark, mails, lambda c: E.dedup_emails(c, False), "array<string>") == mails
    assert column(spark, mails, E.omit_empty, "array<string>") == [mails[0], None]


@pytest.mark.parametrize("build", [U.canonical_url, U.url_key, U.is_contact_path])
def test_no_python_in_url_plans(spark, build):
    df = spark.range(1).select(build(F.col("id").cast("string")))
    assert "Python" not in df._jdf.queryExecution().toString()


def test_addresses_like_the_plain_pattern(spark):
    """The linear pattern finds what a scan with the plain one finds."""
    rng = random.Random(2)
    texts = ["".join(rng.choices("aB9._%+-@@.. \nü", k=rng.randrange(1, 60))) for _ in range(3000)]
    texts += ["a@b.co@c.dd@e.ff", "x.@y.zz%q@a.bcd-e@f.gh", "a@b.com_x@y.org"]
    plain = re.compile(E.ADDRESS)
    assert column(spark, texts, E.extract_emails) == [plain.findall(t) for t in texts]


def test_body_text_of_all_pages(spark, sf_dir):
    """Against plain text replacement, whole texts."""
    import duckdb

    from contactloom.plans.oracles import _BODY

    path = f"{sf_dir}/pages.parquet"
    texts = duckdb.sql(f"WITH pages AS (FROM '{path}'), {_BODY} SELECT page_id, body FROM text")
    df = spark.read.parquet(path).select("page_id", H.body_text(F.col("html")).alias("body"))
    assert {r.page_id: r.body for r in df.collect()} == dict(texts.fetchall())


def test_reader_survives_any_markup():
    rng = random.Random(4)
    pieces = ["<", ">", "</", "a", " href=", '"', "'", "<!--", "-->", "<script>", "</script>", "&amp",
              "<body>", "<meta http-equiv=refresh content='0;url=/x'>", "x@y.org", "/", "=", "<textarea>",
              "<template>", "</template>", "<noscript>", "\n", "<frameset>", "<plaintext>"]
    for _ in range(3000):
        page = "".join(rng.choices(pieces, k=rng.randrange(30)))
        body, hrefs, refresh = H.read_page(page)
        assert isinstance(body, str) and all(isinstance(h, str) for h in hrefs)
        assert refresh is None or refresh


def test_pages_are_parsed_in_slices_of_bounded_size(monkeypatch):
    import pyarrow as pa

    from contactloom.functions import html

    monkeypatch.setattr(html, "SLICE_BYTES", 1_000)
    markup = ["<p>" + "x" * n + "</p>" for n in (300, 300, 300, 5_000, 10, 0)] + [None, ""]
    slices = list(html._slices(pa.array(markup)))
    assert [page for part in slices for page in part.to_pylist()] == markup
    assert all(len(part) == 1 or part.nbytes < 1_200 for part in slices) and len(slices) == 3
    assert [len(part) for part in html._slices(pa.array([], pa.string()))] == [0]
