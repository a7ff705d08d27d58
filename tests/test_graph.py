"""Micro-sites and properties of the two walks."""

import random

import pytest
from pyspark.sql import functions as F

from contactloom.operators import graph, pages
from contactloom.operators.addresses import reach_emails
from contactloom.session import checkpointed, fixed_layout, stored

H = "https://h"


def link(*targets):
    return "".join(f'<a href="{t}">x</a>' for t in targets)


SITES = {
    "chain": ({f"/p{i}": link(f"/p{i + 1}") for i in range(5)}, ["/p0", "/p1", "/p2", "/p3"]),
    "contact chain": (
        {"/p0": link("/contact1"), **{f"/contact{i}": link(f"/contact{i + 1}") for i in range(1, 9)}},
        ["/p0", *[f"/contact{i}" for i in range(1, 10)]],
    ),
    "cycle": ({"/p0": link("/contact"), "/contact": link("/p0")}, ["/p0", "/contact"]),
    "order trap": (
        {
            "/p0": link("/p1", "/p4"), "/p1": link("/p2"), "/p2": link("/p3"),
            "/p3": link("/p4"), "/p4": link("/p5"),
        },
        ["/p0", "/p1", "/p2", "/p3", "/p4", "/p5"],
    ),
    "order trap 2": (
        {"/p0": link("/p1", "/p3"), "/p1": link("/p2"), "/p2": link("/p3"), "/p3": link("/p4")},
        ["/p0", "/p1", "/p2", "/p3", "/p4"],
    ),
    "two schemes": ({"/p0": link("http://h/p1")}, ["/p0", "http://h/p1"]),
    "other host": ({"/p0": link("https://www.h/p1", "https://h:443/x", "mailto:a@b.co")}, ["/p0"]),
    "fragment twin": (
        {"/p0": link("/p1", "/p1#x"), "/p1": "a@b.org", "/p1#x": "a@b.org"},
        ["/p0", "/p1", "/p1#x"],
    ),
    "refresh": (
        {
            "/p0": '<meta http-equiv="refresh" content="0; url=/p1">no@b.org' + link("/p2"),
            "/p1": "yes@b.org",
        },
        ["/p0", "/p1"],
    ),
    "refresh off-host": (
        {"/p0": '<meta http-equiv="refresh" content="0; url=https://o/">no@b.org'}, ["/p0"],
    ),
    "refresh without a URL": (
        {"/p0": '<meta http-equiv="refresh" content="30">yes@b.org'}, ["/p0"],
    ),
    "refresh loop": (
        {
            "/p0": '<meta http-equiv="refresh" content="0; url=/p1">no@b.org',
            "/p1": '<meta http-equiv="refresh" content="0; url=/p0">no@b.org',
        },
        ["/p0", "/p1"],
    ),
    "missing": ({"/p0": link("/p1", "/gone"), "/p1": "404 no@b.org" + link("/p2")}, ["/p0", "/p1", "/gone"]),
}
EXACT = {"order trap 2": ["/p0", "/p1", "/p2", "/p3"]}


def place(name, text):
    """Give every site a host of its own."""
    return text.replace("//h", f"//{name.replace(' ', '-')}.test")


def full(name, url):
    return place(name, url if url.startswith("http") else H + url)


@pytest.fixture(scope="module")
def content(spark):
    rows = [
        (full(name, url), 404 if html.startswith("404") else 200, place(name, html))
        for name, (site, _) in SITES.items()
        for url, html in site.items()
    ]
    pages_ = spark.createDataFrame(rows, "url string, status int, html string")
    return stored(pages.page_contents(pages_))


@pytest.fixture(scope="module")
def starts(spark):
    return spark.createDataFrame([(full(name, "/p0"),) for name in SITES], "start string")


def by_start(rows, field):
    found = {full(name, "/p0"): set() for name in SITES}
    for row in rows:
        found[row.start].add(row[field])
    return found


def test_sites(content, starts):
    edges = stored(pages.site_edges(content))
    reach = graph.crawl(starts, edges)
    expected = {
        full(name, "/p0"): {full(name, url) for url in urls} for name, (_, urls) in SITES.items()
    }
    assert by_start(reach.collect(), "url") == expected
    exact = graph.crawl_exact(starts, edges)
    expected |= {full(n, "/p0"): {full(n, url) for url in urls} for n, urls in EXACT.items()}
    assert by_start(exact.collect(), "url") == expected
    mails = by_start(reach_emails(reach, pages.page_emails(content)).collect(), "email")
    for name, (site, _) in SITES.items():
        wanted = {w for h in site.values() for w in ("a@b.org", "yes@b.org") if w in h}
        assert mails[full(name, "/p0")] == wanted, name


def test_bounds(content, starts):
    edges = stored(pages.site_edges(content))
    name = "order trap"
    depths = {r.url: r.depth for r in graph.crawl(starts, edges).collect()}
    assert (depths[full(name, "/p4")], depths[full(name, "/p5")]) == (1, 2)
    zero = by_start(graph.crawl(starts, edges, max_depth=0).collect(), "url")
    assert zero[full("chain", "/p0")] == {full("chain", "/p0")}
    assert len(zero[full("contact chain", "/p0")]) == 10
    assert graph.crawl(starts, edges, max_depth=-1).count() == 0


def shuffled_scans(plan, columns):
    """How many scans of the given columns have a shuffle between them and their first join."""
    path, found = [], 0
    for line in plan.splitlines():
        text = line.lstrip(" :+-*|")
        depth = len(line) - len(text)
        path = [(d, t) for d, t in path if d < depth] + [(depth, text)]
        if "Scan ExistingRDD" in text and all(f"{c}#" in text for c in columns):
            for _, above in reversed(path[:-1]):
                if "Join" in above:
                    break
                found += above.startswith("Exchange")
    return found


def test_no_round_shuffles_edges(spark, content, starts):
    """The plan of a round, with every page of the front busy, and nothing broadcast."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with fixed_layout(spark) as parts:
            edges = graph._laid_out(pages.site_edges(content).select("src", "dst", "cost"), parts)
            front = checkpointed(
                starts.select("start", F.col("start").alias("url"), F.lit(0).alias("depth"))
                .repartition(parts, "start", "url")
            )
            plans = [
                graph._next_steps(front, edges, rows, size)._jdf.queryExecution().executedPlan().toString()
                for rows, size in ((1, 1_000), (1_000_000, 10))
            ]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    for plan in plans:
        assert "Join" in plan
        assert shuffled_scans(plan, ("src", "dst", "cost")) == 0


def walk(start, links, bound):
    """The order of a person clicking: first link first, never the same page twice."""
    seen, todo = {}, [(start, 0)]
    while todo:
        page, depth = todo.pop()
        if depth > bound or page in seen:
            continue
        seen[page] = depth
        todo.extend((dst, depth + cost) for _, dst, cost in sorted(links.get(page, []), reverse=True))
    return seen


def test_walks_on_random_graphs(spark):
    rng = random.Random(7)
    rows, starts, links = [], [], {}
    for site in range(12):
        names = [f"https://s{site}/{'contact' if rng.random() < 0.3 else 'p'}{i}" for i in range(25)]
        starts += [names[0], names[1]]
        for name in names:
            for pos in range(rng.randrange(4)):
                dst = rng.choice(names)
                cost = 0 if "contact" in dst else 1
                rows.append((name, pos, dst, cost))
                links.setdefault(name, []).append((pos, dst, cost))
    edges = spark.createDataFrame(rows, "src string, pos int, dst string, cost int").cache()
    seeds = spark.createDataFrame([(s,) for s in starts], "start string")
    expected = {(s, u): d for s in starts for u, d in walk(s, links, 3).items()}
    exact = {(r.start, r.url): r.depth for r in graph.crawl_exact(seeds, edges, 3).collect()}
    assert exact == expected

    least = {(r.start, r.url): r.depth for r in graph.crawl(seeds, edges, 3).collect()}
    assert set(exact) <= set(least)
    assert all(least[k] <= d for k, d in exact.items())
    assert set(least) != set(exact)

    spread = graph.crawl(seeds.repartition(3), edges.orderBy(F.rand(1)), 3, rows=1)
    assert {(r.start, r.url): r.depth for r in spread.collect()} == least
    wider = {(r.start, r.url) for r in graph.crawl(seeds, edges, 4).collect()}
    assert set(least) <= wider

    with pytest.raises(graph.CrawlNotFinished):
        graph.crawl(seeds, edges, 3, max_rounds=1)
