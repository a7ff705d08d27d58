"""Exact dedup, Merkle manifest and periodic runs against plain versions."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from contactloom.llm import exact, manifest, runs, spread
from pyspark.sql import functions as F


def _sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---------------------------------------------------------------- exact dedup


def _plain_exact(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[(text or "").translate(str.maketrans(exact._UPPER, exact._LOWER))].append(doc_id)
    out = []
    for doc_id, text in rows:
        norm = (text or "").translate(str.maketrans(exact._UPPER, exact._LOWER))
        ids = groups[norm]
        keep = max((i for i in ids if i is not None), default=None)
        out.append((doc_id, keep, len(ids), doc_id == keep, _sha(norm)))
    return sorted(out, key=str)


def _exact_rows(df):
    return sorted(
        ((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact.exact_duplicates(df).collect()),
        key=str,
    )


def test_filters_merge_without_loss():
    rng = np.random.default_rng(3)
    a = rng.integers(-(2**63), 2**63 - 1, 500, dtype=np.int64)
    b = np.concatenate([a[:100], rng.integers(-(2**63), 2**63 - 1, 300, dtype=np.int64), a[:7]])
    merged = exact.CountingQuotientFilter.of(a).merge(exact.CountingQuotientFilter.of(b))
    whole = exact.CountingQuotientFilter.of(np.concatenate([a, b]))
    assert np.array_equal(merged.quotients, whole.quotients)
    assert np.array_equal(merged.remainders, whole.remainders)
    assert np.array_equal(merged.counts, whole.counts)
    assert merged.count(int(a[0])) == 3 and merged.count(int(a[200])) == 1
    assert merged.counts.sum() == 907


def test_exact_dedup_on_odd_rows(odd, odd_rows):
    assert _exact_rows(odd) == _plain_exact([(r[0], r[1]) for r in odd_rows])


def test_exact_dedup_case_and_nulls(spark):
    rows = [(1, "Hello World"), (2, "hello world"), (3, "HELLO WORLD"), (4, "Héllo World"), (5, "HÉLLO world"),
            (None, "hello world"), (None, "alone"), (None, "twice"), (None, "twice"), (6, None), (7, "")]
    got = _exact_rows(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got == _plain_exact(rows)
    by_id = {r[0]: r for r in got if r[0] is not None}
    assert by_id[1][1:3] == (3, 4) and by_id[3][3] and not by_id[2][3]
    assert by_id[4][1] == 4 and by_id[6][1:3] == (7, 2)


def test_exact_dedup_hot_group_spread(spark, monkeypatch):
    """A group of a third of all rows, with the fingerprint table too large to broadcast."""
    monkeypatch.setattr(exact, "BROADCAST_ROWS", 0)
    rows = [(i, "the same text") for i in range(600)] + [(1000 + i, f"text {i % 700}") for i in range(1200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert _exact_rows(df) == _plain_exact(rows)


def test_spread_join_spreads_hot_keys(spark):
    rows = spark.range(3000).select((F.col("id") % 2 * F.col("id")).alias("k"), F.col("id"))
    keyed = spark.range(3000).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    hot = spread.hot_keys(rows.groupBy("k").count(), ["k"], "count", 3000)
    joined = spread.spread_join(rows, keyed, ["k"], hot)
    assert joined.count() == 3000
    assert joined.filter("v != k * 10").count() == 0


def test_exact_dedup_empty(empty):
    assert exact.exact_duplicates(empty).collect() == []


def test_op11_on_table(spark, sf_dir):
    got = exact.op11_exact_dedup(spark, sf_dir)
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert _exact_rows(spark.read.parquet(f"{sf_dir}/documents.parquet")) == _plain_exact([tuple(r) for r in rows])
    assert got.count() == len(rows)


# ---------------------------------------------------------------- Merkle manifest


def _h(*parts):
    return _sha("".join(parts))


def _field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def _leaf(r, text):
    return _h(_field(r["doc_id"]), _field(r["source"]), _field(r["lang"]), _field(r["n_chars"]), _field(text))


def _levels(hashes):
    levels = [hashes]
    while len(levels[-1]) > 1:
        cur = levels[-1]
        levels.append([_h(*cur[i : i + 3]) for i in range(0, len(cur), 3)])
    return levels


def _siblings(levels, i):
    out = []
    for level in levels[:-1]:
        b = i // 3 * 3
        out.append(("".join(level[b:i]), "".join(level[i + 1 : b + 3])))
        i //= 3
    return out


def _plain_manifest(rows, tamper):
    by = defaultdict(list)
    for r in rows:
        r["leaf"] = _leaf(r, r["text"])
        by[r["source"]].append(r)
    keys = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    subroots, info = [], {}
    for k in keys:
        group = sorted(by[k], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["leaf"]))
        levels = _levels([r["leaf"] for r in group])
        subroots.append(levels[-1][0])
        for i, r in enumerate(group):
            info[id(r)] = (_siblings(levels, i), levels[-1][0], len(subroots) - 1)
    top = _levels(subroots)
    out = []
    for r in rows:
        path, sub, rank = info[id(r)]
        path = path + _siblings(top, rank)
        h = _leaf(r, tamper(r))
        for left, right in path:
            h = _h(left, h, right)
        out.append((r["doc_id"], r["leaf"], sub, top[-1][0], _h("".join(a + b for a, b in path)), h))
    return sorted(out, key=str)


def _manifest_rows(df):
    got = manifest.manifest(df, F.when(F.col("doc_id") % 2 == 0, F.translate("text", "\n", "")).otherwise(F.col("text")))
    return sorted(
        ((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root) for r in got.collect()), key=str
    )


def _even_tamper(r):
    t = r["text"]
    return t.replace("\n", "") if r["doc_id"] is not None and r["doc_id"] % 2 == 0 and t is not None else t


def test_manifest_on_odd_rows(odd, odd_rows):
    rows = [dict(zip(["doc_id", "text", "lang", "source", "n_chars"], r[:5])) for r in odd_rows]
    assert _manifest_rows(odd) == _plain_manifest(rows, _even_tamper)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 28, 85])
def test_manifest_sizes_and_sources(spark, n):
    rnd = random.Random(n)
    rows = [
        {"doc_id": i, "source": rnd.choice([None, "a", "b", "é", "B"]), "lang": "en", "n_chars": i, "text": f"t\n{i}"}
        for i in range(n)
    ]
    df = spark.createDataFrame(
        [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in rows],
        "doc_id long, text string, lang string, source string, n_chars long",
    ).repartition(3)
    assert _manifest_rows(df) == _plain_manifest(rows, _even_tamper)


def test_manifest_versions_copy_only_the_path(spark):
    df = spark.createDataFrame([(i, "a\nb", "en", "s", 3) for i in range(10)],
                               "doc_id long, text string, lang string, source string, n_chars long")
    got = manifest.manifest(df, F.when(F.col("doc_id") == 4, F.lit("ab")).otherwise(F.col("text"))).collect()
    for r in got:
        assert len(r.copied) == len(r.path) + 1 and r.copied[0] == r.tampered_leaf
        assert (r.folded_root == r.root) == (r.doc_id != 4)


def test_manifest_empty(empty):
    assert manifest.manifest(empty).collect() == []


def test_op12_on_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = [r.asDict() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]

    def tamper(r):
        t = r["text"]
        even = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0
        return t.replace("\n", "") if even and t is not None else t

    want = _plain_manifest(docs, tamper)
    got = manifest.op12_merkle_manifest(spark, sf).collect()
    assert sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root) for r in got), key=str) == want
    assert all(r.verified == (r.folded_root == r.root) for r in got)


# ---------------------------------------------------------------- periodic runs


def _smallest_period(w):
    for q in range(1, len(w) + 1):
        if all(w[i] == w[i + q] for i in range(len(w) - q)):
            return q


def _plain_runs(w):
    n, out = len(w), set()
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            if w[i] == w[i + q]:
                j = i
                while j < n - q and w[j] == w[j + q]:
                    j += 1
                if j + q - i >= 2 * q and _smallest_period(w[i : j + q]) == q:
                    out.add((i, j + q - i, q))
                i = j
            else:
                i += 1
    return sorted(out)


def _next_smaller_suffix(x):
    """Lyndon array as the distance to the next smaller suffix (past the end smallest)."""
    n = len(x)
    suffixes = sorted(range(n), key=lambda i: list(x[i:]))
    rank = {i: r for r, i in enumerate(suffixes)}
    return [next((j for j in range(i + 1, n) if rank[j] < rank[i]), n) - i for i in range(n)]


def test_lyndon_grouping_against_next_smaller_suffix():
    rnd = random.Random(9)
    for _ in range(2000):
        x = np.array([rnd.randrange(rnd.randint(1, 4)) for _ in range(rnd.randint(1, 30))], dtype=np.int64)
        for order in (x, x.max() - x):
            assert runs.lyndon_array(order).tolist() == _next_smaller_suffix(order.tolist())


def test_runs_against_plain_search():
    rnd = random.Random(5)
    for _ in range(1500):
        n = rnd.randint(0, 45)
        w = [rnd.randrange(rnd.randint(1, 3)) for _ in range(n)]
        if n > 4 and rnd.random() < 0.4:
            a, p = rnd.randrange(n), rnd.randint(1, 5)
            w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
        assert (runs.runs(np.array(w, dtype=np.int64)) if n else []) == _plain_runs(w)


def test_texts_left_out_of_the_arrays_have_no_run():
    rnd = random.Random(12)
    for _ in range(400):
        n = rnd.randint(20, 90)
        w = [rnd.randrange(rnd.randint(2, 12)) for _ in range(n)]
        if rnd.random() < 0.6:
            a, p = rnd.randrange(n), rnd.randint(1, 12)
            w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
        want = [r for r in _plain_runs(w) if r[1] >= max(24, 3 * r[2])]
        if want:
            assert runs.may_hold_a_run(np.array(w, dtype=np.int64))
        got = runs.summary([str(v) for v in w])
        assert got["n_runs"] == len(want)
        assert got["runs_sha256"] == _sha("".join(f"{s},{l},{p}\n" for s, l, p in want))


def test_summary_of_a_planted_tail():
    words = [f"w{i}" for i in range(40)]
    # h = 10 * g: g = 13 gives a = 13, p = 1 + 27 // 8 = 4
    got = runs.summary(runs.planted(words, 130))
    assert (got["n_runs"], got["start"], got["length"], got["period"]) == (1, 13, 27, 4)
    assert got["exponent_milli"] == 6750
    assert got["runs_sha256"] == _sha("13,27,4\n")
    assert got["collapsed_sha256"] == _sha(" ".join(words[:17]))
    assert runs.planted(words, 131) == words and runs.planted(words, None) == words


def test_summary_ties_and_short_runs():
    # Two runs of equal exponent: the least start wins; a run shorter than 24 is no run.
    w = ["a"] * 30 + ["x"] + ["b"] * 30 + ["y"] + ["c", "d"] * 10
    got = runs.summary(w)
    assert got["n_runs"] == 2 and (got["start"], got["length"], got["period"]) == (0, 30, 1)
    assert got["collapsed_sha256"] == _sha(" ".join(["a", "x", "b", "y"] + ["c", "d"] * 10))
    empty = runs.summary([])
    assert empty["n_runs"] == 0 and empty["start"] is None and empty["runs_sha256"] == _sha("")


def test_periodic_runs_on_odd_rows(odd, odd_rows):
    got = runs.periodic_runs(odd).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in odd_rows)
    by_id = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by_id[4].n_words == 0 and by_id[4].collapsed_sha256 == _sha("") and by_id[4].start is None
    assert by_id[11].n_words == 1 and by_id[11].n_runs == 0
    assert by_id[10].n_words == 30_000
    def plain(doc_id, text):
        crc = None if doc_id is None else zlib.crc32(str(doc_id).encode())
        want = runs.summary(runs.planted(runs.words_of(text), crc))
        return doc_id, want["n_runs"], want["runs_sha256"], want["collapsed_sha256"]

    assert Counter((r.doc_id, r.n_runs, r.runs_sha256, r.collapsed_sha256) for r in got) == Counter(
        plain(d, t) for d, t, *_ in odd_rows
    )


def test_periodic_runs_empty(empty):
    assert runs.periodic_runs(empty).collect() == []


def test_op13_on_table(spark):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in runs.op13_periodic_runs(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    planted_rows = 0
    for d in docs:
        crc = zlib.crc32(str(d.doc_id).encode())
        words = runs.planted(runs.words_of(d.text), crc)
        planted_rows += crc % 10 == 0 and len(words) > 30
        if len(words) <= 400:
            ids = np.unique(np.array(words, dtype=object), return_inverse=True)[1] if words else []
            want = [r for r in _plain_runs(list(ids)) if r[1] >= max(24, 3 * r[2])]
            assert got[d.doc_id].n_runs == len(want)
    assert planted_rows > 0
