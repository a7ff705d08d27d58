"""Operators on documents against plain versions and SQL."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import duckdb
import numpy as np
import pytest
from contactloom.llm import disclosure, edits, language, licenses, lines, minhash, mixing, toxicity
from contactloom.llm.components import components
from contactloom.llm.queries import ORACLES, QUERIES
from pyspark.sql import functions as F


@pytest.mark.parametrize("name", ORACLES)
def test_query_equals_its_sql(name, spark, sf_dir):
    db = duckdb.connect()
    for t in ("documents", "embeddings"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = db.sql(ORACLES[name]).df()
    got = QUERIES[name](spark, sf_dir).toPandas()
    names = sorted(want.columns)
    assert sorted(got.columns) == names
    plain = lambda df: df[names].astype(object).where(df[names].notna(), None).sort_values("doc_id")
    assert plain(got).values.tolist() == plain(want).values.tolist()


def test_lines_near_the_threshold_are_counted_exactly(spark):
    rows = [(i, f"on {n} sites\nown {i} {n}", f"s{i}") for n in range(1, 14) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    keys = {r.line for r in lines.boilerplate_lines(docs, min_sites=10).collect()}
    line = F.struct(F.xxhash64("t").alias("a"), F.hash("t").alias("b"))
    asked = spark.createDataFrame([(f"on {n} sites", n) for n in range(1, 14)], "t string, n int")
    assert {r.n for r in asked.select("n", line.alias("k")).collect() if r.k in keys} == {10, 11, 12, 13}


def test_texts_of_boilerplate_alone_stay(spark):
    rows = [(i, "all of it", f"s{i}") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert {(r.text, r.n_removed) for r in lines.drop_boilerplate(docs).collect()} == {("all of it", 0)}


def test_fingerprints_of_edited_and_next_texts(spark, sf_dir, texts):
    got = {r.doc_id: r for r in QUERIES["op2_edit_fingerprints"](spark, sf_dir).collect()}
    walks = edits.Walks()
    ids = sorted(texts, reverse=True)
    for i, own in enumerate(ids):
        text, after = texts[own], texts[ids[(i + 1) % len(ids)]]
        k = len(text) // 3
        edited = text[: len(text) - k] + after[:k]
        assert got[own].n_chars == len(text)
        assert got[own].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        if i % 25 == 0:
            a, b, c = edits.fingerprints([text, edited, after], walks)
            assert (got[own].fingerprint, got[own].edited_fingerprint) == (a, b)
            assert got[own].near_edited == walks.likeness(a, b)
            assert got[own].near_next == walks.likeness(a, c)
    assert np.mean([r.near_edited for r in got.values()]) > 0.6
    assert np.mean([r.near_next for r in got.values()]) < 0.05


def _plain_walk(walks, text):
    codes = np.array([ord(c) for c in text], np.uint32)
    step, out = 0, []
    for s in walks.symbols(codes).tolist():
        step += walks.stay_list[s + (step & 4095)]
        out.append(step)
    return walks.read(codes, np.array(out, np.int64)) if text else ""


def test_walks_side_by_side_equal_walks_one_by_one():
    draw = random.Random(1)
    some = ["".join(draw.choice("abcdé漢 ") for _ in range(draw.randint(0, 400))) for _ in range(150)]
    walks = edits.Walks()
    assert edits.fingerprints(some, walks) == [_plain_walk(walks, t) for t in some]


def test_bands_find_texts_of_few_edits(spark, texts):
    draw = random.Random(2)
    base = [t for t in texts.values() if len(t) > 1_500][:40]
    edited = []
    for t in base:
        chars = list(t)
        for _ in range(5):
            chars[draw.randrange(len(chars))] = draw.choice("abc")
        edited.append("".join(chars))
    prints = edits.fingerprints(base + edited, edits.Walks())
    table = spark.createDataFrame(list(enumerate(prints)), "doc_id long, fingerprint string")
    group = {r.doc_id: r.group_id for r in edits.near_texts(table).collect()}
    found = [group[i] == group[i + len(base)] for i in range(len(base))]
    # A walk at times takes long to fall into step again, so a few pairs do not verify.
    assert sum(found) >= 0.9 * len(base)
    walks = edits.Walks()
    alike = [walks.likeness(prints[i], prints[i + len(base)]) >= edits.LEAST for i in range(len(base))]
    assert all(f for f, a in zip(found, alike, strict=True) if a)


def test_toxicity_on_held_out_documents(spark, sf_dir):
    """On the largest tables of the three: a thousand documents have too few toxic ones to learn from."""
    documents, labels = (spark.read.parquet(f"{sf_dir}/../sf0.1/{t}.parquet") for t in ("documents", "labels"))
    net = toxicity.train(documents, labels)
    word = documents.filter("doc_id < 200").withColumn("text", F.concat("text", F.lit(" you idiot moron scum")))
    scored = toxicity.score_toxicity(documents, net).join(labels, "doc_id")
    wrong = scored.filter("held_out AND toxic = 0 AND predicted = 1").count()
    assert wrong <= 0.02 * scored.filter("held_out AND toxic = 0").count()
    told = toxicity.score_toxicity(word, net)
    assert told.filter("predicted = 1").count() >= 0.9 * told.count()


def test_network_gradient_equals_differences():
    draw = np.random.default_rng(4)
    texts = ["one two three four five six", "two two seven eight nine ten one"]
    words = toxicity.Words()
    codes, start, end, hashes, begin = words.split(texts)
    known, where, word_of = np.unique(hashes, return_index=True, return_inverse=True)
    net = toxicity.Network.fresh(known)
    net.w = {k: draw.standard_normal(v.shape) * 0.3 for k, v in net.w.items()}
    grams, gb = words.trigrams(codes, start[where], end[where])
    first, length, _ = toxicity.windows_of(begin)
    rows, valid = toxicity._window_words(first, length, word_of)
    rows = np.where(valid, rows, len(known))
    ids = net.word_ids(known)

    def logits(keep=False):
        x = net.inputs(ids, grams, gb)
        return net.forward(rows, valid, net.project(x), keep)

    logit, state = logits(True)
    x = net.inputs(ids, grams, gb)
    padded = np.concatenate((x, np.zeros((1, x.shape[1]), np.float32)))
    error = np.array([1.0, -0.5])
    grad = net.gradient(rows, valid, np.append(ids, len(known)), np.append(grams, 0), np.append(gb, gb[-1] + 1), error, state, padded)
    for name in ("h0", "x1", "a", "o", "b0"):
        at = tuple(draw.integers(0, n) for n in net.w[name].shape)
        step = 1e-2
        net.w[name][at] += step
        high = logits() @ error
        net.w[name][at] -= 2 * step
        low = logits() @ error
        net.w[name][at] += step
        assert grad[name][at] == pytest.approx((high - low) / (2 * step), rel=0.05, abs=2e-3)


def test_windows_overlap_and_cover_texts():
    begin = np.array([0, 0, 5, 29, 129])
    first, length, text = toxicity.windows_of(begin)
    for i in range(4):
        held = set()
        for f, n in zip(first[text == i], length[text == i], strict=True):
            held |= set(range(f, f + n))
        assert held == set(range(begin[i], begin[i + 1]))


def _targets(sizes, weights):
    total, out, open_ = sum(sizes.values()), {}, set(sizes)
    while open_:
        level = (total - sum(out.values())) / sum(weights[s] for s in open_)
        over = {s for s in open_ if level * weights[s] > 3 * sizes[s]}
        if not over:
            return out | {s: level * weights[s] for s in open_}
        for s in over:
            out[s] = 3 * sizes[s]
        open_ -= over
    return out


def _highest_quotients(weights, seats):
    won = Counter({k: 0 for k in weights})
    for _ in range(seats):
        won[max(weights, key=lambda k: (weights[k] / (2 * won[k] + 1), -k))] += 1
    return won


def test_mix_meets_targets(spark):
    draw = random.Random(5)
    sizes = {"b": 3_000, "a": 90_000, None: 500, "c": 20_000, "d": 100}
    rows = []
    for source, left in sizes.items():
        while left > 0:
            n = min(left, draw.randint(1, 900))
            rows.append((len(rows), "w " * n, source))
            left -= n
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_sources(docs, shard_words=10_000)
    table = got.join(docs.select("doc_id", "source"), "doc_id").toPandas()
    order = ["a", "b", "c", "d", None]
    want = _targets(sizes, {s: i % 3 + 1 for i, s in enumerate(order)})
    for s in order:
        own = table[table.source.isna() if s is None else table.source == s]
        assert own.target.iloc[0] == pytest.approx(want[s])
        assert own["size"].sum() == sizes[s] == own.source_size.iloc[0]
        assert abs(own.taken.sum() - want[s]) <= 200 + 0.02 * want[s]
    assert (table.taken <= 3 * table["size"]).all() and (table.taken >= 0).all()
    again = mixing.mix_sources(docs.repartition(5), shard_words=10_000).toPandas()
    assert dict(zip(again.doc_id, again.taken, strict=True)) == dict(zip(table.doc_id, table.taken, strict=True))


def test_apportionment_equals_seat_by_seat(spark):
    draw = random.Random(6)
    rows = [(g, i, draw.choice([0, 1, 5, 40, 300]), (g + 1) * 37) for g in range(4) for i in range(15)]
    items = spark.createDataFrame(rows, "g int, i int, w long, seats long")
    got = defaultdict(dict)
    for r in mixing.sainte_lague(items, ["g"], ["i"], "w", "seats").collect():
        got[r.g][r.i] = r.quota
    for g in range(4):
        own = {i: w for h, i, w, _ in rows if h == g}
        assert got[g] == dict(_highest_quotients(own, (g + 1) * 37))


_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _luhn(digits):
    doubled = [int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(digits[::-1])]
    return sum(doubled) % 10 == 0


def _plain_spans(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [("email", *m.span()) for m in _EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in _CARD.finditer(text) if 13 <= len(digits(m)) <= 19 and _luhn(digits(m))]
    return out + [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(digits(m)) <= 15]


def test_base_spans_equal_plain_patterns(texts):
    draw = random.Random(7)
    for _ in range(20_000):
        text = "".join(draw.choice("a.@-+1 203(4)é%\n") for _ in range(draw.randint(0, 30)))
        assert disclosure.base_spans(text) == _plain_spans(text)
    for text in texts.values():
        assert disclosure.base_spans(text) == _plain_spans(text)


def test_spans_of_all_documents(spark, sf_dir, texts):
    for r in QUERIES["op5_personal_data"](spark, sf_dir).collect():
        base = ",".join(f"{k}:{a}:{b}" for k, a, b in _plain_spans(texts[r.doc_id]))
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert r.spans.startswith(base)


def test_terms_that_reveal_an_entity(spark):
    rows = [(i, f"note {i} number{i} ask zorblax today at boss@corp.example.com {i} thanks") for i in range(8)]
    rows += [(100 + i, f"plain text {i} about today and thanks for all") for i in range(60)]
    rows += [(200, "Zorblax was here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in disclosure.personal_spans(docs).collect()}
    assert got[200].spans == "term:0:7"
    assert "term" not in got[100].spans and got[0].n_email == 1
    text = {r.doc_id: r.text for r in disclosure.sanitise(docs).collect()}
    assert "orblax" not in text[200] and "<email>" in text[0] and "corp" not in text[0]
    assert text[100] == rows[8][1]


def test_one_document_can_reveal_an_entity(spark):
    rows = [(0, "please ask Quillon today at boss@corp.example.com thanks")]
    rows += [(1 + i, "please ask today thanks for all") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in disclosure.personal_spans(docs).collect()}
    assert got[0].spans == "email:28:49,term:11:18" and got[0].n_term == 1
    assert all(got[i].n_term == 0 for i in range(1, 301))


def test_language_of_held_out_documents(documents):
    got = language.identify(documents, language.train(documents)).join(documents, "doc_id").toPandas()
    fold = [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]
    assert got.held_out.tolist() == fold
    held = got[got.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.98
    assert got.score.between(0, 1).all()


def test_equal_texts_are_told_alike_wherever_they_lie(spark, documents):
    model = language.train(documents)
    rows = [(i, t) for i, t in enumerate(["a", "é", "ab", "der die das", "x" * 50] * 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = defaultdict(set)
    for r in language.identify(docs, model).collect():
        got[rows[r.doc_id][1]].add((r.lang_pred, round(r.score, 6)))
    assert all(len(v) == 1 for v in got.values())


def test_licence_spellings_and_copyright_lines(spark):
    known = spark.createDataFrame([("L", "Licence to the organisation\nand non-commercial use")], "license_id string, text string")
    docs = spark.createDataFrame(
        [
            (1, "Copyright (c) 2021 A. Person\n\nLICENSE to the organization,\nand NONCOMMERCIAL use!"),
            (2, "License to nobody"),
        ],
        "doc_id long, text string",
    )
    got = {r.doc_id: r.license_id for r in licenses.scan_licenses(docs, known).collect()}
    assert got == {1: "L", 2: None}


def _plain_groups(texts, percent=85):
    sets, root = {}, {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    held = defaultdict(list)
    for i, text in texts.items():
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", low)
        several = {tuple(words[j : j + 5]) for j in range(len(words) - 4)}
        sets[i] = several if len(words) >= 5 else {tuple(words)} if words else set()
        for s in sets[i]:
            held[s].append(i)
    common = Counter()
    for ids in held.values():
        for i in ids:
            for j in ids:
                if i < j:
                    common[i, j] += 1
    for (i, j), n in common.items():
        if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return {i: (len(sets[i]), find(i)) for i in texts}


def test_near_duplicates_equal_all_pairs(spark, sf_dir, texts):
    want = _plain_groups(texts)
    got = {r.doc_id: r for r in QUERIES["op10_minhash"](spark, sf_dir).collect()}
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def test_families_just_below_and_above_the_threshold(spark):
    """Copies of one text with many and few changes, so that buckets hold several components."""
    draw = random.Random(8)
    base = [f"w{draw.randrange(5_000)}" for _ in range(150)]
    texts = {}
    for i in range(120):
        words = list(base)
        for _ in range(i % 12):
            words[draw.randrange(len(words))] = f"n{draw.randrange(10**6)}"
        texts[i] = " ".join(words)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs).collect()}
    assert got == _plain_groups(texts)


def test_pipeline_keeps_one_of_each_group_at_its_own_threshold(spark, sf_dir):
    """Pairs from below 0.80 to above 0.85; the stage keeps what all pairs at 0.80 keep."""
    draw = random.Random(18)
    texts = {}
    for i in range(200):
        words = [f"w{draw.randrange(10**6)}" for _ in range(204)]
        texts[2 * i] = " ".join(words)
        # Each changed word, far from the others, changes five of 200 shingles.
        for k in range(2 + i % 4):
            words[20 + 30 * k] = f"n{draw.randrange(10**6)}"
        texts[2 * i + 1] = " ".join(words)
    want = {i for i, (_, group) in _plain_groups(texts, percent=corpus_pipeline.NEAR_PERCENT).items() if i == group}
    above = {i for i, (_, group) in _plain_groups(texts).items() if i == group}
    assert corpus_pipeline.NEAR_PERCENT == 80 and len(want) < len(above) < len(texts)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.without_near_copies(spark, docs, sf_dir).collect()} == want


def test_estimate_is_near_the_similarity(spark):
    draw = random.Random(9)
    rows = []
    for i in range(30):
        common = [f"c{draw.randrange(10**6)}" for _ in range(300)]
        rows += [(2 * i, " ".join(common)), (2 * i + 1, " ".join(common[:270] + [f"d{j}" for j in range(30)]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sigs = {r.doc_id: r.signature for r in minhash.sign(docs).collect()}
    pairs = spark.createDataFrame([(sigs[2 * i], sigs[2 * i + 1]) for i in range(30)], "a array<long>, b array<long>")
    est = [r[0] for r in pairs.select(minhash.estimated_similarity(F.col("a"), F.col("b"), minhash.BANDS * minhash.ROWS, minhash.BITS)).collect()]
    want = [r["n_shingles"] for r in minhash.near_duplicates(docs).filter("doc_id < 2").collect()]
    assert want == [296, 296]
    assert np.mean(est) == pytest.approx(266 / 326, abs=0.03)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(50, 50), (7, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in range(100, 130)} == {100}
    assert 50 not in got
