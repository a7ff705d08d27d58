import math
import tracemalloc
from collections import Counter
from pathlib import Path

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from contactloom.llm import mixing, pieces, vectors
from contactloom.session import shared_dir
from pyspark.sql import functions as F


def _plain_links(ids, labels, unit, least=0.93):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = Counter()
    for a in range(len(ids)):
        near = np.flatnonzero((unit @ unit[a] >= least) & (labels == labels[a]))
        for b in near[near > a]:
            links[ids[a]] += 1
            links[ids[b]] += 1
            p, q = sorted((find(ids[a]), find(ids[b])))
            root[q] = p
    return links, {i: find(i) for i in ids}


def test_forest_recall_and_counts(spark):
    draw = np.random.default_rng(3)
    centres = draw.standard_normal((60, 32))
    x = np.concatenate([centres[draw.integers(0, 60, 900)] + 0.12 * draw.standard_normal((900, 32)), draw.standard_normal((900, 32))])
    x[5] = x[6]
    labels = draw.integers(0, 3, len(x))
    rows = [(int(i), x[i].tolist(), int(labels[i])) for i in draw.permutation(len(x))]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    links, root = _plain_links(list(range(len(x))), labels, unit)
    got = vectors.near_vectors(table, leaf=150).collect()
    assert all(r.n_links <= links[r.vec_id] for r in got)
    assert sum(r.n_links for r in got) >= 0.97 * sum(links.values())
    whole = {r.vec_id: r for r in vectors.near_vectors(table).collect()}
    assert {i: (r.n_links, r.component_id) for i, r in whole.items()} == {i: (links[i], root[i]) for i in root}


def test_groups_of_many_leaves_keep_all_links(spark):
    """A cluster of twenty leaves, one of which only near vectors link, beside others of the label."""
    draw = np.random.default_rng(4)
    a, b = draw.standard_normal((2, 32))
    x = np.concatenate(
        [a + 0.2 * draw.standard_normal((2_000, 32)), b + 0.28 * draw.standard_normal((600, 32)), draw.standard_normal((400, 32))]
    )
    x[7] = x[8]
    labels = np.where(np.arange(len(x)) % 50 == 0, 1, 0)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(int(i), x[i].tolist(), int(labels[i])) for i in draw.permutation(len(x))]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    links, root = _plain_links(list(range(len(x))), labels, unit)
    got = {r.vec_id: r for r in vectors.near_vectors(table, leaf=100).collect()}
    assert all(r.n_links <= links[i] for i, r in got.items())
    assert all(got[i].n_links == links[i] for i in range(2_000) if labels[i] == 0)
    assert all(got[i].component_id == root[i] for i in range(2_000) if labels[i] == 0)
    assert sum(r.n_links for r in got.values()) >= 0.99 * sum(links.values())


def _clusters(spark, kind):
    """Groups of near vectors beside others, in two labels: the table, and its links and least members."""
    draw = np.random.default_rng(5)
    centres = draw.standard_normal((300, 48))
    x = np.concatenate([centres[draw.integers(0, 300, 3_000)] + 0.15 * draw.standard_normal((3_000, 48)), draw.standard_normal((3_000, 48))])
    x = x.astype(np.float32)
    labels = draw.integers(0, 2, len(x))
    unit = x / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    rows = [(int(i), x[i].tolist(), int(labels[i])) for i in draw.permutation(len(x))]
    table = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int")
    return table, *_plain_links(list(range(len(x))), labels, unit)


@pytest.mark.parametrize("kind", ["float", "double"])
def test_branches_count_each_link_once(spark, kind):
    """Nodes that no task may hold are split by all; pairs that meet in several branches and trees count once."""
    table, links, root = _clusters(spark, kind)
    got = {r.vec_id: r for r in vectors.near_vectors(table, leaf=100, branch_bytes=48 * 8 * 450).collect()}
    assert len(got) == len(root) and sum(links.values()) > 10_000
    assert all(r.n_links <= links[i] and r.component_id >= root[i] for i, r in got.items())
    assert sum(r.n_links for r in got.values()) >= 0.99 * sum(links.values())


def _on_disk(spark):
    folders = [shared_dir(spark), *spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()]
    folders = [Path(str(x).removeprefix("file:")) for x in folders]
    return sum(f.stat().st_size for x in folders for f in x.rglob("*") if f.is_file() and "broadcast" not in f.name)


def test_forest_keeps_little_on_disk(spark, tmp_path, monkeypatch):
    """Tables and shuffles of the forest take up a few times the vectors at any time, whatever the levels and trees."""
    table, _, _ = _clusters(spark, "float")
    table.repartition(2).write.parquet(f"{tmp_path}/embeddings")
    size = sum(f.stat().st_size for f in tmp_path.rglob("*.parquet"))
    partitions, keep, seen = spark.conf.get("spark.sql.shuffle.partitions"), vectors.stored, []
    spark._jvm.System.gc()
    before = _on_disk(spark)

    def stored(df):
        out = keep(df)
        seen.append(_on_disk(spark) - before)
        return out

    monkeypatch.setattr(vectors, "stored", stored)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        vectors.near_vectors(spark.read.parquet(f"{tmp_path}/embeddings"), leaf=100, branch_bytes=48 * 8 * 450)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
    assert len(seen) > 10 and max(seen) < 4 * size, [round(x / size, 2) for x in seen]


def _paths(vocabulary, text):
    known = {p: i for i, p in enumerate(vocabulary.pieces) if vocabulary.scores[i] is not None}
    text, out = "▁" + text.replace(" ", "▁"), []

    def go(at, ids, score):
        if at == len(text):
            out.append((tuple(ids), score))
        for n in range(1, 17):
            if at + n <= len(text) and text[at : at + n] in known:
                i = known[text[at : at + n]]
                go(at + n, [*ids, i], score + vocabulary.scores[i])

    go(0, [], 0.0)
    top = max(s for _, s in out)
    total = sum(math.exp(s - top) for _, s in out)
    return {ids: math.exp(s - top) / total for ids, s in out}


@pytest.mark.parametrize("text", ["to a", "then", "a be"])
def test_samples_come_without_replacement(text):
    vocabulary = pieces.load()
    sampler = pieces.Sampler(vocabulary)
    chance, n = _paths(vocabulary, text), 6_000
    got = sampler.sample([text] * n, np.arange(n, dtype=np.uint64), 2)
    first = Counter(tuple(own[0][0].tolist()) for own in got)
    second = Counter(tuple(own[1][0].tolist()) for own in got)
    for path, p in chance.items():
        after = sum(q * p / (1 - q) for other, q in chance.items() if other != path)
        assert first[path] / n == pytest.approx(p, abs=0.03)
        assert second[path] / n == pytest.approx(after, abs=0.03)
    # Chances over inclusion chances add up to one on average.
    weights = [sum(math.exp(s[1] - s[3]) for s in own) for own in got]
    assert np.mean(weights) == pytest.approx(1, abs=0.05)
    assert all(own[0][2] > own[1][2] and own[0][0].tolist() != own[1][0].tolist() for own in got)
    assert own_chance(got[0][0], chance)


def own_chance(sample, chance):
    return sample[1] == pytest.approx(math.log(chance[tuple(sample[0].tolist())]), abs=1e-4)


def test_all_segmentations_when_few():
    vocabulary = pieces.load()
    sampler = pieces.Sampler(vocabulary)
    chance = _paths(vocabulary, "to")
    got = sampler.sample(["to"], np.array([3], np.uint64), 50)[0]
    assert {tuple(s[0].tolist()) for s in got} == set(chance)
    assert all(s[3] == 0 for s in got)


def test_sampler_hashes_its_vocabulary_at_once(monkeypatch):
    vocabulary, mixed, calls = pieces.load(), pieces.mixed, []
    monkeypatch.setattr(pieces, "mixed", lambda x: calls.append(len(x)) or mixed(x))
    sampler = pieces.Sampler(vocabulary)
    assert len(calls) < 10
    assert (np.diff(sampler.hashes.astype(object)) > 0).all()
    for i in [i for i, s in enumerate(vocabulary.scores) if s is not None][::500]:
        piece = vocabulary.pieces[i]
        sums = sampler._sums(np.array([ord(c) for c in piece], np.uint32))
        assert sampler.ids[np.searchsorted(sampler.hashes, sums[-1])] == i
        assert sampler.begins[(sums[1:] % np.uint64(pieces._FILTER)).astype(np.int64)].all()
    some = np.array([0, 1, 2**63, 2**64 - 1, 123456789], np.uint64)
    assert [pieces._mixed_int(int(x)) for x in some] == mixed(some).tolist()


def test_samples_do_not_depend_on_neighbours(texts):
    vocabulary = pieces.load()
    some = list(texts.values())[:20]
    one = pieces.Sampler(vocabulary).sample(some, np.arange(20, dtype=np.uint64), 3)
    for i in (0, 7, 19):
        alone = pieces.Sampler(vocabulary).sample([some[i]], np.array([i], np.uint64), 3)[0]
        assert [s[0].tolist() for s in alone] == [s[0].tolist() for s in one[i]]


def test_samples_do_not_depend_on_slices(monkeypatch, odd_rows):
    some = [r[1] for r in odd_rows if r[1] and set(r[1]) != {"x"}]
    seeds = np.arange(len(some), dtype=np.uint64)
    whole = pieces.Sampler(pieces.load()).sample(some, seeds, 3)
    monkeypatch.setattr(pieces, "SLICE_CHARS", 50)
    monkeypatch.setattr(pieces, "_HASH_BITS", 5)
    cut = pieces.Sampler(pieces.load()).sample(some, seeds, 3)
    for own, other in zip(whole, cut, strict=True):
        assert [(s[0].tolist(), *s[1:]) for s in own] == [(s[0].tolist(), *s[1:]) for s in other]


def test_lattice_holds_the_edges_that_there_are():
    """One entry per piece that fits, not a place for each length at each node; equal rests are one node."""
    vocabulary = pieces.load()
    text = "then there are a thousand others then there"
    begin, start, lattice = pieces.Sampler(vocabulary)._walks([text])
    units = [" then", " there", " are", " a", " thousand", " others"]
    normal = {p for p, s in zip(vocabulary.pieces, vocabulary.scores, strict=True) if s is not None}
    rests = {u[i:].replace(" ", "▁") for u in units for i in range(len(u))}
    want = Counter(sum(r[:n] in normal for n in range(1, len(r) + 1)) for r in rests)
    assert Counter(np.diff(lattice.first).tolist()) == want
    assert len(lattice.chance) == len(lattice.after) == len(lattice.ids) == lattice.first[-1]
    assert len(start) == begin[-1] == 8
    assert start[0] == start[6] and start[1] == start[7]
    # Chances of a node's edges add up to one, and edges lead to nodes.
    assert np.add.reduceat(np.exp(lattice.log_q), lattice.first[:-1]) == pytest.approx(1)
    assert set(lattice.after.tolist()) <= {-1, *lattice.first[:-1].tolist()}


def test_round_trips_are_told_from_others():
    vocabulary = pieces.load()
    raw = pa.array(vocabulary.raw, pa.large_binary())
    texts = ["to a", "", "漢 �", "to b"]
    ids = [own[0][0] for own in pieces.Sampler(vocabulary).sample(texts, np.arange(4, dtype=np.uint64), 1)]
    assert [pieces.decode(vocabulary, x.tolist()) for x in ids] == texts
    ends = np.concatenate(([0], np.cumsum([len(x) for x in ids])))
    flat = np.concatenate(ids)
    assert pieces._round_trips(raw, flat, ends, texts) == [True] * 4
    assert pieces._round_trips(raw, flat, ends, ["to b", "x", "漢 ", "to b"]) == [False] * 3 + [True]
    assert pieces._round_trips(raw, flat[:0], np.array([0, 0]), [""]) == [True]


def test_memory_of_a_batch_stays_small():
    """What a task holds above its batch: runs of texts and slices of their paths, not all texts and paths."""
    draw = np.random.default_rng(5)
    words = ["".join(draw.choice(list("aeioubcdfglmnprst"), n)) for n in draw.integers(2, 9, 60_000)]
    texts = [" ".join(words[i] for i in draw.integers(0, len(words), 4_000)) for _ in range(100)]
    batch = pa.RecordBatch.from_pydict(
        {"doc_id": list(range(100)), "seed": list(range(100)), "text": pa.array([*texts, None][1:])}
    )
    run = pieces._encode(pieces.load(), 2)
    tracemalloc.start()
    rows = sum(out.num_rows for out in run(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 2 * 99 + 1
    assert peak < 150e6, f"{peak / 1e6:.0f} MB"


def test_stages_on_documents(spark, documents, sf_dir):
    docs = documents
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, sf_dir).cache()
        seen[name] = docs
        if name != "sentencepiece":
            assert docs.columns == before.columns
        if name == "language_id":
            assert docs.count() >= 0.99 * before.count()
        if name == "line_dedup":
            assert docs.count() == before.count()
        if name == "minhash":
            assert docs.count() < before.count()
            assert docs.select("doc_id").distinct().count() == docs.count()
        if name == "mixing":
            mix = mixing.mix_sources(before).join(before.select("doc_id", "source"), "doc_id")
            want = {r[0]: r[1] for r in mix.groupBy("source").agg(F.first("target")).collect()}
            words = docs.groupBy("source").agg(F.sum(mixing.size_in_words(F.col("text"))))
            got = {r[0]: r[1] for r in words.collect()}
            assert sum(abs(got.get(s, 0) - t) for s, t in want.items()) < 0.05 * sum(want.values())
    last = seen["sentencepiece"]
    assert last.filter("NOT round_trip").count() == 0
    assert last.select("doc_id").distinct().count() == seen["mixing"].select("doc_id").distinct().count()


def test_stages_on_odd_rows(spark, odd, empty, sf_dir):
    for rows in (odd, empty):
        docs = rows
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf_dir)
            if name != "sentencepiece":
                assert out.columns == docs.columns
            docs = out.cache()
            docs.count()
