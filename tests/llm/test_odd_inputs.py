"""NULLs, empty and very long texts, repeated rows, empty tables, clashing columns."""

from collections import Counter

import pytest
from contactloom.llm import (
    disclosure,
    edits,
    language,
    licenses,
    lines,
    minhash,
    mixing,
    pieces,
    toxicity,
    vectors,
)

# Rows out for each row in: all operators on documents but the sampler keep them one to one.
ONE_TO_ONE = {
    "lines": lambda docs: lines.drop_boilerplate(docs, min_sites=2).select("doc_id", "text", "n_lines", "n_removed"),
    "edits": edits.fingerprint_documents,
    "toxicity": lambda docs: toxicity.score_toxicity(docs, None),
    "mixing": mixing.mix_sources,
    "disclosure": disclosure.personal_spans,
    "language": lambda docs: language.identify(docs, language.train(docs)),
    "licenses": lambda docs: licenses.scan_licenses(docs, licenses.known_licenses(docs.sparkSession)),
    "minhash": minhash.near_duplicates,
}


@pytest.mark.parametrize("name", ONE_TO_ONE)
def test_each_row_gives_one_row_and_equal_rows_equal_ones(name, odd):
    got = ONE_TO_ONE[name](odd).collect()
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in odd.collect())
    twice = [r for r in got if r.doc_id == 2]
    if name not in ("edits", "mixing"):  # these depend on the neighbours and on the place in the mix
        assert twice[0] == twice[1]


@pytest.mark.parametrize("name", ONE_TO_ONE)
def test_no_rows_give_no_rows(name, empty):
    assert ONE_TO_ONE[name](empty).collect() == []


def test_samples_of_odd_texts(odd, empty):
    vocabulary = pieces.load()
    got = pieces.sample_pieces(odd, vocabulary).collect()
    assert all(r.round_trip for r in got)
    by_id = {(r.doc_id, r.sample): r for r in got}
    for blank in (4, 5):
        assert by_id[blank, 0].ids == [] and (blank, 1) not in by_id
    assert by_id[1, 0].ids != by_id[1, 1].ids
    assert len([r for r in got if r.doc_id == 2]) == 4
    assert pieces.sample_pieces(empty, vocabulary).collect() == []


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 1, "x"),
        (2, [2.0, 0.0], 1, "x"),
        (2, [2.0, 0.0], 1, "x"),
        (3, [1.0, 0.01], 1, "x"),
        (4, [1.0, 0.0], 2, "x"),
        (5, [1.0, 0.0], None, "x"),
        (6, None, 1, "x"),
        (7, [0.0, 0.0], 1, "x"),
        (8, [nan, 1.0], 1, "x"),
        (9, [inf, 1.0], 1, "x"),
        (10, [None, 1.0], 1, "x"),
        (11, [], 1, "x"),
        (12, [1.0, 0.0, 0.0], 1, "x"),
        (None, [1.0, 0.0], 1, "x"),
    ]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, node string")
    got = {}
    for r in vectors.near_vectors(table).collect():
        got.setdefault(r.vec_id, r)
    assert [got[i].n_links for i in (1, 2, 3, None)] == [4, 4, 4, 4]
    assert [got[i].component_id for i in (1, 2, 3, None)] == [1, 1, 1, 1]
    for alone in (4, 5, 6, 7, 8, 9, 10, 11, 12):
        assert (got[alone].n_links, got[alone].component_id, got[alone].kept) == (0, alone, True)
    assert vectors.near_vectors(table.limit(0)).collect() == []


def test_defined_results_of_blank_texts(odd):
    languages = {r.doc_id: r for r in language.identify(odd, language.train(odd)).collect()}
    assert all(languages[i].lang_pred == "und" for i in (4, 5, 6, 8))
    copies = {r.doc_id: r for r in minhash.near_duplicates(odd).collect()}
    assert all(copies[i].n_shingles == 0 and copies[i].component_id == i for i in (4, 5, 6))
    assert copies[7].n_shingles == 1 and copies[2].component_id == 1
    licence = {r.doc_id: r for r in licenses.scan_licenses(odd, licenses.known_licenses(odd.sparkSession)).collect()}
    assert licence[4].digest is None and licence[12].license_id == "MIT notice"
    mix = {r.doc_id: r for r in mixing.mix_sources(odd).collect()}
    assert mix[4].size == mix[6].size == 0 and mix[4].taken == 0


def test_long_digit_runs_and_letters_of_late_planes():
    """IP-like runs of thousands of zeros do not end the query; letters from U+30000 on count."""
    from contactloom.llm.disclosure import base_spans
    from contactloom.llm.language import Grams

    spans = base_spans("0" * 5000 + "1.2.3.4 and 10.0.0.1")
    # The first part, 5,000 zeros and a one, is the number 1.
    assert spans == [("ip", 0, 5007), ("ip", 5012, 5020)]
    _, _, some = Grams(64, (1, 2, 3)).buckets_of(["\U00030000\U00030001", "!! 12"])
    assert list(some) == [True, False]
