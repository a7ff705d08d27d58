import pytest
from pyspark.sql import functions as F

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    # Columns that no operator asks for, named like those that operators make.
    "score double, class string, line string, taken long, spans string, ids string, held_out string, _key long, bands string, digest string, u string, node string"
)
WORDS = "the quick brown fox jumps over the lazy dog and runs away from all of it".split()


def row(doc_id, text, lang="en", source="a"):
    return (doc_id, text, lang, source, None, 0.5, "c", "l", 7, "s", "i", "h", 1, "b", "d", "u", "n")


def long_text(n):
    return " ".join(f"{WORDS[i % len(WORDS)]}{i * i % 97}" for i in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """NULLs in all columns, empty and blank texts, repeated rows, one very long text."""
    same = " ".join(WORDS)
    return [
        row(1, same),
        row(2, same),
        row(2, same),
        row(3, same + " again", source=None),
        row(4, None),
        row(5, ""),
        row(6, "  \n\t \n"),
        row(None, same, lang=None),
        row(None, None, lang=None, source=None),
        row(7, "one two"),
        row(8, "12 34 !!"),
        row(9, "\n".join(["a shared line", same, "héé ▁ wörld 漢字 😀"]), lang="fr"),
        row(10, long_text(30_000), source="b"),
        row(11, "x" * 60_000, source="b"),
        row(12, "Released under the MIT License.\nCopyright 2020 Someone", source="c"),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r.doc_id: r.text for r in documents.select("doc_id", "text").collect()}


@pytest.fixture(scope="session")
def long_documents(documents):
    return documents.filter(F.length("text") > 2_000)
