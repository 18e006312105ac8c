import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, fp long, block int, word string, mark long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls everywhere, empty and repeated texts, repeated ids, and columns named like the operators' own."""
    long = " ".join(f"w{i}" for i in range(3000))
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [
        (1, "The cat sat on the mat. " * 3, "en", "a", 5), (2, None, None, None, None), (3, "", "en", "a", 0), (4, " \t\n ", "xx", "b", 4),
        (None, "The cat sat on the mat. " * 3, "en", "a", 5), (None, None, None, None, None), (5, long, "en", "a", 1), (6, long, "en", "a", 1),
        (7, f"one two {passage} three", "de", "c", 9), (8, f"four {passage} five six", "fr", "c", 9), (8, f"four {passage} five six", "fr", "c", 9),
        (9, "Ünïcödé   wörds 日本語 <|endoftext|> 'll x's", "es", "d", 3), (10, "a " * 60, "en", "e", 2), (10, "another text of the same id", "en", "e", 2),
    ]
    return spark.createDataFrame([(*r, 1.0, 2, 3, "w", 4) for r in rows], DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def texts(odd_docs):
    return [(r["doc_id"], r["text"]) for r in odd_docs.collect()]


@pytest.fixture(scope="session")
def sample(spark):
    """The whole smallest table of documents."""
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
