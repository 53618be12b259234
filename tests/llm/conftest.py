import pytest

FIELDS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def rows(documents):
    """(doc_id, text) of the smallest table."""
    return [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def make(spark):
    """A documents table of (doc_id, text) pairs."""

    def build(*pairs):
        return spark.createDataFrame([(k, t, "en", "s", None if t is None else len(t)) for k, t in pairs], FIELDS)

    return build


@pytest.fixture(scope="session")
def odd(make):
    """Nulls, empty texts, blanks, repeated rows, a long text, and a text outside the basic plane."""
    long = "\n".join(f"line {k} of a long text with number {k * k} and some more words here" for k in range(3000))
    return make((1, None), (2, ""), (3, "  \n\n "), (4, "same words in both rows of this text"), (4, "same words in both rows of this text"), (None, "a row without an id"), (None, None), (5, long), (6, "emoji 😀 and ﬁ ligature\tand tab"), (7, "x" * 5000))


def table_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
