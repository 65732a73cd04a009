import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, h long, target int"


@pytest.fixture(scope="session")
def make(spark):
    """documents from (doc_id, text) pairs, with columns whose names the operators use inside."""

    def f(rows):
        full = [(d, t, "en", "s", len(t) if t is not None else None, "x", 1, 2) for d, t in rows]
        return spark.createDataFrame(full, DOCS)

    return f


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls, empty and very long texts, ties and repeated rows."""
    line = "the quick brown fox jumps over the lazy dog while it rains in the old town by the sea"
    long = "\n".join(f"{line} number {k}" for k in range(4000))
    return [
        (1, None), (2, ""), (3, "   \n\t "), (4, long), (5, line), (5, line), (6, line), (None, line), (None, None),
        (7, "12345 !!"), (8, "Ünïcödé ümläut ß €"), (9, long + "\nend"), (10, "a"), (11, "\x00zero\x00"),
    ]


@pytest.fixture(scope="session")
def sf_docs(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
