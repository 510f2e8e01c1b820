import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_words string, fp int, g string, key string"


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows, extra columns with clashing names."""
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "Über", "naïve", "x1", "日本", "de", "la"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    body = [text(40), text(200), "", "   \n\t ", None, "one", "one two", "a\nb\nc\nd", "a\nb\nc\nd", "é" * 5, text(9000), "x" * 30000, "1" * 300, "same same " * 50]
    rows = [(i, t, ["en", "fr", None][i % 3], ["s1", "s2", None, ""][i % 4], 5, "clash", i, "g", "k") for i, t in enumerate(body)]
    rows += [rows[1], rows[1], (None, text(30), None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None), (3, text(25), "en", "s1", 1, "", 1, "", "")]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


def ids(df):
    return sorted((r.doc_id for r in df.select("doc_id").collect()), key=lambda x: (x is None, x or 0))
