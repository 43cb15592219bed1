import pytest


@pytest.fixture(scope="session")
def docs(spark):
    def make(rows):
        """(doc_id, text, lang, source) rows as documents with an extra column of a clashing name."""
        full = [(i, t, la, s, None if t is None else len(t), "x") for i, t, la, s in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, size string").repartition(3)

    return make


ODD = [
    (1, None, "en", "a"), (2, "", "en", None), (3, " \n\t ", None, "a"), (4, "one", "en", "a"), (4, "one", "en", "a"), (None, "no id here", "en", "b"),
    (5, "word " * 30_000, "en", "a"), (6, "x" * 50_000, "de", "a"), (7, "é日本🤦 ​ <|endoftext|> <s> ▁", "fr", "b"), (8, "one", "fr", "b"), (9, "THE the\nthe\n\nthe", "en", "a"),
]


@pytest.fixture(scope="session")
def odd(docs):
    return docs(ODD)


@pytest.fixture(scope="session")
def none(docs, odd):
    return odd.limit(0)
