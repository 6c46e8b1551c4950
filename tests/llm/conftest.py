import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, n string, label int, h1 long, target double, next string, cluster long, sid long"


@pytest.fixture
def docs(spark):
    """Documents from (doc_id, text, lang, source), with further columns whose names operators use inside."""

    def make(rows):
        return spark.createDataFrame([(i, t, lang, src, len(t or ""), 0.5, "x", 7, 1, 2.0, "z", 3, 4) for i, t, lang, src in rows], DOCS)

    return make


LONG = "word " * 40_000
EDGE = [(None, "no id here at all", "en", "a"), (1, None, "en", "a"), (2, "", None, None), (3, " \n\t ", "en", "a"), (4, "one", "de", None), (4, "one", "de", None), (5, LONG, "en", "b"), (6, "a b\n\n" * 3, "fr", "b")]


@pytest.fixture
def edge(docs):
    return docs(EDGE)
