import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, lines string, `id` int"


@pytest.fixture(scope="session")
def make_docs(spark):
    """``make_docs([(doc_id, text, lang, source)])``: documents with columns of clashing names."""

    def make(rows):
        full = [(i, t, g, s, None if t is None else len(t), "x", "y", 7) for i, t, g, s in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


LONG = "one two, three four five six seven\n" * 40_000  # 1.4 million characters


@pytest.fixture(scope="session")
def odd_rows():
    """NULLs everywhere, empty, wordless and very long texts, repeated rows."""
    return [
        (1, None, "en", "a"), (2, "", None, "a"), (3, " \t\n", "en", None), (None, "no id here", "de", "b"),
        (None, None, None, None), (4, "same row", "en", "a"), (4, "same row", "en", "a"), (5, LONG, "en", "b"),
        (6, "ünï ©ödé 漢字 🙂 ¡hola!\x00", "es", "b"), (7, "…", None, "b"),
    ]
