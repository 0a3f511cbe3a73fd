import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, __x string, n long, cell int, size long"


@pytest.fixture
def docs(spark):
    """A table from texts (ids from 1) or from (doc_id, text, source); with columns whose names could clash."""

    def make(rows):
        rows = [r if isinstance(r, tuple) else (i + 1, r, f"s{i % 3}") for i, r in enumerate(rows)]
        return spark.createDataFrame([(i, t, "en", s, len(t or ""), "x", 1, 2, 3) for i, t, s in rows], DOCS)

    return make


def words(n, start=0):
    return " ".join(f"w{start + i}" for i in range(n))


#: Null, empty, white space, short, long, repeated and tied rows.
EDGES = [
    (1, None, None), (2, "", "a"), (3, " \n\t ", "a"), (None, "no id here at all", "b"), (4, "one", "b"), (5, words(30), "b"), (5, words(30), "b"),
    (6, words(30), None), (7, words(20_000), "c"), (8, words(29) + " x", "c"), (9, "é ü 中   <|endoftext|>\x00", ""), (10, words(40, 100), "a"),
]
