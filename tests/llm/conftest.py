import pytest

SHAPE = "doc_id long, text string, lang string, source string, n_chars long, n string, t string, ids string, copy string, score double"
LONG = " ".join(f"word{i % 977} mark{i % 13}" for i in range(30_000))
BASE = " ".join(f"alpha{i} beta{i * 7 % 31}" for i in range(60))
EDGE_TEXTS = (
    (1, BASE), (2, BASE), (3, BASE + " tail"), (4, None), (5, ""), (6, " \n\t "), (7, "one"), (8, "one two"), (9, LONG), (10, LONG + " end"),
    (None, BASE), (None, None), (12, "é日本語 " * 80), (12, "é日本語 " * 80), (13, "a" * 3000), (14, "unique words only here and now " + BASE[:120]),
)


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls, empty and very long texts, equal texts, repeated rows, and extra columns whose names operators use."""
    rows = [(i, t, "en", f"s{k % 3}" if k % 5 else None, k, "x", "y", "z", "w", 1.0) for k, (i, t) in enumerate(EDGE_TEXTS)]
    return spark.createDataFrame(rows, SHAPE).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SHAPE)
