import pytest

from offerlake.llm.common import ship

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, spans string"


@pytest.fixture(scope="session")
def llm(spark):
    ship(spark)
    return spark


@pytest.fixture(scope="session")
def odd_docs(llm):
    """Nulls, empty and long texts, ties, repeated rows, and further columns with clashing names."""
    words = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
    texts = [
        (1, words), (2, words + " extra"), (3, None), (4, ""), (5, "a b"), (5, "a b"), (6, "  \n\n ..."), (7, "  \n\n ..."),
        (8, "don't we'll  日本語 ²½ x_y 😀"), (9, "word " * 40_000), (None, "no id"), (10, "The MIT License and cc-by, GNU General Public License v3"), (11, words),
    ]
    return llm.createDataFrame([(i, t, None if i == 4 else "en", "a" if i != 6 else None, 0, 1.0, "x") for i, t in texts], DOCS)


@pytest.fixture(scope="session")
def no_docs(llm):
    return llm.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def labels(llm):
    return llm.createDataFrame([], "doc_id long, quality int, toxic int")
