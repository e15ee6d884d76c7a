import pytest

from recordmill.llm.common import prepare


@pytest.fixture(scope="session")
def llm(spark):
    return prepare(spark)


@pytest.fixture(scope="session")
def odd_docs(llm):
    """Nulls, empty and long texts, ties, repeated rows, and columns named like internal ones."""
    base = " ".join(f"word{i}" for i in range(60))
    rows = [
        (1, base), (2, base), (3, base.upper()), (4, base.replace("word7 ", "other ")), (5, None), (6, ""), (7, "  \n\t "),
        (8, "one two"), (9, "One  TWO"), (None, base + " tail"), (None, None), (10, "x " * 20_000), (10, "x " * 20_000),
        (11, "same line of five words\n" * 3), (12, "héé ñandú 数字 ١٢٣ don't stop <|endoftext|>  \n\n a"), (13, "a" * 5000),
    ]
    return llm.createDataFrame([(i, t, 1, "k", 2.0) for i, t in rows], "doc_id long, text string, n long, key string, region double")


@pytest.fixture(scope="session")
def no_docs(llm):
    return llm.createDataFrame([], "doc_id long, text string, n long")
