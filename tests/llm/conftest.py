import pytest


@pytest.fixture(autouse=True)
def shared(spark):
    from tessera.llm.common import prepare
    prepare(spark)


@pytest.fixture()
def docs(spark):
    """Null and empty texts, ties, repeated rows, an extra column whose name
    clashes with a result column, and a long text."""
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    rows = [(1, base, "en", "a", 5), (2, base, "en", "a", 5), (2, base, "en", "a", 5), (3, None, None, None, 5), (4, "", "en", "a", 5),
            (5, " \n\t ", "de", None, 5), (6, base + " nu xi omicron", "en", "a", 5), (7, "kurz", None, "b", 5),
            (8, base.upper(), "en", "a", 5), (9, "word " * 30000, "en", "a", 5), (None, "row without an id here now", "en", "a", 5)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_tokens long")


@pytest.fixture()
def nothing(docs):
    return docs.limit(0)
