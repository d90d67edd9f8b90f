import pytest

#: Columns of a table whose other columns have the names that the operators make themselves.
CLASHING = "doc_id bigint, text string, id string, node string, bucket int, u int, v int, hash int, n int, kept int, score int, tail int, range int, `select` int"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty, blank and very long texts, repeated rows and ids, clashing columns."""
    texts = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one two"), (6, "x " * 30_000), (7, "y" * 70_000), (8, "Ünïcode 日本 😀 ok. Fine!"), (8, "Ünïcode 日本 😀 ok. Fine!"), (None, "no id at all here"), (None, None), (9, "a <|endoftext|> b▁c\r\nd")]
    rows = [(i, t, "a", "b", 1, 1, 1, 1, 1, 1, 1, 1, 1, 1) for i, t in texts]
    return spark.createDataFrame(rows, CLASHING)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], CLASHING)
