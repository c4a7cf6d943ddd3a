import pytest

#: Nulls, blanks, ties, repeated rows, a very long text, and texts with other white space.
ODD = [
    (1, None), (2, ""), (3, "   \n\t "), (4, "a"), (5, "the cat sat on the mat, the dog did not."), (6, "the cat sat on the mat, the dog did not."),
    (7, "The Cat  sat\n on  the mat"), (8, "x" * 50_000), (9, "word " * 20_000), (10, "żółć 日本語 テスト 123,456 it's we'll !!,     end"), (11, "tab\tand\u0085next\x1cfile"), (12, "!!! ,,, ..."),
]


@pytest.fixture(scope="session")
def odd(spark):
    """(doc_id, text) with a repeated row and columns whose names operators use inside."""
    rows = [*ODD, ODD[4]]
    return spark.createDataFrame([(i, t, "a", 1, "b", 2.0) for i, t in rows], "doc_id long, text string, lang string, n int, component_id string, score double")


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
