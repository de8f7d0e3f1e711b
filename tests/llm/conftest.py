import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf_docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture
def make(spark):
    """Documents from (doc_id, text), with columns whose names the operators use inside."""

    def build(rows):
        full = [(i, t, "en", "src0", len(t or ""), 1, "k", 2) for i, t in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, n long, key string, words int")

    return build


#: Nulls, empty and blank texts, repeated rows, ties, a long text and characters of every width.
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one two"), (6, "One  TWO"), (7, "é 😀 naïve 你好 ÀÉ"), (8, "a b c d e f g h " * 40),
    (9, "repeated row of a few words"), (9, "repeated row of a few words"), (None, "no id here but words"), (10, "x" * 30_000), (11, "word " * 3000),
]
