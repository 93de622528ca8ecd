import pytest

SF = "/root/testdata/sf0.001"
CLASH = "extra string, id long, n long, text2 string, digest string, score double, g long"


@pytest.fixture
def docs(spark):
    """A maker of documents with extra columns whose names the operators use inside."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), "x", 1, 2, "y", "z", 0.5, 3) for i, t in rows], f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}").repartition(3)

    return make


LONG = "long words repeat here and there " * 20_000


@pytest.fixture
def odd():
    """Nulls, empty and long texts, ties, repeated rows."""
    return [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (None, "nobody"), (None, None), (5, LONG), (6, LONG), (7, "Ünïcödé <|endoftext|> \U0001f600 \x1c x"), (8, "a b c d e f g h")]
