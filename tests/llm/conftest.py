import pytest

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, fp long, spans string, label string, _p int, score int"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Null ids and texts, empty and blank texts, a very long one, repeated rows, other columns with clashing names."""
    long = "the onerthe wasing of thention " * 30_000 + " password=abcdefghijklmnop"
    texts = [
        (1, "the same text of the end and the thing"), (2, "the same text of the end and the thing"), (1, "the same text of the end and the thing"),
        (3, None), (4, ""), (None, "der ist und die schen"), (None, None), (5, " \t\n "), (6, "12345 !?"), (7, long), (8, "é"), (8, "naïve ﬁ 😀 𝔘 token: 0123456789abcdef0123"),
    ]
    return spark.createDataFrame([(i, t, "en" if i else None, None, None, 9, 9, "x", "y", 1, 2) for i, t in texts], SCHEMA)


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)
