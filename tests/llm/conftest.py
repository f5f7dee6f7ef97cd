import pytest

KIND = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "Lorem ipsum dolor sit amet. " * 3000
#: Nulls in every column, empty and long texts, repeated rows, ties, white space of all kinds.
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank today.", "en", "a", 70),
    (2, "The quick brown fox jumps over the lazy dog near the river bank today.", "en", "a", 70),
    (3, "", "en", "b", 0),
    (4, None, None, None, None),
    (5, "  two  spaces\n\n\ttabs and\x0blines\r\n", "en", "b", 30),
    (6, LONG, "la", "c", len(LONG)),
    (7, "eins zwei drei\neins zwei drei\nvier fünf sechs sieben ä ö ü ß", "de", None, 60),
    (7, "eins zwei drei\neins zwei drei\nvier fünf sechs sieben ä ö ü ß", "de", None, 60),
    (7, "same id, other text", "en", "d", 19),
    (None, "a row without an id that still counts", "en", "d", 37),
    (None, None, None, None, None),
    (8, "12345 !!! ??? ###", None, "d", 17),
    (9, "日本語 テキスト 😀😀 <|endoftext|> é́", "ja", "e", 30),
    (10, "aaaa" * 500, "xx", "e", 2000),
]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ROWS, KIND)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], KIND)


@pytest.fixture(scope="session")
def make(spark):
    return lambda rows: spark.createDataFrame([(i, t, None, None, None) for i, t in rows], KIND)


@pytest.fixture(scope="session")
def clash(odd):
    """The odd rows with columns named like what the operators add or use inside."""
    from pyspark.sql import functions as F

    names = "ids decoded fingerprint simhash least shingles keys line key node id hash spans near score predicted size shard slot failed n_words lines n_dropped"
    return odd.withColumns({n: F.lit("mine") for n in names.split()})
