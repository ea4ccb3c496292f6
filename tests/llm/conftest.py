import pytest

#: Texts that operators on texts must survive, with ties and repeated rows.
ODD_TEXTS = [
    None, "", " ", "\n\n", "a", "word " * 70, "é", "日本 語 x", "A\tb\vc\fd\r\ne", "x\n\nx\nx\n y\ny", "\u0000 \x1c\x85  ",
    "one two three one two three four", "one two three one two three four", "#*$%&|<> ! |", "😀 😀 😀 😀", "x" * 200_000,
    "The CAT sat. on; the mat? 12 345 | the cat sat.",
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """(doc_id, text) rows of odd texts, null and repeated ids included, with clashing extra columns."""
    rows = [(i, t, 1, "x") for i, t in enumerate(ODD_TEXTS)] + [(None, "null id", 2, "y"), (3, "same id", 3, None), (3, "same id", 3, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_words int, score string")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
