import pytest


@pytest.fixture(scope="session")
def documents(spark):
    """Rows with the cases every operator has to stand: nulls, empty, ties, copies, clashing names."""
    rows = [
        (1, "Alpha beta gamma. You idiot! Delta.", "en", "s0", 10),
        (1, "Alpha beta gamma. You idiot! Delta.", "en", "s0", 10),
        (2, None, None, None, None),
        (3, "", "en", "s0", 0),
        (4, "ünï 字 mixed\x00nul\x7f words", "xx", "s1", 5),
        (None, "no id here at all", "de", "s1", 5),
        (5, "word " * 5_000, "en", "s2", 25_000),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    return spark.createDataFrame(rows, schema).selectExpr("*", "1 as kept", "2 as n_words", "3 as _text")
