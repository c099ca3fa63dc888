import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, kept int, size string, body string, key int"


@pytest.fixture(scope="module")
def edges(spark):
    """Nulls in every column, empty and blank texts, a long text, repeated rows, ties and columns with clashing names."""
    long_text = " ".join(f"word{i % 5000} filler{i} the" for i in range(12_000))
    prose = "the quick brown fox jumps over the lazy dog and then it runs away from the big grey wolf near the old river bank"
    clash = (7, "x", "y", 9)
    rows = [
        (1, prose, "en", "a", 10, *clash),
        (1, prose, "en", "a", 10, *clash),
        (2, prose.replace(" ", "\n \t"), "en", "b", None, *clash),
        (3, prose + " today", None, None, 1, *clash),
        (4, None, "en", "a", None, *clash),
        (5, "", "de", "b", 0, *clash),
        (6, " \n\t ", None, "", 4, *clash),
        (7, long_text, "en", "c", None, *clash),
        (8, "Licensed under the Apache License, Version 2.0.\n\nIdiot 😀 é", "en", None, 3, *clash),
        (None, prose, None, None, None, None, None, None, None),
        (9, "one", "en", "c", 3, *clash),
        (10, "12 34 !!", "fr", "c", 3, *clash),
    ]
    return spark.createDataFrame(rows, COLUMNS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], COLUMNS)
