import pytest
from hypothesis import settings

settings.register_profile("plain", deadline=None)
settings.load_profile("plain")

ODD_TEXTS = [
    None, "", " ", "a", "one two three", "one two three four five six", "One TWO three four five six", "x" * 5000,
    "tab\tand\nnewline  double  ", " leading", "trailing ", "é ñ ü ß 漢字 😀 word", "▁ literal ▁▁ marker", "a\u0000b",
    "<|endoftext|> in text", "it's they're I'll 12,345.67 -- ok?", "word " * 3000,
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and very long texts, repeated rows and extra columns whose names clash with internal ones."""
    rows = [(i, t, "s", i, "n") for i, t in enumerate(ODD_TEXTS + ODD_TEXTS[3:7])]
    rows.append(rows[5])
    return spark.createDataFrame(rows, "doc_id long, text string, fp string, id long, part string").repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string")
