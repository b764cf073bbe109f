"""Small documents with the awkward cases every operator has to handle."""

import pytest

LONG = " ".join(f"word{i % 701}x{i % 13}" for i in range(40_000))
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, Shard int, `found` string, score double, fp string"


def awkward_rows():
    """Null id, null text, empty text, white space only, a very long text, repeated rows, odd characters."""
    base = "the quick brown fox jumps over the lazy dog near the river bank in the early morning light"
    texts = {
        1: base, 2: base, 3: base + " again", 4: None, 5: "", 6: " \t\n ", 7: LONG, 8: "One", 9: "a <|endoftext|> b  c ",
        10: "naïve café – 中文 😀  x", 11: "#*$ && <> ||", 12: "line one\nline one\n\nline one",
    }
    rows = [(i, t, "en" if i % 2 else None, None, None, 3, "x", 1.5, "y") for i, t in texts.items()]
    return rows + [rows[0], (None, base, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(awkward_rows(), SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def texts():
    return [(r[0], r[1]) for r in awkward_rows()]
