from __future__ import annotations

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, part string, ids string, score string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and wordless texts, repeated rows, a long text, columns with clashing names."""
    long = " ".join(f"word{i % 997}" for i in range(60_000))
    line = "this is a line of more than forty characters, found in many documents"
    rows = [
        (1, None, "en", "a", 1, "p", "i", "s"),
        (2, "", "en", None, None, None, None, None),
        (3, " \n\t ", None, "a", 3, "p", "i", "s"),
        (4, "one two", "en", "a", 7, "p", "i", "s"),
        (4, "one two", "en", "a", 7, "p", "i", "s"),
        (None, f"{line}\nown text", "en", "a", 7, "p", "i", "s"),
        (5, long, "en", "a", len(long), "p", "i", "s"),
        *((10 + k, f"{line}\ntext number {k}", "en", "a", 9, "p", "i", "s") for k in range(6)),
        (20, "!!! ???", "xx", "a", 7, "p", "i", "s"),
        (21, "né <|endoftext|> café 漢字 😀", "fr", "a", 7, "p", "i", "s"),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
