from __future__ import annotations

import pytest
from pyspark.sql import DataFrame

EDGE_TEXTS = [
    None, "", " ", "\n \t\n", "a", "a  b", "one two three four five", "one two three four five",
    "x" * 5000, "word " * 3000, "mail bob.99@mail.example.com or +1 (523) 555-1055 now",
    "Ünï cödé ΣΑΣ 日本 語\u180e \u2003 end", "tab\tand\r\nline\x0bends\x0c here ",
]


@pytest.fixture(scope="session")
def edge_docs(spark) -> DataFrame:
    """Nulls in every column, empty and long texts, ties, repeated rows, clashing names."""
    rows = [(i, t, "en" if i % 2 else None, None if i % 3 else "s", 7, "x", 1)
            for i, t in enumerate(EDGE_TEXTS)]
    rows += [(3, "other text of a repeated id", "en", "s", 1, "y", 2),
             (None, "a null id with some words here", None, None, None, None, None), rows[6], rows[6]]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long, "
        "_id string, shard int")


@pytest.fixture(scope="session")
def no_docs(edge_docs) -> DataFrame:
    return edge_docs.filter("false")
