import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))

from llm_words import words  # noqa: E402

#: Names that the operators use inside; a table may have columns of the same names.
CLASHES = ["row", "key", "n", "node", "words", "size", "start", "label", "ids", "band", "page", "digest", "value"]


@pytest.fixture(scope="session")
def table(spark):
    """Makes (doc_id, text) tables, or others, with columns of clashing names beside."""

    def make(rows, schema="doc_id long, text string"):
        full = schema + "".join(f", {c} string" for c in CLASHES)
        return spark.createDataFrame([(*r, *[c.upper() for c in CLASHES]) for r in rows], full)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and long texts, repeated rows, signs beyond the BMP."""
    long = words(1, 30_000)
    return [
        (None, "a text without a key but with words"), (1, None), (2, ""), (3, " \n\t \r\n"), (4, "One two THREE four."), (4, "One two THREE four."),
        (5, long), (6, long), (7, "emoji 😀 née  naïve x\n\nİstanbul <|endoftext|> 'tis it's"), (8, "x" * 100_000), (-9, "."),
    ]
