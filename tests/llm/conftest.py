import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

LONG = "".join(f"word{i} again. " for i in range(6000))

#: Nulls in every column, empty and blank texts, ties, repeated rows, a very
#: long text, control strings; further columns whose names clash with results.
ODD = [
    (1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa.", "en", "s", 1),
    (2, "Alpha  beta gamma\tdelta epsilon zeta eta theta iota kappa.", "en", "s", 1),
    (3, "Alpha beta gamma delta epsilon zeta eta theta iota kappa.", None, None, None),
    (3, "Alpha beta gamma delta epsilon zeta eta theta iota kappa.", None, None, None),
    (4, None, "en", "s", None),
    (5, "", "de", "s", 0),
    (6, " \n\t ", None, "s", 0),
    (7, LONG, "en", "s", 9),
    (8, "!!! 123 %%%", "fr", "s", 1),
    (9, "<|endoftext|> <s> \\### Assistant: </turn> é日本 ▁x  y", "es", "s", 1),
    (10, "one two three", "en", "s", 1),
    (None, "a text without an id", "en", "s", 1),
    (None, None, None, None, None),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ("id", "row", "key", "score", "kept", "content", "fp", "salt", "digest", "words", "block", "n")


@pytest.fixture(scope="session")
def odd(spark):
    df = spark.createDataFrame(ODD, SCHEMA)
    for c in CLASHING:
        df = df.selectExpr("*", f"'clash' as {c}")
    return df.repartition(3).cache()


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
