import random

import pytest

WORDS = "the of and to in is that it was for on are as with his they at be this from have or by one had not but what all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has more her two like him see time could no make than first been its who now people my made over did down only way find use may water long little very after words called just where most know".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + ("\n" if r.random() < 0.05 else "") for _ in range(n))


#: Nulls in every column, empty and very long texts, ties, repeated rows.
ODD = [
    (1, prose(1, 120), "en", "a", 1), (1, prose(1, 120), "en", "a", 1), (2, prose(1, 120), "en", "a", 1), (3, "", "en", "b", 0), (4, None, None, None, None),
    (None, prose(2, 80), "en", "a", 2), (None, None, None, None, None), (5, "one", "fr", None, 3), (6, " \n\t\x0b ", "fr", "b", 3), (7, "é ü 漢字 😀 x", None, "c", 9),
    (8, prose(3, 20_000), "en", "a", 5), (9, "a" * 300_000, "en", "c", 5), (10, "ONE one", "fr", "", 3),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside, or return.
CLASH = ("n_bytes", "media", "fp", "size", "target", "whole", "part", "spans", "_match", "_words", "grp", "x0", "word", "class", "held_out", "row", "ids", "start", "record", "file", "_class", "kept", "rank")


@pytest.fixture(scope="session")
def odd(spark):
    """Odd documents with extra columns of clashing names."""
    return spark.createDataFrame(ODD, SCHEMA).selectExpr("*", *(f"'x' AS `{c}`" for c in CLASH))


@pytest.fixture(scope="session")
def none(odd):
    return odd.filter("1 = 0")


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
