import os

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    return SF


ODD = [(1, "The first text has quite a few words in it, all of them plain."), (2, None), (3, ""), (4, "   \n\t "),
       (5, "12345 !!! ..."), (None, "A text without an id but with enough words to be a set."), (6, "word"),
       (7, "The first text has quite a few words in it, all of them plain."),
       (7, "The first text has quite a few words in it, all of them plain."),
       (8, "é" * 30_000 + " " + "lorem ipsum dolor sit amet " * 2_000), (9, "ends with a letter ß")]


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty and very long texts, repeated rows, and columns with clashing names."""
    rows = [(i, t, "en", "s", None, "x", "y", 1) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, "
                                       "row string, n string, component long")


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
