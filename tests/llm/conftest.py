import os

import pytest


@pytest.fixture(scope="session")
def small_dir():
    return os.environ.get("FOLIANT_TESTDATA", "/root/testdata") + "/sf0.001"


@pytest.fixture(scope="session")
def docs(spark):
    """``documents`` out of (doc_id, text), with columns that operators use inside."""

    def make(rows):
        full = [(i, t, None, "src", None if t is None else len(t), "x", 1, True, 2, "y", 3) for i, t in rows]
        return spark.createDataFrame(
            full,
            "doc_id long, text string, lang string, source string, n_chars long, sig string, n int,"
            " _maybe boolean, _bit int, _dropped string, mark long",
        )

    return make


#: Nulls, empty and blank texts, ties, repeated rows, line ends of all kinds, other scripts.
ODD = [
    (1, None),
    (2, ""),
    (3, " \t\n "),
    (4, "one"),
    (5, "Two words"),
    (6, "same text here again and again\nsame text here again and again\n\nsame text here again and again"),
    (7, "same text here again and again\nsame text here again and again\n\nsame text here again and again"),
    (7, "same text here again and again\nsame text here again and again\n\nsame text here again and again"),
    (8, "ÄÖ straße\x0bñandú\x1cx   日本語 🙂 #$%\r\nend"),
    (None, "a row without an id"),
    (9, "w" * 5000),
    (10, "very long text with words " * 4000),
]
