import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from llm_texts import lines, prose  # noqa: E402

from railweave.llm.common import ship  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, regs string, k1 string, bucket string, rank string, known string, copy string, c0 string, n_words string, t1 string, keep string, dup string"


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    ship(spark)


@pytest.fixture(scope="session")
def make(spark):
    """Rows of (doc_id, text[, lang, source]) as a table with columns that clash with inner names."""
    def build(rows):
        full = [(*r, *(None,) * (4 - len(r)), len(r[1]) if r[1] else None, *("x",) * 11) for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return build


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty, blank, short and very long texts, repeated rows, ties, copies and near copies."""
    base = prose(1, 200)
    near = base[:150] + ["other"] + base[151:]
    far = base[:100] + prose(2, 100)
    long = prose(3, 40_000)
    return [
        (1, lines(base), "a", "s1"), (2, lines(base), "a", "s1"), (3, lines(near), "a", "s2"), (4, lines(far), "b", "s2"),
        (5, None, "a", "s1"), (6, "", "b", None), (7, " \n\t ", None, "s1"), (8, "one", "a", "s2"), (9, "ONE", "a", None), (10, "one two three", "b", "s3"),
        (None, lines(base), "a", "s1"), (None, None, None, None), (11, lines(prose(4, 60)), "b", "s3"), (11, lines(prose(4, 60)), "b", "s3"), (11, lines(prose(5, 60)), "b", "s3"),
        (12, lines(long), "a", "s4"), (13, lines(long[:-1] + ["end"]), "a", "s4"), (14, "12345 67890 !!", "a", "s5"), (15, lines(prose(6, 80)) + "\n" + lines(base[:72]), "b", "s5"),
    ]
