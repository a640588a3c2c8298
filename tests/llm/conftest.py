import random

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, row_key string, fp int, size string, label int"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty and long texts, repeated rows, rows that share an id, names that clash."""
    r = random.Random(5)
    words = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5)) for _ in range(60)]
    block = "\n".join(" ".join(r.choice(words) for _ in range(20)) for _ in range(4))
    long = " ".join(r.choice(words) for _ in range(30000))
    rows = [
        (1, block + "\nfirst tail", "en", "a"), (1, block + "\nfirst tail", "en", "a"), (2, "head line\n" + block, "en", None), (3, None, "en", "a"), (4, "", None, "a"),
        (None, "no id here\n" + block, "en", "a"), (None, None, None, None), (5, long, "en", "a"), (6, "1234 5678", "en", "a"), (6, "same id, other text", "en", "a"), (7, " \n\t\n", "en", "b"),
        (8, "The SAME words Again", "en", "b"), (9, "the same words again", "en", "b"),
    ]
    return spark.createDataFrame([(d, t, l, s, len(t) if t else None, "x", 1, "s", 2) for d, t, l, s in rows], DOCS).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)
