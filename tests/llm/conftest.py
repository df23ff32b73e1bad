from __future__ import annotations

import random

import pytest


@pytest.fixture(scope="session")
def corpus():
    """Rows (doc_id, text, lang, source) with copies, near copies, shared passages and odd texts."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)] + ["Été", "naïve,", "das", "the"]

    def prose(n):
        return " ".join(rng.choice(words) for _ in range(n))

    shared, line = prose(70), prose(12)
    rows, doc = [], 0
    for i in range(60):
        text = prose(rng.randint(25, 160))
        if i % 4 == 0:
            text = f"{text}\n{shared} {prose(5)}"
        if i % 5 == 0:
            text = f"{text}\n{line}\n{prose(8)}\n{line}"
        rows.append((doc := doc + 1, text, rng.choice(["en", "de"]), rng.choice(["a", "b"])))
        if i % 6 == 0:
            rows.append((doc := doc + 1, text, "en", "a"))  # an exact copy
            parts = text.split(" ")
            parts[len(parts) // 2] = "changed"
            rows.append((doc := doc + 1, " ".join(parts), "en", None))
    rows += [
        (doc + 1, "", "en", "a"),
        (doc + 2, None, None, None),
        (doc + 3, "   \n\t ", "en", "b"),
        (doc + 4, "one", "en", "b"),
        (doc + 5, "one", "en", "b"),
        (doc + 6, "two words", "en", "b"),
        (doc + 7, "same " * 300, "en", "b"),
        (doc + 8, prose(9000) + " " + shared, "en", "b"),  # a very long text
        (None, shared + " " + prose(30), "en", "a"),
        rows[3],  # the same row again
    ]
    return rows


@pytest.fixture(scope="session")
def documents(spark, corpus):
    return spark.createDataFrame(corpus, "doc_id long, text string, lang string, source string").repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string")


@pytest.fixture(scope="session")
def clashing(spark):
    """The documents' columns under other names, among columns named like the operators' own."""
    rows = [(7, "a b c d", 1, "x", 2, "y"), (8, "a b c d", 1, "x", 2, None)]
    return spark.createDataFrame(rows, "key long, body string, doc_id int, mark string, n int, node string")
