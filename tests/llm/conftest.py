import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def made(spark):
    """A function that makes documents of (doc_id, text, source) rows."""
    return lambda rows: spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], SCHEMA)


@pytest.fixture(scope="session")
def corpus():
    """Rows with nulls, empty and long texts, exact and near copies, repeated rows, repeated ids and shared passages."""
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdeXYZé") for _ in range(r.randint(1, 6)))
    rows = [(None, None, None), (None, "no id here at all", "s1"), (1, None, "s1"), (2, "", "s2"), (3, " \t\n ", None), (4, "one", "s2"), (5, "One", "s2"), (6, "one two", "s1")]
    base = [word() for _ in range(300)]
    for i in range(10, 40):
        ws = list(base)
        for _ in range(r.choice([0, 0, 1, 5, 20, 60])):
            ws[r.randrange(len(ws))] = word()
        rows.append((i, " ".join(ws), r.choice(["s1", "s2", "s3", None])))
    for i in range(40, 60):
        rows.append((i, "\n".join(" ".join(word() for _ in range(r.randint(0, 30))) for _ in range(r.randint(1, 6))), "s1"))
    rows.append((60, " ".join(word() for _ in range(20000)), "s3"))
    rows += [(61, "ha " * 500, "s2"), (61, "ha " * 500, "s2"), (62, "ha " * 500, "s3"), (62, "other text with the same id", "s3")]
    return rows
