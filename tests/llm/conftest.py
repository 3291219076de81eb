import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key int, token string, v string"


def make_docs(spark, rows):
    """rows: (doc_id, text); the other columns have names that operators use inside."""
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), 1, "x", None) for i, t in rows], DOCS)


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, repeated rows, ties, copies and near copies."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    long_line = "This very same line is found in many documents of the table!"
    rows = [(1, None), (2, ""), (3, " \t\n "), (4, "one two"), (5, "one two"), (6, "ONE  two")]
    base = text(120)
    rows += [(10, base), (11, base), (12, base.upper().replace("É", "é")), (12, base.upper().replace("É", "é"))]
    for k in range(13, 30):  # near copies of several degrees
        w = base.split(" ")
        for _ in range(k % 5):
            w[rng.randrange(len(w))] = "zz" + str(rng.randrange(9))
        rows.append((k, " ".join(w)))
    rows += [(40 + k, f"{text(30)}\n  {long_line.upper() if k % 2 else long_line}\t\n{text(8)}\n{long_line}") for k in range(7)]
    rows += [(60 + k, text(60) + "\n" + text(3)) for k in range(10)]
    rows += [(80, text(6000)), (81, "x" * 5000), (82, "\n" * 300), (83, "spam and eggs " * 100), (84, "$$$ ### " + text(70)), (-7, text(55)), (None, text(55))]
    return rows
