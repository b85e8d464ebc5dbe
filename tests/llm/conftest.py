import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def corpus(spark):
    """Small hostile documents: nulls, empty and long texts, copies, near copies, repeats, clashing extra columns."""
    r = random.Random(7)
    vocab = ["".join(r.choice(["ta", "re", "én", "lo", "shi", "ku"]) for _ in range(r.randint(1, 4))) for _ in range(400)]
    say = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    shared, rows = say(30), []
    for i in range(60):
        rows.append((i, say(r.randint(1, 120)) + ("\n" + shared + " " if i % 5 == 0 else ""), ["xx", "yy", None][i % 3], ["a", "b", None, "a"][i % 4], 1))
    base = say(80).split()
    for i in range(60, 75):
        w = list(base)
        w[r.randrange(80)] = "changed"
        rows.append((i, " ".join(w), "xx", "a", 1))
    rows += [(75, None, None, None, None), (76, "", "xx", "b", 0), (77, " \t\n", "yy", "b", 3), (78, say(5000), "xx", "c", 1)]
    rows += [(79, rows[3][1], "xx", "a", 1), (80, rows[3][1], "xx", "a", 1), (80, rows[3][1], "xx", "a", 1), (81, "x" * 5000, "xx", "a", 1), (82, "... 123 !!", None, "a", 1)]
    return [(*x, "extra", 5) for x in rows]


@pytest.fixture()
def docs(spark, corpus):
    return spark.createDataFrame(corpus, DOCS + ", rank string, bin int").repartition(5)
