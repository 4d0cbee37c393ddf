import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, th string, score string, spans int, fp string, row int"


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text): copies, near copies, shared passages, long and short texts, nulls, ties, repeats."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefgé") for _ in range(rng.randint(1, 6))) for _ in range(160)]
    words = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage, base = words(70), words(120)
    rows = [(i, " ".join(words(rng.choice([3, 4, 5, 12, 49, 50, 51, 90, 200])))) for i in range(40)]
    for i in range(40, 60):
        w = words(30) + passage[rng.randint(0, 10) :] + words(rng.randint(0, 40))
        rows.append((i, " ".join(w)))
    for i in range(60, 85):
        w = list(base)
        for _ in range(rng.randint(0, 9)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        rows.append((i, "\n".join(w) if i % 2 else " ".join(w).upper()))
    rows += [(90, None), (91, ""), (92, "  \n\t "), (93, "one"), (94, "One"), (95, rows[3][1]), (96, rows[3][1]), (97, "x" * 300_000), (98, " ".join(words(20_000)))]
    rows += [(96, rows[3][1]), (None, rows[50][1]), (None, None), (50, " ".join(base))]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """The corpus as documents with null columns and extra columns of clashing names."""
    return spark.createDataFrame([(i, t, None, "s", None, "x", "y", 1, "z", 7) for i, t in corpus], SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
