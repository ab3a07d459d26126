import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def invented(seed: int, count: int, words: int = 60, vocabulary: int = 30) -> list[tuple]:
    """Documents over few words, with shared passages, copies, nulls, empty texts and odd white space."""
    r = random.Random(seed)
    known = [f"w{i}" if i % 5 else f"É{i}" for i in range(vocabulary)]
    passages = [[r.choice(known) for _ in range(r.randint(8, 30))] for _ in range(6)]
    rows = []
    for i in range(count):
        text = []
        while len(text) < r.randint(0, words):
            text += r.choice(passages) if r.random() < 0.4 else [r.choice(known) for _ in range(r.randint(1, 12))]
        joined = "".join(w + r.choice([" ", " ", "\n", "\t ", ", "]) for w in text)
        rows.append((i, joined, "en", "s", len(joined)))
    rows += [(count + k, rows[k % len(rows)][1], "en", None, None) for k in range(5)] if rows else []
    rows += [(count + 5, None, None, None, None), (count + 6, "", "en", "s", 0), (count + 7, " \n ", None, "s", 3)]
    r.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def documents(spark):
    def make(seed=1, count=60, **more):
        return spark.createDataFrame(invented(seed, count, **more), DOCS)

    return make


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)
