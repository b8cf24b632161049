import random

import pytest

CLASHING = "row bigint, digest string, size string, target string, fp string, piece string, doc string, key string, word string"
SCHEMA = f"doc_id bigint, text string, lang string, source string, n_chars bigint, {CLASHING}"


def invented(seed: int, n: int = 60) -> list[tuple[int | None, str | None, str | None]]:
    """(doc_id, text, source) with copies, near copies, long, empty and NULL texts and repeated rows."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(80)]
    rows: list = []
    for i in range(n):
        kind = rng.random()
        if rows and kind < 0.2:
            text = rng.choice(rows)[1]
        elif rows and kind < 0.3:
            text = (rng.choice(rows)[1] or "").replace(" ", "\t\n ", 2) + rng.choice(["", " ", " extra"])
        else:
            text = " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 2, 5, 40, 120, 700])))
        rows.append((i * 7 % 1000, text, rng.choice(["a", "b", "é", None])))
    return [*rows, (5000, None, None), (5001, "", "b"), (5002, "  ", "a"), (None, "no id at all", "a"), rows[0], rows[0]]


@pytest.fixture(scope="session")
def rows():
    return invented(1)


@pytest.fixture(scope="session")
def docs(spark, rows):
    full = [(i, t, "en", s, len(t or ""), *[None] * 9) for i, t, s in rows]
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
