import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, score double, node string, `key` string, run int, own string, _row long, word string, held_out int, `__x` string"
SYLLABLES = "the an er on in re ti es or st ed nd at is it ou th ha ing ion".split()


def prose(rng, n):
    """n invented words in sentences and lines."""
    words = ["".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n)]
    return " ".join(w + (".\n" if i % 29 == 28 else "." if i % 9 == 8 else "") for i, w in enumerate(words)).replace(".\n ", ".\n")


@pytest.fixture
def rng():
    return random.Random(11)


@pytest.fixture(scope="session")
def frame(spark):
    """Documents of (doc_id, text) or (doc_id, text, source), with columns of other sense that clash in name."""

    def make(rows, parts=3):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1]), 1, 0.5, "n", "k", 1, "o", 7, "w", 0, "x") for r in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(parts) if full else spark.createDataFrame([], SCHEMA)

    return make


@pytest.fixture(scope="session")
def odd():
    """Nulls, empty and blank texts, a very long one, repeated rows, repeated ids, null ids."""
    rng = random.Random(5)
    long = prose(rng, 30_000)
    a = prose(rng, 60)
    return [(1, a), (1, a), (2, None), (3, ""), (4, " \n\t "), (5, long), (None, a), (None, None), (6, "é ß 你好 \U0001f600 x"), (6, "another text under the same id"), (7, "x"), (8, a.upper()), (9, "!!! ...")]
