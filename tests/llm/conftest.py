import random

import pytest

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
          "digest string, bucket int, shard int, fp long, score double, kept boolean, chunk long")
LABELS = "doc_id long, quality int, toxic int"


def documents(spark, rows):
    """Rows (doc_id, text); the other columns are null or clash with columns that operators make."""
    extra = (None, None, None, "mine", 7, 7, 7, 0.5, True, 7)
    return spark.createDataFrame([(i, t, *extra) for i, t in rows], SCHEMA)


EDGES = [
    (1, "The same words, twice."), (2, None), (3, ""), (4, " \n\t "), (None, "No id here"), (None, None),
    (6, "The same words, twice."), (7, "Repeated row"), (7, "Repeated row"), (8, "x" * 30_000),
    (9, " ".join(f"w{i % 997}" for i in range(20_000))), (10, "tab\tand  runs\n\nof   space \n "),
    (11, "é　中文 ñ <|endoftext|> it's 12345!!"), (12, "THE SAME WORDS, TWICE."), (-3, "below zero"),
]


@pytest.fixture(scope="session")
def edges(spark):
    return documents(spark, EDGES)


@pytest.fixture(scope="session")
def nothing(spark):
    return documents(spark, [])


def random_texts(n, seed=1, words=300, longest=60):
    rng = random.Random(seed)
    return [" ".join(f"w{int(words * rng.random() ** 2)}" for _ in range(rng.randint(0, longest))) for _ in range(n)]
