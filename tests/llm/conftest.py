import random

import pytest

CLASHING = "row long, bag string, rank string, worker int, class int, score double, spans string, ids string, sequence_id long, comp long, node long"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}"


@pytest.fixture(scope="session")
def odd_rows():
    """doc_id and text: nulls, empty and very long texts, ties and repeated rows."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghiklmnoprstuvw") for _ in range(rng.randint(2, 9))) for _ in range(300)]
    prose = [" ".join(rng.choice(words) for _ in range(n)) for n in (3, 40, 400, 1)]
    return [(1, prose[0]), (2, prose[1]), (2, prose[1]), (3, prose[1]), (4, prose[2]), (None, prose[2]), (None, prose[2]), (None, None),
            (5, None), (6, ""), (7, " \n\t "), (8, prose[3]), (9, "x" * 30_000), (10, " ".join(rng.choice(words) for _ in range(20_000))),
            (11, "É&&& ÀÇ!!\n| a | b |\n" * 50), (12, "mail a.b@c.de +1 (988) 555-2485, 10.0.0.1, 4111 1111 1111 1111"), (13, "\x00\x1c\x1f <|endoftext|> İ Σ"),
            (9_000_000_000, "end")]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    return spark.createDataFrame([(i, t, None, None, None, 1, "b", "r", 2, 3, 0.5, "s", "i", 4, 5, 6) for i, t in odd_rows], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
