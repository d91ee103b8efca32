"""Documents with everything that may go wrong, and texts with known copies."""

import random

import pytest

EXTRA = "d string, h string, kept string, probability string, ids string, text2 string, node string, length string, quality string, u string"


def words(rng, n, base="alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()):
    return " ".join(rng.choice(base) + str(rng.randint(0, 99)) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """(doc_id, text): nulls, empty and very long texts, ties, repeated rows, copies and near copies."""
    rng = random.Random(5)
    plain = words(rng, 120)
    near = plain.split()
    near[60] = "changed"
    long = words(rng, 40_000)
    return [
        (5, plain), (6, plain), (7, " ".join(near)), (7, " ".join(near)), (8, "Tiny text"), (9, ""), (10, None), (None, plain), (None, "alone 'tis <|endoftext|> x"), (11, long), (12, "a b c\n\n  d \x1c é \U0001f600 "),
        (13, "x " * 3000), (14, "#$% " * 80), (15, "line one\nline one\nline two\n \n"), (16, words(rng, 60) + " " + plain), (17, plain.upper()),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """The rows as a table with further columns whose names operators use themselves."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(odd_rows, "doc_id long, text string").repartition(3)
    return df.select("*", *[F.lit("extra").alias(c.split()[0]) for c in EXTRA.split(", ")])


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")
