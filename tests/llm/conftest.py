import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names the operators use inside.
CLASHING = "uid long, run int, digest string, hash long, fp long, spans string, place int, keep_id long, copy int, n long, licence string"
WORDS = {
    "en": "the of and that with from have this which their would about other into could time than only some".split(),
    "de": "und der nicht eine auch nach wird bei einer über wenn noch werden durch können schon größte müssen".split(),
}


def prose(seed, n, lang="en"):
    rnd = random.Random(seed)
    own = ["".join(rnd.choice(["ba", "do", "ki", "lu", "mer", "ton", "sha", "wi"]) for _ in range(rnd.randint(2, 4))) for _ in range(n)]
    words = [rnd.choice(WORDS[lang]) if rnd.random() < 0.5 else w for w in own]
    return " ".join(w.capitalize() + "." if i % 9 == 8 else w for i, w in enumerate(words))


def make(spark, rows):
    """Documents from (doc_id, text) or (doc_id, text, lang)."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", None) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture(scope="session")
def odd_rows():
    long = prose(1, 30_000)
    return [
        (1, prose(2, 60)), (2, None), (3, ""), (4, " \t\n "), (5, prose(2, 60)), (5, prose(2, 60)), (None, prose(3, 40)),
        (None, None), (6, long), (7, "a" * 300_000), (8, "!!! ... 123"), (9, "日本語のテキスト。😀 é́"), (10, "x"), (11, "\0 null \0"),
        (12, prose(4, 50, "de"), "de"), (13, prose(5, 50, "de"), "de"), (14, prose(6, 80), None), (-3, prose(7, 30)),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """Nulls, empty and long texts, repeated rows, and extra columns with clashing names."""
    from pyspark.sql import functions as F
    docs = make(spark, odd_rows)
    return docs.select("*", *(F.lit(None).cast(x.split()[1]).alias(x.split()[0]) for x in CLASHING.split(", "))).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
