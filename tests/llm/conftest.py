import random

import pytest

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, row int, score double, shard int, "
    "`_id` int, `_sha` string, sha string, `_source` string, `_size` int, `_copies` int, record string, size int, `a.b` int, tags map<string,int>"
)


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(1, 7))) for _ in range(n))


def odd_rows():
    """Nulls in any column, empty and very long texts, ties, repeated rows, and columns named like the operators' own."""
    rng = random.Random(4)
    long, passage = words(rng, 9000), words(rng, 40)
    texts = [None, "", " \t\n", "One  word", "One word", "one word", long, long + " end", "ÀÉ ßtraße Σίσυφος x", "x" * 5000, "ab" * 700]
    texts += [words(rng, rng.randint(1, 120)) for _ in range(25)]
    texts += [words(rng, 20) + " " + passage + " " + words(rng, 20) for _ in range(6)]
    near = words(rng, 150).split()
    for i in range(6):
        copy = list(near)
        copy[10 + i * 20] = "changed"
        texts.append(" ".join(copy))
    texts += ["same text again and again"] * 12
    rows = [(i, t, "en" if i % 3 else None, None if i % 5 == 0 else f"src{i % 4}", 0, 1, 0.5, 3, i, "x", "y", "z", 1, 2, "r", 5, 6, {"k": i}) for i, t in enumerate(texts)]
    rows.append((None, "no id here", *[None] * 16))
    rows.append((7, texts[7], "en", "src3", 0, 1, 0.5, 3, 7, "x", "y", "z", 1, 2, "r", 5, 6, {"k": 7}))  # a row that is there already
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
