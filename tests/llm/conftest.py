import random

import pytest

#: Extra columns have names that operators use inside.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, block long, key string, n long, digest string, score double, lang_pred string"


def awkward_rows() -> list[tuple]:
    """Nulls, empty and very long texts, exact and near copies, ties, repeated rows."""
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice(["th", "er", "on", "an", "re", "He", "é", "ß"]) for _ in range(rnd.randint(1, 4)))
    base = [word() for _ in range(120)]
    texts = [None, "", " \t\n", "one", "one  two", "one two", "One two", "".join("x" for _ in range(5000)), " ".join(word() for _ in range(20_000))]
    for i in range(12):
        own = list(base)
        for _ in range(i // 3):
            own[rnd.randrange(len(own))] = word()
        texts.append(" ".join(own) + ("." if i % 2 else ".\nMore of it, and " + word()))
    texts += [" ".join([word() for _ in range(15)] + base[30:75] + [word() for _ in range(9)]) for _ in range(5)]
    texts += ["loop " * 60, "a\u3000b 日本語 𐍈𐍈 <|endoftext|> it's 1st", "tail\r\nends\x0bhere\x0c"]
    rows = [(i * 3 % 101, t, rnd.choice(["en", "de", None]), f"s{i % 3}", len(t or ""), 1, "k", 2, "d", 0.5, "x") for i, t in enumerate(texts)]
    rows += [rows[4], rows[9], (None, "one two", *[None] * 9), (None, None, "en", *[None] * 8)]
    return rows


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(awkward_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
