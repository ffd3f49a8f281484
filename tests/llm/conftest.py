import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, junk string"


@pytest.fixture(scope="session")
def words():
    rng = random.Random(3)
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7))) for _ in range(400)]


@pytest.fixture(scope="session")
def sample(words):
    """Documents with exact and near copies, passages shared within and across documents, and odd ones."""
    rng = random.Random(5)
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = []
    add = lambda text, lang="en", source="a": rows.append((len(rows), text, lang, source, len(text or ""), "x"))
    passage, base = say(60), say(120).split()
    for k in range(12):
        add(say(80), source="abc"[k % 3])
    for k in range(8):
        add(say(20) + "\n" + passage + "\n" + say(20))
    for k in range(12):
        near = list(base)
        for _ in range(k):
            near[rng.randrange(len(near))] = rng.choice(words)
        add(" ".join(near), source="b")
    for _ in range(5):
        add(rows[0][1], source=None)
    add(passage + " and " + passage)
    add("w " * 700)
    add("é" * 150 + " ß " + "é" * 150)
    add("é" * 220)
    for text in (None, "", " \n\t ", "one", "one two three", "ONE two THREE", "x" * 199, "y" * 200, "y" * 200, "12 34 !!", "<|im_start|> <|endoftext|>", "\U0001f600 中文 café"):
        add(text, lang=None)
    add(say(4000), source=None)
    rows.append(rows[3])
    return rows


@pytest.fixture(scope="session")
def docs(spark, sample):
    return spark.createDataFrame(sample, SCHEMA).repartition(5)
