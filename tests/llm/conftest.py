import random

import pytest

#: Nulls, empty and white texts, repeats, ties and long texts.
ODD = [
    (1, "the quick brown fox jumps over the lazy dog near the old stone bridge", "en", "b"),
    (2, "the quick brown fox jumps over the lazy dog near the old stone bridge", "en", "a"),
    (2, "the quick brown fox jumps over the lazy dog near the old stone bridge", "en", "a"),
    (3, None, None, None),
    (4, "", "en", "a"),
    (5, "  \t\n ", None, "b"),
    (6, "12345 --- !!", "de", None),
    (7, "héllo wörld ñandú straße 你好 <|endoftext|> a b", "es", "é"),
    (8, "Licensed under the Apache License, Version 2.0.", "en", "a"),
    (None, "a row without an id that has some words in it", "fr", "b"),
    (600, "x" * 30_000, None, "b"),
    (5000, "one two three four five six seven " * 3000, "en", "z"),
]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id bigint, text string, lang string, source string").cache()


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def prose(spark):
    """Texts of invented words with copies, near copies and edits of several strengths."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 8))) for _ in range(900)]
    texts = []
    for _ in range(60):
        base = rng.choices(vocabulary, k=rng.randint(3, 160))
        texts.append(base)
        for edits in rng.choices((0, 1, 1, 2, 3, 6), k=rng.randint(0, 5)):
            other = list(base)
            for _ in range(edits):
                other[rng.randrange(len(other))] = rng.choice(vocabulary)
            texts.append(other)
    # one group of many different texts about one base
    base = rng.choices(vocabulary, k=150)
    for _ in range(70):
        other = list(base)
        for _ in range(rng.randint(1, 5)):
            other[rng.randrange(len(other))] = rng.choice(vocabulary)
        texts.append(other)
    rng.shuffle(texts)
    rows = [(k * 3, " ".join(t), "en", f"s{k * k % 7 % 4}") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").cache()
