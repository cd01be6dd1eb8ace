import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns whose names clash with those of results and of steps between.
CLASHING = "size long, kept boolean, n_words long, content string, key string, version long"


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, clashing extra columns."""
    long_text = " ".join(f"w{k % 977}" for k in range(30_000))
    words = " ".join(f"word{k}" for k in range(60))
    rows = [
        (1, "the same text here", "en", "a", 18),
        (2, "the same text here", "en", "b", 18),
        (2, "the same text here", "en", "b", 18),
        (3, "the  same\ttext here ", None, None, None),
        (4, "", "en", "a", 0),
        (5, None, None, None, None),
        (6, " \n\t ", "de", "", 4),
        (None, "a row without an id", "de", "a", 19),
        (None, None, None, None, None),
        (7, long_text, "en", "a", len(long_text)),
        (8, words, "en", "b", len(words)),
        (9, words + " more", "en", "b", len(words) + 5),
        (10, words.upper(), "en", None, len(words)),
        (11, "ein <|endoftext|> Wort \U0001f600 äöü x", "de", "c", 30),
        (11, "another text under the same id", "de", "c", 30),
    ]
    more = (7, None, -1, "x", "k", 3)
    return spark.createDataFrame([(*r, *more) for r in rows], f"{SCHEMA}, {CLASHING}").repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def crowd(spark):
    """Texts over few words with exact and near copies, so that everything repeats."""
    rng = random.Random(5)
    vocabulary = [f"v{k}" for k in range(400)]
    rows, texts = [], []
    for k in range(160):
        if texts and rng.random() < 0.5:
            words = rng.choice(texts).split(" ")
            for _ in range(rng.choice([0, 0, 1, 2, 6])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                words = words[: rng.randrange(1, len(words) + 1)]
        else:
            words = [rng.choice(vocabulary) for _ in range(rng.randrange(1, 120))]
        texts.append(" ".join(words))
        rows.append((k, texts[-1], rng.choice(["en", "de"]), rng.choice(["a", "b", None]), len(texts[-1])))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"
