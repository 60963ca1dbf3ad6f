import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, base string, th long"


def sentence(rng, n, words=300):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def rows(seed=7):
    """Documents with nulls in every column, empty and long texts, ties, repeated rows and clashing column names."""
    rng = random.Random(seed)
    texts = [sentence(rng, rng.randrange(0, 60)) for _ in range(30)]
    passage = sentence(rng, 40)
    texts += [sentence(rng, 10) + "\n" + passage + "\n" + sentence(rng, 10) for _ in range(5)]
    texts += [texts[3]] * 3 + [texts[4] + " tail", texts[5].upper()]
    base = sentence(rng, 120).split(" ")
    for _ in range(6):
        own = list(base)
        own[rng.randrange(len(own))] = "changed"
        texts.append(" ".join(own))
    texts += ["", " \t\n", None, None, "é😀 ñandú", "one", "one two", "x" * 3000, sentence(rng, 6000, 5000)]
    out = [(i, t, rng.choice(["en", "fr", None]), None if i % 7 == 0 else f"s{i % 3}", None, "clash", i) for i, t in enumerate(texts)]
    out += [out[2], out[33], (None, texts[33], None, None, None, None, None), (5, "another text with an id that is taken", "en", "s", 1, "b", 0)]
    rng.shuffle(out)
    return out


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
