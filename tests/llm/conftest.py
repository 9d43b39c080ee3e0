import random
import re

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, title string, component_id string, score string"


def doc(i, text, source="s0"):
    """A document row with extra columns whose names clash with results."""
    return (i, text, "en", source, None if text is None else len(text), "t", "c", "x")


@pytest.fixture(scope="session")
def make(spark):
    return lambda rows: spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def corpus():
    """Seeded documents: near and exact copies, repeats, nulls, empty and long texts."""
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    rows, n = [], 0

    def add(text, source="s0"):
        nonlocal n
        rows.append(doc(n, text, source))
        n += 1

    for i in range(60):
        add(" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 120))), f"s{i % 5}")
    for base in (3, 9, 9, 9, 20):
        words = rows[base][1].split()
        if len(words) > 10:
            words[rng.randrange(len(words))] = "changed"
        add(" ".join(words), "s1")
        add(rows[base][1].upper(), "s1")
    add(None), add(""), add(" \n\t "), add("one"), add("one"), add("ONE two", None)
    add(" ".join(rng.choice(vocabulary) for _ in range(30_000)), None)
    return rows


def words_of(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
