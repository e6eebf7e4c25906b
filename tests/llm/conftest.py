import random

import pytest

WORDS = {"en": "the of and in to with that this from other thing water under light".split(), "fr": "le la une dans pour avec être très où même eau sous lumière".split(), "de": "der die und nicht für über wasser unter licht schön größe zwischen".split()}


def prose(rng, n, lang="en"):
    return " ".join(rng.choice(WORDS[lang]) + rng.choice(["", "", "ing", "er", "s", "."]) for _ in range(n))


@pytest.fixture
def rng():
    return random.Random(7)


AWKWARD = [None, "", " \n\t ", "one", "two words", "\n\n\n", "   x", "a\0b", "Ünï Çödé 漢字 🙂", "x" * 50_000, "same words " * 20_000]


@pytest.fixture
def awkward(spark):
    """Null and odd texts, repeated rows, null ids and sources, and columns with names that operators use inside."""
    rows = [(i if i != 3 else None, t, "en" if i % 2 else None, "s" if i % 3 else None, 0, f"k{i}", i, 1.5) for i, t in enumerate(AWKWARD)]
    rows += [rows[4], rows[4], (50, "two words", "de", "s", 9, "k", 1, 2.5)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string, row int, score double")


@pytest.fixture
def empty(awkward):
    return awkward.limit(0)
