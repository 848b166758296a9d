import random

import pytest

# Columns beside id and text whose names clash with those that operators use or return.
ODD = "score double, n_tokens string, key string, code int, pos int, fp string, spans string, host string, first int"


@pytest.fixture(scope="session")
def odd_rows(spark):
    """Rows with NULLs, empty and long texts, repeats, ties and clashing columns."""
    texts = [
        (1, "Some plain words, and more of them.\nA second line.", "en", "a"),
        (1, "Some plain words, and more of them.\nA second line.", "en", "a"),
        (1, "another text under the same id", "en", "a"),
        (2, None, None, None), (3, "", "en", "b"), (4, " \n\t ", "", "b"), (None, "no id here", "en", None),
        (None, None, None, None), (5, "x" * 5000, "fr", "c"), (6, "word " * 20_000, "en", "c"),
        (7, "é 中文 😀 <|endoftext|> ▁ \x00 '", None, "d"), (8, "123 456 !!!", "de", "d"),
    ]
    rows = [(i, t, lang, s, None if t is None else len(t), 0.5, "x", "k", 1, 2, "f", "s", "h", 3) for i, t, lang, s in texts]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {ODD}")


@pytest.fixture(scope="session")
def prose():
    """Reproducible invented texts."""
    def make(n: int, seed: int = 1, least: int = 30, most: int = 200) -> list[str]:
        pick = random.Random(seed)
        vocabulary = ["".join(pick.choice(["th", "er", "on", "an", "re", "he", "in", "ed"]) for _ in range(pick.randint(1, 4))) for _ in range(2000)]
        return [" ".join(pick.choice(vocabulary) for _ in range(pick.randint(least, most))) + "." for _ in range(n)]

    return make


@pytest.fixture
def small_docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
