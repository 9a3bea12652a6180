import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, h int, node string, term string, n_words string, kept string, copy string"


def rows_of(texts):
    """Rows of the documents' schema with more columns, whose names operators use themselves."""
    return [(i, t, "en", f"s{(i or 0) % 3}", len(t or ""), "x", 1, "n", "t", "w", "k", "c") for i, t in texts]


@pytest.fixture(scope="session")
def docs_of(spark):
    return lambda texts: spark.createDataFrame(rows_of(texts), SCHEMA)


@pytest.fixture(scope="session")
def corpus():
    """(id, text) with copies, near copies, shared passages, repeated lines, runs, odd characters, nulls and empty texts."""
    rng = random.Random(7)
    words = ["alpha", "beta", "Gamma", "de", "the", "of", "été", "x1", "naïve", "in"] + [f"w{i}" for i in range(60)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, line = text(70), "Subscribe to our great newsletter today 2024-01-01"
    base = text(120)
    texts = [text(rng.randint(1, 150)) for _ in range(25)]
    texts += [base, base, base.replace(" w1 ", " zz ", 1), f"{text(30)}\n{passage}\n{text(10)}", f"{passage} {text(25)}"]
    texts += [f"{text(8)}\n{line.replace('2024', str(y))}\n{text(9)}" for y in range(2020, 2025)]
    texts += ["the " * 90, "ab " * 200, "x y " * 60, "### " * 30, "", " \t\n", None, "one", "é" * 900, "a\u0000b \u0000", "same  spacing\r\nhere"]
    texts.append(" ".join(text(40) for _ in range(60)))
    return list(enumerate(texts)) + [(3, texts[3]), (None, base), (None, "no id here"), (3, "another text of the same id " * 5)]
