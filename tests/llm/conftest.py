import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """documents from texts, with an extra column whose names clash with the operators' own."""

    def build(texts, ids=None):
        ids = range(len(texts)) if ids is None else ids
        rows = [(i, t, "en", "s", len(t) if t is not None else None, 7, 8.0, "x", 9) for i, t in zip(ids, texts)]
        return spark.createDataFrame(rows, DOCS + ", chunk long, score double, fp string, n long").coalesce(3)

    return build


@pytest.fixture(scope="session")
def texts():
    """Random texts with copies, shared passages, odd white space, long and empty ones."""
    rng = random.Random(5)
    vocabulary = ["alpha", "beta", "Gamma", "délta", "x", "été", "naïve", "東京", "9", "the", "of", "and", "!!", "a-b"]

    def prose(n):
        return " ".join(rng.choice(vocabulary) + (str(rng.randrange(50)) if rng.random() < 0.7 else "") for _ in range(n))

    passage, line = prose(90), prose(14)
    out = [prose(rng.randrange(1, 60)) for _ in range(20)]
    out += [out[3], out[3], out[5] + " ", "", None, " \t\n ", "word", "word"]
    out += [prose(30) + "\n" + passage + "\n" + prose(20), passage, prose(5) + " " + passage[:-3] + " " + prose(7), passage + " " + passage]
    out += [prose(8) + "\n" + line + "\n" + prose(8) for _ in range(6)] + ["ab " * 700, "ab " * 700 + "c", "z" * 2500, prose(3000)]
    return out
