import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def make(spark, texts, ids=None, lang="en", source="s0"):
    """A documents table with the given texts."""
    rows = [(i if ids is None else ids[i], t, lang, source, None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def awkward():
    """Null, empty, blank, repetitive, multilingual and long texts, with copies."""
    r = random.Random(5)
    words = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 6))) for _ in range(40)]
    prose = lambda n: "".join(r.choice(words) + r.choice([" ", " ", "\n", "\t", "  ", ". "]) for _ in range(n))
    base = prose(400)
    return [None, "", " ", "\n\n", "a", "a" * 700, "ab " * 300, "#*$ |x|\n#*$ |x|\n\n x\nx", "日本語 テキスト x　y " * 30, base, base, base[:900] + "Q" + base[901:], prose(30) + base[100:800] + prose(30), prose(3000), "THE END " * 12 + prose(50), prose(90)]


@pytest.fixture(scope="session")
def docs(spark):
    return make(spark, awkward()).cache()
