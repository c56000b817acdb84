import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n):
    return [rng.choice("the of and tion ing stea rend ouat erth anly blea haon shre wher ndea".split()) + rng.choice(["", "", "s", "ly", "."]) for _ in range(n)]


@pytest.fixture(scope="session")
def corpus():
    """Small documents with copies, near copies, shared passages, nulls, empty and long texts and repeated rows."""
    rng = random.Random(5)
    passage = " ".join(words(rng, 70))
    rows = []
    for i in range(60):
        kind = i % 10
        text = " ".join(words(rng, rng.randint(1, 160)))
        if kind == 3:
            text = text + "\n" + passage + " " + " ".join(words(rng, 20))
        elif kind == 4 and i > 10:
            text = rows[i - 5][1]
        elif kind == 5 and i > 10:
            w = (rows[i - 7][1] or "x").split()
            w[len(w) // 2] = "edited"
            text = " ".join(w)
        elif kind == 6:
            text = ["", None, "  \t\n ", "é ü ñ 日本 Ünï", "a" * 500, "\x1cone\x85two three"][i // 10]
        rows.append((1000 - 7 * i if i != 20 else 5, text, "en", [None, "src0", "src0", "src1", "src2"][i % 5], len(text or "")))
    rows.append((2000, (passage + " ") * 6, "en", "src9", 1))
    rows.append((2001, " ".join(words(rng, 6000)), "en", "src0", 1))
    rows += [rows[13], rows[13]]  # repeated rows
    return rows


@pytest.fixture
def docs(spark, corpus):
    """With columns whose names the operators use themselves."""
    df = spark.createDataFrame(corpus, SCHEMA)
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit("mine") for c in ("runs", "key_id", "row", "score", "fp", "node", "h", "x", "label", "n_words", "id", "spans")})


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
