"""Small corpora with nulls, empty, long and repeated texts and columns whose names clash with the operators' own."""

import random

import pytest
from pyspark.sql import functions as F

WORDS = [f"{a}{b}" for a in ("ba", "ko", "mi", "tu", "re", "so", "li", "na") for b in ("dor", "len", "mak", "pis", "run", "tag", "vel", "zum")]
CLASHES = ["sha", "salt", "row", "keep_id", "maybe", "fp", "batch", "digest", "n_words", "item_ids", "score", "lang_pred", "word", "part", "own_id", "gone_id", "slot0"]


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def corpus():
    base = prose(1, 300)
    edited = base.split()
    edited[150] = "OTHER"
    rows = [
        (1, base), (2, base.upper()), (3, base), (4, " ".join(edited)), (5, base + " tail"),
        (6, None), (7, ""), (8, "  \n\t "), (9, "one"), (10, "one two"), (11, "One"),
        (12, prose(2, 20_000)), (13, prose(3, 200) + base[:900] + prose(4, 100)), (14, "x" * 5000), (15, "ÄÖÜ äöü ß Σας 中文 текст"),
        (16, prose(5, 80)), (16, prose(5, 80)), (None, prose(6, 90)), (17, base), (18, "ab" * 900), (19, prose(7, 60) + "\n" + prose(7, 60)),
    ]
    return rows


@pytest.fixture(scope="session")
def docs(spark):
    df = spark.createDataFrame(corpus(), "doc_id bigint, text string")
    df = df.withColumns({"lang": F.lit("en"), "source": F.lit("s")}).withColumns({c: F.lit(c) for c in CLASHES})
    return df.repartition(3)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("doc_id < -1")
