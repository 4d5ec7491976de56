"""Phrase mining against plain counting."""

import random
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from wrackline.llm import phrases

from .conftest import CLASHES


def slow_counts(rows, longest=4):
    counts, totals = Counter(), Counter()
    for _, text, lang in rows:
        low = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang or "und"] += len(w)
            for k in range(1, longest + 1):
                counts.update((lang or "und", tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    return counts, totals


def slow(rows, least, top=2000, cover=80):
    counts, totals = slow_counts(rows)
    found = {g: n for g, n in counts.items() if len(g[1]) > 1 and n >= least}
    best = {}
    for (lang, w), a in found.items():
        parts = [(counts[lang, w[:k]], counts[lang, w[k:]]) for k in range(1, len(w))]
        low = min(range(len(parts)), key=lambda k: (2_000_000 * a // sum(parts[k]), k))
        inside = lambda v: any(v[i : i + len(w)] == w for i in range(len(v) - len(w) + 1))  # noqa: B023, E731
        if not any(m == lang and len(v) > len(w) and inside(v) and 100 * f >= cover * a for (m, v), f in found.items()):
            best.setdefault(lang, []).append((-(2_000_000 * a // sum(parts[low])), -a, " ".join(w).encode(), *parts[low]))
    return sorted((lang, i + 1, p.decode(), -a, l, r, totals[lang], -s) for lang, x in best.items() for i, (s, a, p, l, r) in enumerate(sorted(x)[:top]))


def corpus(seed=5, n=260):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["É", "don't", "#", "x.y", "中", "A", "a\x1cb", "\xa0"]
    out = []
    for i in range(n):
        w = [r.choice(words[: 3 + i % 45]) for _ in range(r.randrange(0, 90))]
        if i % 3 == 0:
            w[5:5] = ["New", "York", "stock", "exchange"] if i % 2 else ["new", "york"]
        out.append((i, "".join(x + r.choice([" ", "  ", "\t", " ", " ", ", ", ".\n", "\x0b"]) for x in w), None if i % 17 == 0 else ["en", "de", "x.y"][i % 3]))
    return out + [(None, None, "en"), (None, "", None), (7, "  ,. ", "xx"), (8, "hot " * 20_000, "en"), (9, "b" * 100_000 + " b", "de")] + [(10, "copy of a copy", "fr")] * 40


ROWS = corpus()


@pytest.fixture(scope="module")
def df(spark):
    rows = spark.createDataFrame(ROWS, "doc_id bigint, text string, lang string")
    return rows.withColumns({c: F.lit(c) for c in [*CLASHES, "k", "phrase", "n", "h", "a", "l", "r", "rank"] if c not in ("doc_id", "text", "lang")}).repartition(3)


@pytest.mark.parametrize(("more", "least"), [({}, 30), ({"sample": 1.0, "lowered": 1}, 12), ({"sample": 0.0}, 30), ({"sample": 0.3, "lowered": 5, "part_bytes": 300}, 20), ({"max_bits": 20, "sample": 0.5}, 4)])
def test_counts_are_exact_whatever_the_sample_was(df, more, least):
    """Samples of none, some and all documents, texts counted in short parts."""
    found, passes = phrases.frequent(df, least=least, **more)
    counts, totals = slow_counts(ROWS)
    got = sorted((r.lang, r.phrase, r.n) for r in found.where("k > 0").collect())
    assert got == sorted((lang, " ".join(w), n) for (lang, w), n in counts.items() if n >= least)
    assert {r.lang: r.n for r in found.where("k = 0").collect() if r.n} == {k: v for k, v in totals.items() if v}
    assert passes == (1 if more.get("sample") == 1.0 else 2)


@pytest.mark.parametrize(("least", "top", "cover"), [(30, 2000, 80), (5, 25, 40)])
def test_collocations(df, least, top, cover):
    got = phrases.collocations(phrases.frequent(df, least=least)[0], top, cover).collect()
    assert sorted(map(tuple, got)) == slow(ROWS, least, top, cover)


def test_crowded_bitmap_counts_more_never_fewer(df, monkeypatch):
    real = phrases.Filter.has
    monkeypatch.setattr(phrases, "LOWERED", 2)
    full = phrases.Filter(__import__("numpy").full(1 << 17, 255, "uint8"), 20)
    assert real(full, __import__("numpy").array([1, 2**63], "uint64")).all()
    found, _ = phrases.frequent(df, least=4, sample=0.2, max_bits=20)
    assert found.where("k > 0").count() == sum(n >= 4 for n in slow_counts(ROWS)[0].values())


def test_scores_are_exact_beyond_64_bits(spark):
    """Counts of which the products pass 64 bits."""
    big = 4_000_000_000_000_000_003
    rows = [("en", 0, "", big), ("en", 1, "a", big), ("en", 1, "b", big - 1), ("en", 2, "a b", big - 7), ("en", 3, "a b a", 31), ("en", 2, "b a", 40)]
    found = spark.createDataFrame(rows, "lang string, k int, phrase string, n bigint")
    got = {r.phrase: tuple(r) for r in phrases.collocations(found).collect()}
    assert got["a b"] == ("en", 1, "a b", big - 7, big, big - 1, big, 2_000_000 * (big - 7) // (2 * big - 1))


def test_empty_table(df):
    found, passes = phrases.frequent(df.where("doc_id < -1"))
    assert found.count() == 0 and passes == 1 and phrases.collocations(found).count() == 0


def test_query_against_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    rel = con.sql(phrases.OP11_SQL)
    assert sorted(tuple(r[c] for c in rel.columns) for r in phrases.op11_phrases(spark, sf_dir).collect()) == sorted(rel.fetchall())
