import hashlib
from collections import defaultdict

from wrackline.llm import common, exact_dedup

from .conftest import corpus


def lowered(text):
    return (text or "").encode().lower()


def brute():
    groups = defaultdict(list)
    for i, t in corpus():
        groups[lowered(t)].append(i)
    out = []
    for i, t in corpus():
        g = groups[lowered(t)]
        top = max((x for x in g if x is not None), default=None)
        out.append((i, top, len(g), i == top, hashlib.sha256(lowered(t)).hexdigest()))
    return sorted(out, key=str)


def test_against_brute_force(docs):
    assert sorted((tuple(r) for r in exact_dedup.find_copies(docs).collect()), key=str) == brute()


def test_shuffled_probe_gives_the_same(docs, monkeypatch):
    monkeypatch.setattr(exact_dedup, "BROADCAST_WORDS", -1)
    assert sorted((tuple(r) for r in exact_dedup.find_copies(docs).collect()), key=str) == brute()


def test_crowded_filter_gives_the_same(docs, monkeypatch):
    monkeypatch.setattr(exact_dedup, "BITS_PER_ROW", 1)
    monkeypatch.setattr(exact_dedup, "SALTS", 2)
    assert sorted((tuple(r) for r in exact_dedup.find_copies(docs).collect()), key=str) == brute()


def test_drop_copies_keeps_rows_as_they_are(docs):
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    want = sorted({b[4]: str(b[0]) for b in brute() if b[3]}.values())
    assert sorted(str(r.doc_id) for r in kept.collect()) == want


def test_one_row_of_a_group_stays(spark, monkeypatch):
    """Rows that repeat an id, have none, or share an id with another text."""
    rows = [(3, "a"), (3, "A"), (None, "a"), (None, "q"), (None, "Q"), (5, "k"), (5, "v")]
    df = spark.createDataFrame(rows, "doc_id int, text string").coalesce(2)
    for many in (exact_dedup.BROADCAST_WORDS, -1):
        monkeypatch.setattr(exact_dedup, "BROADCAST_WORDS", many)
        monkeypatch.setattr(common, "BROADCAST_KEYS", many)
        assert sorted(str((r.doc_id, r.text.lower())) for r in exact_dedup.drop_copies(df).collect()) == ["(3, 'a')", "(5, 'k')", "(5, 'v')", "(None, 'q')"]


def test_empty_table(empty):
    assert exact_dedup.find_copies(empty).count() == 0
    assert exact_dedup.drop_copies(empty).count() == 0
