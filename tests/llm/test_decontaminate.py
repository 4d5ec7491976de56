import re

import pytest

from wrackline.llm import decontaminate as dc

from .conftest import corpus, prose

WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
ITEMS = [(1, prose(1, 40)), (2, "one"), (3, None), (4, "?!"), (5, prose(9, 30)), (6, prose(2, 15)), (7, prose(2, 15)), (8, "mi TAG")]


def words(text):
    return WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows, items=ITEMS):
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - 12)) if w else ():
            windows.setdefault(tuple(w[i : i + 13]), set()).add(str(item))
    out = []
    for i, text in rows:
        w, hit, found = words(text), set(), set()
        for n in {len(k) for k in windows}:
            for p in range(len(w) - n + 1):
                if held := windows.get(tuple(w[p : p + n])):
                    hit.update(range(p, p + n))
                    found |= held
        out.append((i, len(w), len(hit), ",".join(sorted(found)), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def found(df):
    rows = []
    for r in df.collect():
        n = sum(b - a for a, b in zip(r.hit_starts, r.hit_ends, strict=True))
        rows.append((r.doc_id, r.n_words, n, ",".join(r.item_ids), n > 0 and 20 * n >= r.n_words))
    return sorted(rows, key=str)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(ITEMS, "item_id bigint, text string")


@pytest.mark.parametrize("part", [1_000_000, 9])
def test_against_brute_force(docs, items, part):
    assert found(dc.scan_benchmark(docs.select("doc_id", "text"), items, part_windows=part)) == brute(corpus())


@pytest.mark.parametrize(("part", "hits"), [(1_000_000, 9), (9, 9), (9, -1)])
def test_drop(docs, items, part, hits, monkeypatch):
    monkeypatch.setattr(dc, "BROADCAST_HITS", hits)
    kept = dc.drop_contaminated(docs, items, part_windows=part)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(b[0]) for b in brute(corpus()) if not b[4])


def test_empty_tables(docs, empty, items):
    assert dc.scan_benchmark(empty.select("doc_id", "text"), items).count() == 0
    assert dc.drop_contaminated(docs, items.limit(0)).count() == len(corpus())
