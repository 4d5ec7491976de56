import random

import pytest
import xxhash

from wrackline.llm import common, simhash
from wrackline.llm.components import components

from .conftest import corpus


def slow_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def least(nodes, linked):
    """Least node that each node reaches."""
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a in nodes:
        for b in nodes:
            if linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_fingerprints():
    for _, text in corpus():
        assert simhash.fingerprint(text) == slow_fingerprint(text)


def near(n=400, seed=3):
    """Fingerprints in chains of near ones, and a crowd about one centre."""
    r = random.Random(seed)
    out = {0}
    for _ in range(12):
        x = r.getrandbits(64)
        for _ in range(12):
            out.add(x)
            for b in r.sample(range(64), r.choice((1, 2, 3, 4, 5))):
                x ^= 1 << b
    centre = r.getrandbits(64)
    while len(out) < n:
        y = centre
        for b in r.sample(range(64), r.randint(1, 6)):
            y ^= 1 << b
        out.add(y)
    return sorted(x - (1 << 64) if x >> 63 else x for x in out)


def brute_roots(fps, bits=3):
    return least(fps, lambda a, b: a != b and ((a ^ b) % (1 << 64)).bit_count() <= bits)


@pytest.mark.parametrize("bits", [0, 1, 2, 4, 5, 6])
def test_other_distances(spark, monkeypatch, bits):
    """Also differences of one bit in each of many bytes, which leave few bytes to share."""
    fps = set(near(220))
    for x in list(fps)[:40]:
        y = x
        for p in random.Random(x).sample(range(8), max(bits, 1)):
            y ^= 1 << 8 * p
        fps.add(y - (1 << 64) if y >> 63 == 1 else y)
    fps = sorted(fps)
    df = spark.createDataFrame([(f,) for f in fps], "fp bigint")
    for short, middle, block in ((48, 2048, 1024), (1, 3, 4)):
        for name, value in (("SHORT", short), ("MIDDLE", middle), ("BLOCK", block)):
            monkeypatch.setattr(simhash, name, value)
        roots = {f: f for f in fps} | {r.node: r.root for r in components(simhash.links(df, bits)).collect()}
        assert roots == brute_roots(fps, bits)


@pytest.mark.parametrize("bits", [-1, 8])
def test_distances_that_share_no_byte(bits):
    with pytest.raises(ValueError, match="bits"):
        simhash.posted_sets(bits)


def test_links_connect_what_brute_force_connects(spark, monkeypatch):
    for short, middle, block in ((48, 2048, 1024), (2, 2048, 16), (2, 3, 4), (1, 1, 16), (10_000, 10_000, 1024)):
        monkeypatch.setattr(simhash, "SHORT", short)
        monkeypatch.setattr(simhash, "MIDDLE", middle)
        monkeypatch.setattr(simhash, "BLOCK", block)
        fps = near()
        df = spark.createDataFrame([(f,) for f in fps], "fp bigint")
        found = simhash.links(df)
        roots = {f: f for f in fps} | {r.node: r.root for r in components(found).collect()}
        assert roots == brute_roots(fps)


def test_near_duplicates_against_brute_force(docs):
    fps = [(i, slow_fingerprint(t)) for i, t in corpus()]
    roots = least({f for _, f in fps}, lambda a, b: (a ^ b).bit_count() <= 3)
    low = {}
    for i, f in fps:
        if i is not None:
            low[roots[f]] = min(low.get(roots[f], i), i)
    want = sorted(((i, f, low.get(roots[f])) for i, f in fps), key=str)
    got = sorted(((r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == want


def test_drop_near_duplicates(docs, monkeypatch):
    one = simhash.drop_near_duplicates(docs)
    assert one.columns == docs.columns
    ids = sorted(str(r.doc_id) for r in one.collect())
    assert "2" not in ids and "17" not in ids and "1" in ids and ids.count("16") == 1
    monkeypatch.setattr(common, "BROADCAST_KEYS", -1)
    assert sorted(str(r.doc_id) for r in simhash.drop_near_duplicates(docs).collect()) == ids


def test_one_row_of_a_component_stays(spark):
    """Rows that repeat an id, have none, or share an id with another text."""
    rows = [(3, "a b c d"), (3, "a b c d"), (None, "a b c d"), (None, "q r s t u"), (None, "q r s t u"), (5, "k l m n o"), (5, "v w x y z")]
    df = spark.createDataFrame(rows, "doc_id int, text string").coalesce(2)
    assert sorted(str(tuple(r)) for r in simhash.drop_near_duplicates(df).collect()) == ["(3, 'a b c d')", "(5, 'k l m n o')", "(5, 'v w x y z')", "(None, 'q r s t u')"]


def test_empty_table(empty):
    assert simhash.near_duplicates(empty).count() == 0
