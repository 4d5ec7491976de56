import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from wrackline.llm import substring_dedup as sd

from .conftest import corpus


def brute(rows, length=400):
    count = {}
    raw = [(t or "").encode() for _, t in rows]
    for b in raw:
        for p in range(len(b) - length + 1):
            k = b[p : p + length]
            count[k] = count.get(k, 0) + 1
    out = []
    for (i, _), b in zip(rows, raw, strict=True):
        edge = np.zeros(len(b) + 1, int)
        for p in range(len(b) - length + 1):
            if count[b[p : p + length]] > 1:
                edge[p] += 1
                edge[p + length] -= 1
        cover = np.cumsum(edge[:-1]) > 0
        kept = bytes(np.frombuffer(b, np.uint8)[~cover])
        spans = int((np.diff(np.concatenate(([0], cover.astype(int)))) == 1).sum())
        out.append((i, len(b), int(cover.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def digests(df):
    removed = F.expr("aggregate(zip_with(starts, ends, (a, b) -> b - a), 0L, (x, y) -> x + y)")
    return sorted((tuple(r) for r in df.select("doc_id", "n_bytes", removed.alias("r"), F.size("starts").alias("s"), "kept").collect()), key=str)


def test_difference_cover_is_perfect():
    assert len({(a - b) % sd.MODULUS for a in sd.COVER for b in sd.COVER if a != b}) == sd.MODULUS - 1


def test_corpus_against_brute_force(docs):
    rows = [r for r in corpus() if r[0] != 12]
    assert digests(sd.repeated_spans(docs.where("doc_id IS NULL OR doc_id <> 12"), digest=True)) == brute(rows)


def test_shifted_passages(spark):
    r = random.Random(5)
    text = lambda n: "".join(r.choice("abcdefgh é") for _ in range(n))
    shared = [text(k) for k in (399, 400, 401, 533, 1200)]
    rows = [(i, text(r.randint(0, 300)) + r.choice(shared) + text(r.randint(0, 500)) + r.choice(["", r.choice(shared)])) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    assert digests(sd.repeated_spans(df, digest=True, batch_bytes=20_000)) == brute(rows)


def test_kept_bytes(docs):
    got = {r.doc_id: bytes(r.kept) for r in sd.repeated_spans(docs.where("doc_id IN (13, 9)")).collect()}
    assert got[9] == b"one" and got[13] == dict(corpus())[13].encode()


def test_empty_table(empty):
    assert sd.repeated_spans(empty).count() == 0
