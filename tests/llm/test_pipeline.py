import base64
import hashlib

import public_tokenizers as P
import tiktoken

import corpus_pipeline
from wrackline.llm import language_id

from .test_decontaminate import brute as contaminated
from .test_language_id import slow_labels
from .test_simhash import least, slow_fingerprint


def test_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    model = language_id._own_model(docs)

    def identified(text):
        words = language_id.WORD.findall((text or "").lower())
        if not words:
            return False
        share = {}
        for w, k in zip(words, slow_labels(model, words), strict=True):
            share[k] = share.get(k, 0) + len(w)
        return True

    rows = {i: t for i, t in rows.items() if identified(t)}
    last = {}
    for i, t in sorted(rows.items()):
        last[t.encode().lower()] = i
    rows = {i: rows[i] for i in last.values()}
    fps = {i: slow_fingerprint(t) for i, t in rows.items()}
    roots = least({*fps.values()}, lambda a, b: (a ^ b).bit_count() <= 3)
    first = {}
    for i in sorted(rows):
        first.setdefault(roots[fps[i]], i)
    rows = {i: rows[i] for i in first.values()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    bad = {b[0] for b in contaminated(rows.items(), items) if b[4]}
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = set()
    for i, t in rows.items():
        if i not in bad:
            ids = library.encode_ordinary(t)
            want.add((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    got = [tuple(r) for r in corpus_pipeline.run(spark, sf_dir).collect()]
    assert len(got) == len(want) and set(got) == want


def test_stages(spark, docs):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "simhash_near_dedup", "decontamination", "byte_bpe"]


def test_stages_on_odd_rows(spark, docs, empty, sf_dir, tmp_path):
    """Nulls, empty and long texts, repeated rows and clashing names go through every stage; so does an empty table."""
    for name, rows, least_kept in (("docs", docs, 5), ("empty", empty, 0)):
        rows.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        for step, stage in corpus_pipeline.STAGES:
            out = stage(spark, now, sf_dir)
            assert step == "byte_bpe" or out.columns == docs.columns
            out.write.parquet(f"{tmp_path}/{name}-{step}")
            now = spark.read.parquet(f"{tmp_path}/{name}-{step}")
        assert now.count() >= least_kept and now.columns[:1] == ["doc_id"]
