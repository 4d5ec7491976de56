"""The registered corpus queries, column by column, on the smallest table."""

import base64
import hashlib
import zlib

import duckdb
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from wrackline.llm import registry

from .test_secrets import slow as slow_secrets
from .test_simhash import least, slow_fingerprint
from .test_substring_dedup import brute as repeated_spans


def sha(x):
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def run(spark, sf_dir):
    return lambda name: {r.doc_id: r for r in registry.queries()[name](spark, sf_dir).collect()}


def test_op1(run, texts):
    got = run("op1_simhash")
    fps = {i: slow_fingerprint(t) for i, t in texts.items()}
    roots = least({*fps.values()}, lambda a, b: (a ^ b).bit_count() <= 3)
    low = {}
    for i, f in fps.items():
        low[roots[f]] = min(low.get(roots[f], i), i)
    assert {i: (r.fingerprint, r.component_id) for i, r in got.items()} == {i: (f"{f:016x}", low[roots[f]]) for i, f in fps.items()}


def test_op2(run, texts):
    got = run("op2_substring_dedup")
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.values()) == sorted(repeated_spans(list(texts.items())))
    assert all(r.repeated == (r.n_removed > 0) for r in got.values())


def test_op3_and_op4(run, texts):
    for name, parts, out in (("op3_toxicity", 3, 1), ("op4_language_id", 4, 2)):
        got = run(name)
        assert got.keys() == texts.keys() and all(r.held_out == (zlib.crc32(str(i).encode()) % parts == out) and 0 <= r.score <= 1 for i, r in got.items())
        if name == "op3_toxicity":
            assert all(r.predicted == (r.score >= 0.7) for r in got.values())
        else:
            assert all((r.lang_pred == "und") == (not any(c.isalpha() for c in texts[i] or "")) for i, r in got.items())


def test_op5(run, texts):
    got = run("op5_licences")
    assert got.keys() == texts.keys() and {r.origin for r in got.values()} <= {"own", "none"}
    assert all((r.licence is None) == (r.origin == "none") and (r.score is None or r.score >= 0.6) for r in got.values())


@pytest.mark.parametrize("name", ["op6_exact_dedup", "op10_decontaminate"])
def test_sql(run, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    rel = con.sql(registry.oracle_sql()[name])
    got = run(name)
    assert sorted(tuple(r[c] for c in rel.columns) for r in got.values()) == sorted(rel.fetchall())


def test_op7(run, texts):
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for i, r in run("op7_byte_bpe").items():
        ids = library.encode_ordinary(texts[i] or "")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(texts[i] or ""))


def test_op8(run, texts):
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    for i, r in run("op8_token_counts").items():
        n = len(library.encode(texts[i] or "", add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((texts[i] or "").encode()), n, n > 2048)


def test_op9(run, texts):
    for i, r in run("op9_secrets").items():
        base = slow_secrets(texts[i] or "")
        spans = r.spans.split(",") if r.spans else []
        assert r.base_sha256 == sha(base) and ",".join(s for s in spans if not s.startswith("random:")) == base
        assert [r.n_assign, r.n_access, r.n_hex, r.n_random] == [sum(s.startswith(f"{k}:") for s in spans) for k in ("assign", "access", "hex", "random")]
