import base64
import hashlib
import random
import time

import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from wrackline.llm import byte_bpe, token_counts

from .conftest import corpus

WORD, BYTE = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.tiktoken")
RANGES = [(32, 127), (160, 600), (0x370, 0x400), (0x400, 0x460), (0x600, 0x650), (0x900, 0x950), (0x4E00, 0x4E50), (0x2000, 0x2030), (0x300, 0x340), (0x1F600, 0x1F640), (9, 14), (0x1C, 0x20), (0x85, 0x86)]


def long_words():
    """Unbroken runs of thousands of bytes, with few and many different pairs."""
    r = random.Random(6)
    draw = lambda parts, n: "".join(r.choice(parts) for _ in range(n))
    return [draw("abcdefghijklmnopqrstuvwxyz", 5000), draw("ab", 5000), "the" * 2000, draw(["the", "ing", "tion", "er", "re"], 2000), draw([chr(c) for c in range(0x4E00, 0x4E50)], 1700), "=-" * 2500, " " * 5000]


def odd_texts(n=300):
    r = random.Random(1)
    pool = [chr(c) for a, b in RANGES for c in range(a, b)]
    return ["".join(r.choices(pool, k=r.randint(1, 60))) for _ in range(n)] + ["ΣΑΣ ΟΔΟΣ İ ẞ", "a<|endoftext|>b <|startoftext|><|ENDOFTEXT|>", "don'T we'LL", " ", "\n\n  x   \t y"]


@pytest.fixture(scope="module")
def encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(BYTE, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_counts_of_odd_texts():
    library, counter = Tokenizer.from_file(WORD), token_counts.WordCounter(WORD)
    for t in odd_texts():
        assert counter.count(t) == len(library.encode(t, add_special_tokens=False).ids), repr(t)


def test_counts_forget_nothing(monkeypatch):
    monkeypatch.setattr(token_counts, "REMEMBERED", 5)
    test_counts_of_odd_texts()


def test_counts_of_corpus(docs):
    library = Tokenizer.from_file(WORD)
    want = sorted(((i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 2048) for i, t in corpus()), key=str)
    assert sorted((tuple(r) for r in token_counts.token_counts(docs, WORD).collect()), key=str) == want


def test_codes_of_odd_texts(encoding, monkeypatch):
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 50)
    coder = byte_bpe.ByteBpe(BYTE, P.PATTERN)
    texts = odd_texts() + ["x" * 700, "ab" * 300, "<|endoftext|>"] + long_words()
    for i in range(0, len(texts), 40):
        for text, (ids, decoded) in zip(texts[i : i + 40], coder.encode(texts[i : i + 40]), strict=True):
            assert [int(x) for x in ids.split()] == encoding.encode_ordinary(text)
            assert decoded == text.encode()
    assert not coder.otherwise


def test_a_wrong_vocabulary_shows(monkeypatch):
    """What comes out is what the ids decode to, not the text that went in."""
    coder = byte_bpe.ByteBpe(BYTE, P.PATTERN)
    coder.db.execute("UPDATE vocabulary SET hex = '3f' WHERE hex = '78'")
    assert [d for _, d in coder.encode(["x y", "x", "y"])] == [b"? y", b"?", b"y"]


def test_windows_agree_with_whole_words(encoding, monkeypatch):
    """Every word of three bytes or more in windows, joined or gone on from."""
    monkeypatch.setattr(byte_bpe, "LONG", 2)
    for step, far in ((8, 300), (32, 512)):
        monkeypatch.setattr(byte_bpe, "STEP", step)
        monkeypatch.setattr(byte_bpe, "FAR", far)
        coder = byte_bpe.ByteBpe(BYTE, P.PATTERN)
        texts = odd_texts(30) + [w[:200] for w in long_words()]
        for text, (ids, decoded) in zip(texts, coder.encode(texts), strict=True):
            assert [int(x) for x in ids.split()] == encoding.encode_ordinary(text) and decoded == text.encode()


def test_runs_of_signs(encoding):
    """Tokens longer than a window, runs between other signs, lengths next to the bounds."""
    r = random.Random(3)
    mixed = "".join(r.choice("-=_*#") * r.randrange(1, 200) for _ in range(40))
    texts = ["-" * n for n in (255, 256, 257, 5000)] + [mixed, "!?" * 999 + "-" * 3333 + "!" * 500, "\u3000" * 900, " " * 4000 + "x"]
    coder = byte_bpe.ByteBpe(BYTE, P.PATTERN)
    for text, (ids, decoded) in zip(texts, coder.encode(texts), strict=True):
        assert [int(x) for x in ids.split()] == encoding.encode_ordinary(text) and decoded == text.encode()


def test_words_of_a_million_letters(encoding):
    """No crash within the worker's memory limit, and time in proportion to the length."""
    r = random.Random(2)
    coder = byte_bpe.ByteBpe(BYTE, P.PATTERN)
    for text in ("a" * 1_000_000, "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=2_000_000))):
        begin = time.time()
        ids, decoded = coder.encode([text])[0]
        assert time.time() - begin < 120 and decoded == text.encode()
        assert [int(x) for x in ids.split()] == encoding.encode_ordinary(text)


def test_codes_of_corpus(docs, encoding):
    sha = lambda x: hashlib.sha256(x).hexdigest()
    want = []
    for i, t in corpus():
        ids = encoding.encode_ordinary(t or "")
        want.append((i, len(ids), sha(" ".join(map(str, ids)).encode()), sha((t or "").encode())))
    assert sorted((tuple(r) for r in byte_bpe.encode_digests(docs, BYTE, P.PATTERN).collect()), key=str) == sorted(want, key=str)
    for r in byte_bpe.encode(docs.where("doc_id IN (7, 9, 15)"), BYTE, P.PATTERN).collect():
        assert list(r.ids) == encoding.encode_ordinary(dict(corpus())[r.doc_id]) and bytes(r.decoded).decode() == dict(corpus())[r.doc_id]


def test_empty_table(empty):
    assert token_counts.token_counts(empty, WORD).count() == 0
    assert byte_bpe.encode_digests(empty, BYTE, P.PATTERN).count() == 0
