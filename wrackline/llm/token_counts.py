"""Token counts by byte-pair merging over a heap and a linked list, without making ids.

A vocabulary file's merges rank the pairs. Each distinct word starts as one symbol per byte (the last one carries the
end-of-word suffix); the lowest-rank adjacent pair is popped and merged until no pair has a rank. The word's token count
is its symbols less its merges. A text's count is the sum over its words, plus one for every special string in it, which
the tokenizer cuts out before anything else. A word of n bytes takes O(n log n), so long unbroken runs are fine.

Defined results: a null or empty text has 0 bytes and 0 tokens; special strings count one each, as the library does by
default; very long texts are counted whole; null ids are carried; repeated rows are counted one by one; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

import heapq
import json
import unicodedata

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, map_text, table

LIMIT = 2048
#: Words remembered in a worker; at that many a new generation begins, which takes over from the last one what is still met.
REMEMBERED = 400_000
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def merge_count(symbols: list[int], rank: dict[int, int], merged: list[int]) -> int:
    """Merges that byte-pair encoding makes in symbols: lowest rank first, the leftmost of equals.

    rank: of the pair a, b under a << 20 | b. merged: the symbol that the merge of each rank makes.
    """
    n = len(symbols)
    held, after, before = [*symbols, -1], list(range(1, n + 2)), list(range(-1, n))
    heap = [r << 32 | i for i in range(n - 1) if (r := rank.get(held[i] << 20 | held[i + 1])) is not None]
    heapq.heapify(heap)
    merges = 0
    while heap:
        top = heapq.heappop(heap)
        i, r = top & 0xFFFFFFFF, top >> 32
        a, j = held[i], after[i]
        if a < 0 or j >= n or rank.get(a << 20 | held[j]) != r:  # one of the two has been merged since
            continue
        a = held[i] = merged[r]
        held[j] = -1
        merges += 1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            if (r := rank.get(a << 20 | held[k])) is not None:
                heapq.heappush(heap, r << 32 | i)
        h = before[i]
        if h >= 0 and (r := rank.get(held[h] << 20 | a)) is not None:
            heapq.heappush(heap, r << 32 | h)
    return merges


def byte_symbols() -> list[str]:
    """The printable symbol of each byte in byte-level vocabularies: itself where printable, else the next from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class WordCounter:
    """Counts the tokens of texts by a tokenizers .json file: NFC, lower case, a split pattern, byte symbols with a word end."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        number = model["vocab"]
        self.rank = {number[a] << 20 | number[b]: i for i, (a, b) in enumerate(pairs)}
        self.merged = [number[a + b] for a, b in pairs]
        self.inner = [number[s] for s in byte_symbols()]
        self.last = [number[s + self.suffix] for s in byte_symbols()]
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
        self.words = regex.compile(split.replace(r"\s", _SPACE)).findall
        specials = [t["content"] for t in spec["added_tokens"]]
        self.specials = regex.compile("|".join(regex.escape(s) for s in sorted(specials, key=len, reverse=True))) if specials else None
        self.marks = tuple(specials)
        self.known: dict[str, int] = {}
        self.older: dict[str, int] = {}

    def word(self, word: str) -> int:
        raw = word.encode()
        symbols = [self.inner[b] for b in raw]
        symbols[-1] = self.last[raw[-1]]
        return len(symbols) - merge_count(symbols, self.rank, self.merged)

    def _plain(self, text: str) -> int:
        # Lower-casing goes letter by letter, so a capital sigma has one form wherever it stands.
        words = self.words(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())
        known = self.known
        try:
            return sum([known[w] for w in words])
        except KeyError:
            if len(known) > REMEMBERED:
                self.older, known = known, {}
                self.known = known
            for w in words:
                if w not in known:
                    n = self.older.get(w)
                    known[w] = self.word(w) if n is None else n
            return sum([known[w] for w in words])

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.specials is None or not any(m in text for m in self.marks):
            return self._plain(text)
        parts = self.specials.split(text)
        return len(parts) - 1 + sum(self._plain(p) for p in parts if p)


_counters: dict[str, WordCounter] = {}


def token_counts(df: DataFrame, path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit. path: the tokenizer's file, at the same place on every machine."""

    def count(part: pa.RecordBatch) -> dict:
        if path not in _counters:
            _counters[path] = WordCounter(path)
        texts = part.column("text")
        return {
            "n_bytes": pc.binary_length(texts).cast(pa.int64()),
            "n_tokens": pa.array([_counters[path].count(t) for t in texts.to_pylist()], pa.int64()),
        }

    rows = map_text(id_and_text(df, id_col, text_col), count, "n_bytes bigint, n_tokens bigint")
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)


def op8_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
