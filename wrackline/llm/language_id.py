"""Language identification: script ranges narrow the candidates, then Viterbi over per-word scores labels spans.

The model is learned from labelled rows only: for each language, counts of character pairs and triples of padded
lower-case words, hashed into a table of fixed size (`BUCKETS` for each language, so it grows with the number of
languages and not with the corpus), and counts of letters by script. Every labelled row is counted, in partial sums.

A word's script is that of its first letter. A language is a candidate for a script in which at least `SHARE` of its own
letters are written; a word has scores (log posteriors over the candidates) and other languages a low floor. The best path
over a text's words, with a penalty for each switch, gives it labelled spans; the language with the most letters is the
prediction and its share of the letters the score.

Defined results: null texts and texts without a letter are `und` with score 0; so is every text if nothing is labelled.
Ties go to the first language by name. Very long texts are labelled whole; null ids count as the empty text in the choice of
held-out rows and are carried; repeated rows are predicted one by one; an empty table gives an empty result; other columns
than text and lang are not read, and `identify` gives them back as they came.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fold, table, text_chunks, text_of

BUCKETS = 1 << 16
SHARE = 0.01
SWITCH, LEAST, OUTSIDE = 4.0, -8.0, -20.0
UND = "und"
#: Bytes of text that go through Viterbi in step.
TEXTS = 2 << 20
WORD = re.compile(r"[^\W\d_]+")
#: First code point of each range and its script; fixed values of the Unicode block layout.
SCRIPTS = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"),
    (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Indic"), (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"),
    (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, "Other"), (0x1780, "Khmer"),
    (0x1800, "Other"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Other"), (0x2C60, "Latin"), (0x2C80, "Other"),
    (0x2E80, "Han"), (0x3040, "Kana"), (0x3130, "Hangul"), (0x3190, "Han"), (0xA000, "Other"), (0xAC00, "Hangul"), (0xD7B0, "Other"),
    (0xF900, "Han"), (0xFB00, "Other"), (0x20000, "Han"),
]
_STARTS = np.array([s for s, _ in SCRIPTS])
_NAMES = sorted({n for _, n in SCRIPTS})
_NUMBER = np.array([_NAMES.index(n) for _, n in SCRIPTS])


def words_of(text: str | None) -> list[str]:
    """Lower-case runs of signs that hold a letter (a run of other numerals, such as fractions, is none)."""
    return [w for w in WORD.findall((text or "").lower()) if w.isalpha() or any(c.isalpha() for c in w)]


def scripts_of(words: list[str]) -> np.ndarray:
    first = np.array([ord(w[0]) for w in words], np.int64)
    return _NUMBER[np.searchsorted(_STARTS, first, side="right") - 1]


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the character pairs and triples of padded words, and the word that each belongs to."""
    text = np.frombuffer("".join([f"\x02{w}\x03" for w in words]).encode("utf-32-le"), np.uint32).astype(np.uint64)
    sizes = np.array([len(w) for w in words]) + 2
    word = np.repeat(np.arange(len(words)), sizes)
    a, b, c = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
    two = text[:-1] * a + text[1:] * b
    three = two[:-1] + text[2:] * c + np.uint64(1)
    mix = lambda h: (((h ^ (h >> np.uint64(29))) * b) >> np.uint64(48)).astype(np.int64)
    in2, in3 = word[:-1] == word[1:], word[:-2] == word[2:]
    return np.concatenate((mix(two[in2]), mix(three[in3]))), np.concatenate((word[:-1][in2], word[:-2][in3]))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial sums (lang, bucket, n); buckets from BUCKETS on count letters by script."""
    for part in text_chunks(batches, TEXTS):
        words: dict[str, Counter] = defaultdict(Counter)
        for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist(), strict=True):
            words[lang].update(words_of(text))
        for lang, seen in words.items():
            if not seen:
                continue
            own, n = list(seen), np.array(list(seen.values()))
            bucket, word = grams(own)
            total = np.bincount(bucket, n[word], BUCKETS)
            script = np.bincount(scripts_of(own), n * [len(w) for w in own], len(_NAMES))
            total = np.concatenate((total, script)).astype(np.int64)
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(at), pa.string()), "bucket": pa.array(at.astype(np.int32)), "n": pa.array(total[at])})


class Model:
    """Log probabilities and script candidates of each language."""

    def __init__(self, counts: pa.Table):
        self.langs = sorted(counts.column("lang").unique().to_pylist())
        n = np.zeros((len(self.langs), BUCKETS + len(_NAMES)))
        lang = pc.index_in(counts.column("lang"), pa.array(self.langs, pa.string())).to_numpy()
        n[lang, counts.column("bucket").to_numpy()] = counts.column("n").to_numpy()
        grams_n, letters = n[:, :BUCKETS] + 0.1, n[:, BUCKETS:]
        self.log = np.log(grams_n / grams_n.sum(axis=1, keepdims=True)).astype(np.float32).T.copy()
        self.candidate = (letters >= SHARE * np.maximum(letters.sum(axis=1, keepdims=True), 1)).T  # script, language

    def word_scores(self, words: list[str]) -> np.ndarray:
        bucket, word = grams(words)
        order = np.argsort(word, kind="stable")
        starts = np.searchsorted(word[order], np.arange(len(words)))
        score = np.add.reduceat(self.log[bucket[order]], starts, axis=0)
        ok = self.candidate[scripts_of(words)]
        none = ~ok.any(axis=1)
        score = np.where(ok, score, -np.inf)
        score[none] = 0
        top = score.max(axis=1, keepdims=True)
        score = score - top - np.log(np.exp(score - top).sum(axis=1, keepdims=True))
        return np.where(ok | none[:, None], np.maximum(score, LEAST), OUTSIDE).astype(np.float32)

    def label(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """For every text, a language number and a letter count for each of its words: all texts go through Viterbi in step."""
        words = [words_of(t) for t in texts]
        number: dict[str, int] = {}
        flat = np.array([number.setdefault(w, len(number)) for ws in words for w in ws], np.int64)
        if not len(flat) or not self.langs:
            return [np.zeros(0, np.int64)] * len(texts), [np.zeros(0, np.int64)] * len(texts)
        score = self.word_scores(list(number))[flat]
        letters = np.array([len(w) for w in number])[flat]
        sizes = np.array([len(ws) for ws in words])
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        order = np.argsort(-sizes, kind="stable")
        begin, size = starts[order], sizes[order]
        active = len(size) - np.searchsorted(size[::-1], np.arange(size[0]), side="right")  # texts longer than t
        best = np.zeros((len(size), len(self.langs)), np.float32)
        back = []
        own = np.arange(len(self.langs), dtype=np.int16)
        for t in range(size[0]):
            k = active[t]
            now = best[:k]
            if t:
                lead = now.argmax(axis=1)
                other = now[np.arange(k), lead] - SWITCH
                stay = now >= other[:, None]
                back.append(np.where(stay, own, lead[:, None]).astype(np.int16))
                now = np.where(stay, now, other[:, None])
            best[:k] = now + score[begin[:k] + t]
        label = np.zeros(len(flat), np.int64)
        state = best.argmax(axis=1)
        for t in range(size[0] - 1, -1, -1):
            k = active[t]
            label[begin[:k] + t] = state[:k]
            if t:
                state[:k] = back[t - 1][np.arange(k), state[:k]]
        return np.split(label, starts[1:]), np.split(letters, starts[1:])


def learn(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text") -> Model:
    """The model of all rows with a language. What comes to the driver has at most BUCKETS and a few numbers for a language."""
    rows = labelled.where(labelled[lang_col].isNotNull()).select(labelled[lang_col].cast("string").alias("lang"), F.coalesce(labelled[text_col], F.lit("")).alias("text"))
    counts = rows.mapInArrow(_counts, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    return Model(counts.toArrow())


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Every row of docs as `row`, with lang_pred, score and spans: (first word, word after the last, language) in order."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.struct("*").alias("row"))
    span = pa.list_(pa.struct([("first_word", pa.int32()), ("end_word", pa.int32()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for part in text_chunks(batches, TEXTS, name=text_col):
            langs, scores, spans = [], [], []
            for label, letters in zip(*m.label(text_of(part, text_col).to_pylist()), strict=True):
                if not len(label):
                    langs.append(UND), scores.append(0.0), spans.append([])
                    continue
                share = np.bincount(label, letters, len(m.langs))
                langs.append(m.langs[share.argmax()]), scores.append(float(share.max() / share.sum()))
                cut = np.concatenate(([0], np.flatnonzero(np.diff(label)) + 1, [len(label)])).tolist()
                spans.append([{"first_word": a, "end_word": b, "lang": m.langs[label[a]]} for a, b in zip(cut, cut[1:], strict=False)])
            yield pa.RecordBatch.from_pydict({"row": part.column("row"), "lang_pred": pa.array(langs, pa.string()), "score": pa.array(scores, pa.float64()), "spans": pa.array(spans, span)})

    found = T._parse_datatype_string("lang_pred string, score double, spans array<struct<first_word:int,end_word:int,lang:string>>")
    return rows.mapInArrow(run, T.StructType([rows.schema["row"], *found.fields]))


def held_out(doc_id: Column) -> Column:
    return fold(doc_id, 4) == 2


def _own_model(docs: DataFrame) -> Model:
    return learn(docs.where(~held_out(docs["doc_id"])))


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows of docs that have a language, in however many of them they are written; texts without a letter go.

    Where nothing is labelled there is no language to tell, and texts with letters stay.
    """
    found = identify(docs, _own_model(docs))
    return found.where((F.col("lang_pred") != UND) | F.coalesce(F.col("row.text").rlike(r"\p{L}"), F.lit(False))).select("row.*")


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = identify(docs.select("doc_id", "text"), _own_model(docs))
    return found.select("row.doc_id", held_out(F.col("row.doc_id")).alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))
