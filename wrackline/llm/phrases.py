"""Phrase collocations by Toivonen's mining: a sample proposes, one full pass decides, and what it missed is counted in further passes.

Texts are lower-cased (A-Z), cut into pieces at `[.,;:!?\\x0A-\\x0D]` and pieces into words at blanks and tabs; everything is
counted by language. Frequent means at least `least` occurrences.

1. A sample of the documents is mined with a lowered threshold: words and pairs first, then, level by level, longer phrases
   whose parts passed. Its phrases are the proposals.
2. A full pass counts the proposals and their negative border exactly: every word, and every longer phrase that occurs and
   whose first and last part (all but one word) are proposals.
3. Border phrases that turn out frequent are failures of the sample: phrases that contain them weren't counted. An expansion
   pass counts these: every uncounted phrase of any length none of whose counted parts is infrequent. That is the whole
   closure of the failures at once, so nothing is left to fail after it; without failures there is no such pass. A phrase
   is counted in one pass and there in full, so the counts are exact whatever the sample was.

Proposals reach the workers as a bitmap of hashed phrases whose size is bounded (`max_bits`). A false hit in it, or a crowded
map on a very large corpus, makes more phrases be counted, never fewer. Counts are summed in a batch, in a task and then in
the shuffle, so a word that fills a third of the corpus is one row a task. Scores are decimal integer arithmetic.

Defined results: null and empty texts have no words; a null language is `und`; very long texts are counted in parts that
carry their last words on, so none is cut off or counted twice; repeated rows count each time; an empty table gives an
empty result. Phrases of equal score and count are ordered by their UTF-8 bytes. Only the named columns are read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, table, text_chunks

LEAST, LONGEST, TOP, COVER = 30, 4, 2000, 80
#: Share of the documents that proposes. A phrase of 30 occurrences is then met three times on average, and twice is asked for.
SAMPLE, LOWERED = 0.1, 2
#: Sixteen bits a proposal, up to 64 MB.
MAX_BITS = 29
_SEGMENT = 20
#: Bytes of text that are counted together.
PART_BYTES = 8 << 20
#: Rows of a single word, which many phrases may start or end with, are spread over so many keys in joins.
SALTS = 16

_BREAK = b"."
#: Ends the language in a key; words never hold it.
_KEY = b"."
_TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz" + _BREAK * 9)
_CUT = re.compile(rb"[ \t.,;:!?\n\x0b\x0c\r]")
_MUL, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD)


class _Ids(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class Filter:
    """A set of hashed phrases; may hold more than it was given, never less."""

    def __init__(self, bitmap: np.ndarray, log_bits: int):
        self.bitmap, self.shift = bitmap, np.uint64(64 - log_bits)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes >> self.shift
        return (self.bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


class _All:
    def has(self, hashes: np.ndarray) -> np.ndarray:
        return np.ones(len(hashes), bool)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(29))


class _Tokens:
    """Words of a stretch of text by number; 0 ends a piece. carried: how many of the first ones were counted before."""

    def __init__(self, tokens: list[bytes], lang: str, carried: int = 0):
        ids = _Ids({_BREAK: 0})
        self.ids = np.fromiter(map(ids.__getitem__, tokens), np.int32, len(tokens))
        self.words, self.carried, seed = list(ids), carried, xxhash.xxh32_intdigest(lang.encode())
        self.hashes = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in self.words), np.uint64, len(ids))

    def levels(self, proposed, decided, longest: int) -> Iterator[tuple]:
        """For k = 1, 2, ...: k, hashes of the k words at each place, and where a k-gram is countable, and where one may be frequent.

        proposed: what was countable in the first pass follows from it. decided: None in the first pass; later the frequent
        ones of those counted there. A phrase may be frequent if its parts may and it wasn't found to be otherwise.
        """
        real = np.arange(len(self.words)) > 0
        hashes = self.hashes[self.ids]
        word = proposed.has(_mixed(self.hashes)) & real
        old = word[self.ids]
        now = old if decided is None else (decided.has(_mixed(self.hashes)) & real)[self.ids]
        yield 1, hashes, (self.ids > 0) if decided is None else np.zeros(len(self.ids), bool), now
        for k in range(2, longest + 1):
            if len(self.ids) < k:
                return
            hashes = hashes[:-1] * _MUL + self.hashes[self.ids[k - 1 :]]
            counted = old[:-1] & old[1:]
            if decided is None:
                old = now = _where(counted, proposed, hashes)
                yield k, hashes, counted, now
                continue
            parts = now[:-1] & now[1:]
            old = _where(counted, proposed, hashes)
            now = _where(parts & counted, decided, hashes) | (parts & ~counted)
            yield k, hashes, parts & ~counted, now

    def counts(self, places: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """A place of each distinct k-gram at the places, and how often it ends after the carried words."""
        key, size, words = self.ids[places].astype(np.int64), len(self.words), len(self.words)
        for j in range(1, k):
            if size > 2**62 // words:
                key, size = pd.factorize(key)[0], len(key)
            key, size = key * words + self.ids[places + j], size * words
        codes, distinct = pd.factorize(key)
        first = np.empty(len(distinct), np.int64)
        first[codes[::-1]] = places[::-1]
        n = np.bincount(codes[places + k > self.carried] if self.carried else codes, minlength=len(distinct))
        return first[n > 0], n[n > 0]

    def texts(self, place: np.ndarray, k: int, lang: str) -> pa.Array:
        """Language and words, joined into one key."""
        words = pa.array(self.words, pa.binary())
        parts = [words.take(pa.array(self.ids[place + j])) for j in range(k)]
        parts[0] = pc.binary_join_element_wise(lang.encode(), parts[0], _KEY)
        return pc.binary_join_element_wise(*parts, b" ").cast(pa.string())


def _where(mask: np.ndarray, chosen, hashes: np.ndarray) -> np.ndarray:
    out = np.zeros(len(mask), bool)
    at = np.flatnonzero(mask)
    out[at] = chosen.has(_mixed(hashes[at]))
    return out


def _stretches(texts: list[bytes], lang: str, part_bytes: int, longest: int) -> Iterator[_Tokens]:
    """The texts as one stretch of words, or several if it is long; a later one starts with the last words of the one before."""
    joined = (b" " + _BREAK + b" ").join(texts)
    start, tail = 0, []
    while start < len(joined) or start == 0:
        cut = _CUT.search(joined, start + part_bytes) if len(joined) - start > part_bytes else None
        end = cut.start() if cut else len(joined)
        tokens = joined[start:end].translate(_TABLE).replace(_BREAK, b" " + _BREAK + b" ").split()
        done, tail, carried = tail + tokens if tail else tokens, (tail + tokens)[1 - longest :] if cut and longest > 1 else [], len(tail)
        del tokens
        held = _Tokens(done, lang, carried)
        del done
        yield held
        if not cut:
            return
        start = end


def _by_lang(batch: pa.RecordBatch) -> Iterator[tuple[str, list[bytes]]]:
    texts, langs = batch.column("text").cast(pa.binary()).to_pylist(), batch.column("lang").to_pylist()
    groups: dict[str, list[bytes]] = {}
    for lang, text in zip(langs, texts, strict=True):
        groups.setdefault(lang, []).append(text)
    yield from groups.items()


def _docs(df: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    return df.select(
        df[id_col].alias("doc_id"), F.coalesce(df[text_col].cast("string"), F.lit("")).alias("text"), F.coalesce(df[lang_col].cast("string"), F.lit("und")).alias("lang")
    )


def _count(docs: DataFrame, proposed: _Sent, decided: _Sent | None, longest: int, part_bytes: int) -> DataFrame:
    """(lang, k, phrase, n) summed over docs: phrases that the proposals make countable, or, with decided, those that its failures make countable beyond them. k = 0: all words."""
    held = [x and x.filter for x in (proposed, decided)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = [x and x.value for x in held]
        for batch in text_chunks(batches, part_bytes, 1 << 20):
            for lang, texts in _by_lang(batch):
                for tokens in _stretches(texts, lang, part_bytes, longest):
                    for k, _, countable, _ in tokens.levels(*filters, longest):
                        place, n = tokens.counts(np.flatnonzero(countable), k)
                        if len(n):
                            yield pa.RecordBatch.from_pydict({"key": tokens.texts(place, k, lang), "n": pa.array(n)})
                        if k == 1 and len(n):
                            yield pa.RecordBatch.from_pydict({"key": [lang + _KEY.decode()], "n": [int(n.sum())]})

    rows = docs.select("text", "lang").mapInArrow(run, "key string, n bigint").groupBy("key").agg(F.sum("n").alias("n"))
    rows = rows.withColumn("phrase", F.substring_index("key", _KEY.decode(), -1))
    lang = F.expr("left(key, length(key) - length(phrase) - 1)")
    return rows.select(lang.alias("lang"), F.when(F.col("phrase") == "", 0).otherwise(F.size(F.split("phrase", " "))).alias("k"), "phrase", "n")


def _propose(sample: DataFrame, earlier: _Sent | None, low: int, high: int, lowered: int, part_bytes: int) -> DataFrame:
    """h: hashed phrases of low to high words, with parts among the earlier proposals, that the sample has `lowered` times or more."""
    held = earlier and earlier.filter

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, part_bytes, 1 << 20):
            for lang, texts in _by_lang(batch):
                for tokens in _stretches(texts, lang, part_bytes, high):
                    for k, hashes, countable, _ in tokens.levels(held.value if held else _All(), None, high):
                        if k >= low:
                            place, n = tokens.counts(np.flatnonzero(countable), k)
                            yield pa.RecordBatch.from_pydict({"h": pa.array(_mixed(hashes[place]).view(np.int64)), "n": pa.array(n)})

    rows = sample.select("text", "lang").mapInArrow(run, "h bigint, n bigint")
    return rows.groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= lowered).select("h")


class _Sent:
    """A filter at the workers."""

    def __init__(self, hashes: DataFrame, max_bits: int):
        n = hashes.count()
        log_bits = min(max_bits, max(_SEGMENT, math.ceil(math.log2(16 * max(n, 1)))))
        inner = 1 << _SEGMENT

        def pack(rows: pa.Table) -> pa.Table:
            bits = np.zeros(inner, np.uint8)
            bits[rows["at"].to_numpy() % inner] = 1
            return pa.table({"segment": [rows["at"][0].as_py() // inner], "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

        at = F.shiftrightunsigned("h", 64 - log_bits)
        places = hashes.select(at.alias("at")).distinct()  # a segment has 2^20 places at most
        bitmap = np.zeros(1 << (log_bits - 3), np.uint8)
        for segment, bits in zip(*places.groupBy(F.shiftright("at", _SEGMENT)).applyInArrow(pack, "segment bigint, bits binary").toArrow().to_pydict().values(), strict=True):
            bitmap[segment * (inner >> 3) : (segment + 1) * (inner >> 3)] = np.frombuffer(bits, np.uint8)
        self.filter = hashes.sparkSession.sparkContext.broadcast(Filter(bitmap, log_bits))


def _hashes(found: DataFrame, proposed: _Sent) -> DataFrame:
    """(h, known) of frequent phrases: their hash, and whether the proposals made phrases that contain them countable."""
    held = proposed.filter

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups: dict[str, list[bytes]] = {}
            for lang, phrase in zip(batch.column("lang").to_pylist(), batch.column("phrase").to_pylist(), strict=True):
                groups.setdefault(lang, []).append(phrase.encode())
            for lang, phrases in groups.items():
                tokens = _Tokens((b" " + _BREAK + b" ").join(phrases).split(b" "), lang)
                ends = np.append(np.flatnonzero(tokens.ids == 0), len(tokens.ids))
                starts = np.append(0, ends[:-1] + 1)
                length, out = ends - starts, np.zeros(len(starts), np.uint64)
                known = np.zeros(len(starts), bool)
                for k, hashes, _, now in tokens.levels(held.value, None, int(length.max())):
                    own = length == k
                    out[own], known[own] = _mixed(hashes[starts[own]]), now[starts[own]]
                yield pa.RecordBatch.from_pydict({"h": pa.array(out.view(np.int64)), "known": pa.array(known)})

    return found.select("lang", "phrase").mapInArrow(run, "h bigint, known boolean")


def frequent(df: DataFrame, least: int = LEAST, longest: int = LONGEST, sample: float = SAMPLE, lowered: int = LOWERED, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_bits: int = MAX_BITS, part_bytes: int = PART_BYTES) -> tuple[DataFrame, int]:
    """(lang, k, phrase, n) of every phrase of 1 to `longest` words that occurs `least` times or more, k = 0 for all words of a language; and the number of full passes."""
    docs = _docs(df, id_col, text_col, lang_col)
    drawn = docs.where(F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(1000)) < round(1000 * sample))
    # the longest phrases need no proposal: nothing contains them
    hashes = stored(_propose(drawn, None, 1, max(1, min(2, longest - 1)), lowered, part_bytes), "proposals")
    for k in range(3, longest):
        shorter = _Sent(hashes, max_bits)
        hashes = hashes.unionByName(stored(_propose(drawn, shorter, k, k, lowered, part_bytes), "proposals"))
        shorter.filter.destroy()
    proposed = _Sent(hashes, max_bits)
    often = (F.col("n") >= least) | (F.col("k") == 0)
    found = stored(_count(docs, proposed, None, longest, part_bytes).where(often), "frequent")
    decided = stored(_hashes(found.where(F.col("k").between(1, longest - 1)), proposed), "hashes")
    if longest == 1 or decided.where(~F.col("known")).isEmpty():
        return found, 1
    return found.unionByName(stored(_count(docs, proposed, _Sent(decided.select("h"), max_bits), longest, part_bytes).where(often), "frequent")), 2


def _decimal(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(38,0)")


def _looked_up(rows: DataFrame, counts: DataFrame, part: str, out: str) -> DataFrame:
    """rows with the count of their phrase `part` as `out`. Single words, with which a large share of all phrases may start or end, are spread over salted keys."""
    single = ~F.col(part).contains(" ")
    rows = rows.withColumn("salt", F.when(single, F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).otherwise(0).cast("int"))
    spread = F.explode(F.when(F.col("k") == 1, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))
    known = counts.select("lang", F.col("phrase").alias(part), F.col("n").alias(out), spread.alias("salt"))
    return rows.join(known, ["lang", part, "salt"]).drop("salt")


def collocations(found: DataFrame, top: int = TOP, cover: int = COVER) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first `top` phrases of each language by the score of their lowest cut, without those that a longer phrase covers."""
    counts = found.where("k > 0")
    words, k = F.split("phrase", " "), F.col("k")
    cuts = counts.where("k > 1").select("lang", "phrase", "k", F.col("n").alias("a"), words.alias("words"), F.explode(F.sequence(F.lit(1), k - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", F.array_join(F.slice("words", F.lit(1), F.col("cut")), " ").alias("first"), F.array_join(F.slice("words", F.col("cut") + 1, k - F.col("cut")), " ").alias("rest"))
    both = _looked_up(_looked_up(cuts, counts, "first", "l"), counts, "rest", "r").withColumns({"product": _decimal("a") * 2_000_000, "sum": _decimal("l") + _decimal("r")})
    lowest = both.withColumn("score", F.expr("product div sum")).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("low"))
    longer = counts.where("k > 2").select("lang", F.col("n").alias("f"), "k", words.alias("words"))
    at = longer.select("lang", "f", "k", "words", F.explode(F.sequence(F.lit(2), k - 1)).alias("m")).select("*", F.explode(F.sequence(F.lit(1), k - F.col("m") + 1)).alias("i"))
    covers = at.select("lang", F.array_join(F.slice("words", F.col("i"), F.col("m")), " ").alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("f"))
    kept = lowest.join(covers, ["lang", "phrase"], "left").where(F.col("f").isNull() | (_decimal("f") * 100 < _decimal("a") * cover))
    order = Window.partitionBy("lang").orderBy(F.desc("low.score"), F.desc("a"), "phrase")
    best = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    totals = found.where("k = 0").groupBy("lang").agg(F.sum("n").alias("n"))
    return best.join(totals, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", F.col("low.l").alias("l"), F.col("low.r").alias("r"), "n", F.col("low.score").alias("score"))


def op11_phrases(spark, sf_dir: str) -> DataFrame:
    return collocations(frequent(table(spark, sf_dir, "documents"))[0])


OP11_SQL = r"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS s FROM documents),
p AS (SELECT lang, regexp_extract_all(unnest(regexp_extract_all(s, '[^.,;:!?\x0A-\x0D]+')), '[^\x20\x09]+') AS w FROM t),
g AS MATERIALIZED (
  SELECT lang, k, list_aggregate(w[i : i + k - 1], 'string_agg', ' ') AS phrase, count(*) AS f
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k) GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM g WHERE k = 1 GROUP BY 1),
c AS MATERIALIZED (SELECT lang, k, phrase, f AS a FROM g WHERE k > 1 AND f >= 30),
cut AS (SELECT lang, phrase, a, j, string_split(phrase, ' ') AS w FROM (SELECT *, unnest(range(1, k)) AS j FROM c)),
sc AS (SELECT cut.*, x.f AS l, y.f AS r, (2000000::HUGEINT * a) // (x.f::HUGEINT + y.f) AS score FROM cut
  JOIN g x ON x.lang = cut.lang AND x.phrase = array_to_string(w[1 : j], ' ') JOIN g y ON y.lang = cut.lang AND y.phrase = array_to_string(w[j + 1 :], ' ')),
low AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
kept AS (SELECT * FROM low WHERE NOT EXISTS (SELECT 1 FROM c b WHERE b.lang = low.lang AND len(string_split(b.phrase, ' ')) > len(low.w)
  AND contains(' ' || b.phrase || ' ', ' ' || low.phrase || ' ') AND 100::HUGEINT * b.a >= 80::HUGEINT * low.a)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""
