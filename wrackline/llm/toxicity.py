"""Toxicity by class-conditional Kneser-Ney models with shared backoff counts.

Two bigram models are counted over all labelled rows: one of toxic texts, one of ordinary ones. Each discounts its bigram
counts and backs off to its own continuation counts (in how many contexts a word occurs, so copies of a text add nothing);
these are discounted in turn and back off to the continuation counts of the word's stem (in how many words its first six,
then its first four letters occur), and at last to counts shared by both classes. A count up to the discount is wholly
discounted, and a context that either class has seen under `MIN_CONTEXT` times says nothing, so a rare expression has its
shared backoff probability in both models and isn't decided by chance. A word's evidence is the difference of the two
log-probabilities. A text is judged by length-normalised evidence: over the whole text, and over its strongest windows,
since a few words make a long text toxic. A logistic curve turns these into a score.

Counts, probabilities and evidence are Spark tables that grow with the corpus. Scoring needs one table (kind, key, value):
the evidence of words and stems, and what a context or a bigram adds. Entries that backing off gives anyway are left out,
which changes nothing. The table is broadcast up to `MODEL_ROWS` rows (12 bytes each). A larger one is sorted into files of
`SLICE_ROWS` rows in the shared folder, and workers look the distinct keys of `BATCH_BYTES` of text up in the files that may
hold them, one after the other: neither texts nor their keys are shuffled, and memory doesn't grow with the table. Where
workers can't open that folder through pyarrow.fs, the table is joined to the distinct keys of each text, which takes several
times the disk of the texts. Words and stems are keyed by 32 bits, bigrams by 64.

Labels come to the texts, never texts to the labels: few labels are broadcast; more are joined to the ids and places of the
texts alone and broadcast as a bit a row (`bits_of_labels`). Stored steps and shuffled files go when nothing reads them any more.

The curve is cross-fitted: on rows of one part of the labels, `CURVE_ROWS` or so, half of each class at most and weighted
back to the part's own shares, judged by counts without that part. The first row of each class belongs to that part too, so
it has both classes whenever the labels do. Rows are drawn by a threshold on their hash, where they are, and only their
features leave the task. Texts are scored by the counts of all rows.

Defined results: a null or empty text has no evidence and scores as the curve does at zero; very long texts are counted and
scored whole; without a label of either class every score is 0; rows labelled null are not learned from; several labels for
one id count one by one; null ids are carried and have no label; repeated rows are scored one by one; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .common import drop_stored, fold, id_and_text, row_keys, table, text_chunks

WORD_DISCOUNT, STEM_DISCOUNT, PAIR_DISCOUNT, MIN_CONTEXT = 3, 20, 2, 20
#: Of what backing off gives to a level, the share that falls to what the corpus has; the rest is kept for the unseen.
MET = 0.4
#: Letters of the stems, the shorter one first.
STEMS = (4, 6)
#: Bigrams are counted with all copies of a text, so a context may move a word's evidence by this much (log) at most.
PAIR_WEIGHT = 1.0
WINDOWS = (1, 3, 12, 48)
CURVE_ROWS = 20_000
#: Rows of the evidence table that are broadcast; beyond it workers read it in files of SLICE_ROWS for BATCH_BYTES of text each time.
MODEL_ROWS = 8_000_000
SLICE_ROWS = 2_000_000
BATCH_BYTES = 16 << 20
#: Labels are broadcast to the texts up to this many (some 40 bytes each); beyond it as bits by the places of the texts.
BROADCAST_LABELS = 500_000
#: Bytes of these bits that are broadcast (some two billion texts); beyond it the join is shuffled.
BROADCAST_BITS = 256 << 20
THRESHOLD = 0.7
WORD = re.compile(r"[^\W\d_]+")
#: Words remembered in a worker.
REMEMBERED = 300_000
#: Kinds of the evidence table besides the stems' lengths.
PAIR, CONTEXT, UNIT = 0, 1, 2


def number(text: str) -> int:
    """A word's or stem's key; 0 stands before the first word of a text."""
    return zlib.crc32(text.encode()) or 1


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def stem_keys(word: str) -> list[tuple[int, int]]:
    """(length, key) of the stems that are shorter than the word or as long."""
    return [(k, number(f"{k}:{word[:k]}")) for k in STEMS if len(word) >= k]


def stored(df: DataFrame, name: str) -> DataFrame:
    """As in common; what was shuffled on the way is deleted with the write, not whenever the driver collects its garbage."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, None)
    conf.set(key, "true")
    try:
        return common.stored(df, name)
    finally:
        conf.unset(key) if before is None else conf.set(key, before)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial sums (kind, pair, toxic, plain, own_toxic, own_plain); pair is first << 32 | second, own: of the curve's rows.

    kind is 0 for bigrams, else a stem's length; first is then the stem's key and second the word's, and a sum above 0 says
    that rows of the class have it (less own_*: that rows outside the curve have it). A task says so once or twice.
    """
    names = ("toxic", "plain", "own_toxic", "own_plain")
    place: dict[str, int] = {}
    numbers = seen = None
    for part in text_chunks(batches, 8 << 20, 8192):
        if len(place) > REMEMBERED or numbers is None:
            place, numbers, seen = {}, np.zeros(0, np.int64), np.zeros((0, 4), bool)
        places, new = [], []
        for text in part.column("text").to_pylist():
            words = words_of(text)
            new += (fresh := list(set(words).difference(place)))
            place.update(zip(fresh, range(len(place), len(place) + len(fresh)), strict=True))
            places.append(np.fromiter(map(place.__getitem__, words), np.int32, len(words)))
        numbers = np.concatenate((numbers, np.array([number(w) for w in new], np.int64)))
        seen = np.concatenate((seen, np.zeros((len(new), 4), bool)))
        keys, own, before = {0: [], 1: []}, {0: [], 1: []}, seen.copy()
        for y, curve, at in zip(part.column("toxic").to_pylist(), part.column("curve").to_pylist(), places, strict=True):
            n = np.concatenate(([0], numbers[at]))
            keys[y].append(n[:-1] << 32 | n[1:])
            if curve:
                own[y].append(keys[y][-1])
            else:
                seen[at, 3 - y] = True
            seen[at, 1 - y] = True
        lists = [np.concatenate([*k[y], np.zeros(0, np.int64)]) for k in (keys, own) for y in (1, 0)]
        pair = np.unique(np.concatenate(lists[:2]))
        out = {"kind": pa.array(np.zeros(len(pair), np.int32)), "pair": pa.array(pair)}
        for name, one in zip(names, lists, strict=True):
            out[name] = pa.array(np.bincount(np.searchsorted(pair, one), minlength=len(pair)).astype(np.int64))
        out = pa.RecordBatch.from_pydict(out)
        yield from (out.slice(i, 1 << 16) for i in range(0, len(pair), 1 << 16))  # the JVM holds one at a time
        fresh = np.flatnonzero((seen & ~before).any(axis=1))
        if len(fresh):
            words, n, flags = list(place), numbers[fresh].tolist(), seen[fresh]
            stems = [(k, s << 32 | n[i], i) for i, j in enumerate(fresh.tolist()) for k, s in stem_keys(words[j])]
            kind, pair, row = zip(*stems, strict=True) if stems else ((), (), ())
            flags = np.concatenate((flags[:, :2], flags[:, :2] & ~flags[:, 2:]), axis=1)[list(row)].astype(np.int64)
            out = {"kind": pa.array(kind, pa.int32()), "pair": pa.array(np.array(pair, np.uint64).view(np.int64))}
            yield pa.RecordBatch.from_pydict(out | {name: pa.array(flags[:, i]) for i, name in enumerate(names)})


class Model:
    """The evidence table, sorted by key within each kind, and the constants of what backs off to both classes alike."""

    def __init__(self, constants: dict[str, float], entries: dict[int, tuple[np.ndarray, np.ndarray]], curve: np.ndarray | None = None):
        self.constants, self.entries, self.curve = constants, entries, curve
        self._forget()

    def _forget(self) -> None:
        """A remembered word's place in arrays of its number, own evidence and what it adds as a context; place 0 is before the text."""
        self.place: dict[str, int] = {}
        self.known: tuple | None = None

    def __getstate__(self):
        return {"constants": self.constants, "entries": self.entries, "curve": self.curve}

    def __setstate__(self, state):
        self.__init__(**state)

    def find(self, kind: int, keys: np.ndarray, missing: float = 0.0) -> np.ndarray:
        held, values = self.entries.get(kind, (np.zeros(0, np.int64), np.zeros(0, np.float32)))
        if not len(held):
            return np.full(len(keys), missing)
        at = np.minimum(np.searchsorted(held, keys), len(held) - 1)
        return np.where(held[at] == keys, values[at], missing)

    def own(self, words: list[str]) -> np.ndarray:
        """Evidence of words by themselves: of a word's own entry, else of its longest stem that has one."""
        out = np.zeros(len(words))
        open_ = np.ones(len(words), bool)
        for kind in (UNIT, *reversed(STEMS)):
            at = [i for i in np.flatnonzero(open_).tolist() if kind == UNIT or len(words[i]) >= kind]
            keys = [number(words[i] if kind == UNIT else f"{kind}:{words[i][:kind]}") for i in at]
            value = self.find(kind, np.array(keys, np.int64), np.nan)
            out[at] += np.where(np.isnan(value), self.constants[str(kind)], value)
            open_[np.array(at, np.int64)[~np.isnan(value)]] = False
        return out

    def _places(self, texts: list[str | None]) -> list[np.ndarray]:
        """Remembers the words of texts; of each text, their places."""
        if len(self.place) > REMEMBERED:
            self._forget()
        if self.known is None:
            start = np.zeros(1, np.int64)
            self.known = (start, np.zeros(1), self.find(CONTEXT, start, np.nan))
        place, new, out = self.place, [], []
        for text in texts:
            words = words_of(text)
            fresh = list(set(words).difference(place))
            place.update(zip(fresh, range(len(place) + 1, len(place) + 1 + len(fresh)), strict=True))
            new += fresh
            out.append(np.fromiter(map(place.__getitem__, words), np.int32, len(words)))
        if new:
            n = np.array([number(w) for w in new], np.int64)
            self.known = tuple(np.concatenate(x) for x in zip(self.known, (n, self.own(new), self.find(CONTEXT, n, np.nan)), strict=True))
        return out

    def _evidence(self, places: list[np.ndarray]) -> np.ndarray:
        """Of every word of all texts in a row."""
        at = np.concatenate([*places, np.zeros(0, np.int32)])
        before = np.concatenate(([0], at[:-1]))[: len(at)]
        starts = np.cumsum([0, *map(len, places)])[:-1]
        before[starts[starts < len(at)]] = 0
        numbers, own, context = self.known
        out = own[at]
        met = np.flatnonzero(~np.isnan(context[before]))  # elsewhere no bigram adds anything
        pair = self.find(PAIR, numbers[before[met]] << 32 | numbers[at[met]], np.nan)
        out[met] += np.where(np.isnan(pair), context[before[met]], pair)
        return out

    def evidence(self, text: str | None) -> np.ndarray:
        """Of each word, how much likelier the toxic model has it (log)."""
        return self._evidence(self._places([text]))

    def keys(self, text: str | None) -> list[tuple[int, int]]:
        """Every (kind, key) that the evidence of a text may ask for."""
        words = words_of(text)
        n = [0, *[number(w) for w in words]]
        out = {(PAIR, a << 32 | b) for a, b in zip(n, n[1:], strict=False)} | {(CONTEXT, a) for a in n}
        for w in set(words):
            out.update([(UNIT, number(w)), *stem_keys(w)])
        return [(k, x - (1 << 64) if x >> 63 else x) for k, x in sorted(out)]

    def features(self, texts: list[str | None]) -> np.ndarray:
        """Of each text, the mean evidence of it and of its strongest windows, and the log of its length."""
        places = self._places(texts)
        out = np.zeros((len(texts), len(WINDOWS) + 2))
        every, end = self._evidence(places), 0
        for i, n in enumerate(map(len, places)):
            if n:
                end += n
                sums = np.concatenate(([0.0], np.cumsum(every[end - n : end], dtype=np.float64)))
                best = [float((sums[w:] - sums[:-w]).max() / w) if n > w else float(sums[-1] / n) for w in WINDOWS]
                out[i] = [sums[-1] / n, *best, np.log(n)]
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return _sigmoid(_widened(self.features(texts)) @ self.curve) if self.curve is not None else np.zeros(len(texts))


def _opened(path: str) -> pa.NativeFile:
    fs, at = pyarrow.fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return fs.open_input_file(at)


class FiledModel(Model):
    """A model whose evidence table stays in files sorted by kind and key. entries: (kind, least key, greatest key, path), sorted."""

    def __init__(self, constants: dict[str, float], entries: list[tuple[int, int, int, str]], curve: np.ndarray | None = None):
        self.held: dict[str, tuple] = {}
        super().__init__(constants, entries, curve)

    def _read(self, path: str) -> tuple:
        """Columns of a file. The last one read is kept: one file may hold all kinds but the bigrams."""
        if path not in self.held:
            self.held = {}
            with _opened(path) as file:
                rows = pq.read_table(file, columns=["kind", "key", "value"], use_threads=False)
            self.held = {path: tuple(rows.column(c).to_numpy() for c in ("kind", "key", "value"))}
        return self.held[path]

    def find(self, kind: int, keys: np.ndarray, missing: float = 0.0) -> np.ndarray:
        asked, back = np.unique(keys, return_inverse=True)
        out = np.full(len(asked), missing)
        for k, least, most, path in self.entries:
            lo, hi = np.searchsorted(asked, least), np.searchsorted(asked, most, "right")
            if k == kind and lo < hi:
                kinds, held, values = self._read(path)
                start, end = np.searchsorted(kinds, [kind, kind + 1])
                at = start + np.searchsorted(held[start:end], asked[lo:hi])
                at = np.minimum(at, end - 1)
                out[lo:hi] = np.where(held[at] == asked[lo:hi], values[at], out[lo:hi])
        return out[back]


def _widened(x: np.ndarray) -> np.ndarray:
    return np.concatenate((np.ones((len(x), 1)), x), axis=1)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50, times: np.ndarray | None = None) -> np.ndarray:
    """Logistic weights by Newton steps with a small ridge. times: how often each row counts, once if not given."""
    x = _widened(x)
    times = np.ones(len(x)) if times is None else times
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = _sigmoid(x @ w)
        hess = (x * (times * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, x.T @ (times * (y - p)) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


#: Columns of the curve's features.
FEATURES = [f"x{i}" for i in range(len(WINDOWS) + 2)]


def _rests(counts: DataFrame, discount: float) -> tuple[list[float], list[float], float]:
    """Of both classes, the sum of counts and the share that discounts free; and the sum of the shared counts."""
    sums = counts.agg(*[F.sum(n).alias(n) for n in ("c0", "c1")], *[F.sum(F.least(n, F.lit(discount))).alias(f"off_{n}") for n in ("c0", "c1")], F.sum(F.col("both") + 0.5).alias("shared")).first()
    total = [sums[n] or 0 for n in ("c0", "c1")]
    return total, [max(1e-3, sums[f"off_c{y}"] / t) if t else 1.0 for y, t in enumerate(total)], sums["shared"] or 1.0


def _back_off(counts: DataFrame, discount: float, rests, below: list[Column]) -> DataFrame:
    """Adds p0 and p1: discounted counts c0 and c1, and the freed share by what is below."""
    total, rest, _ = rests
    p = [F.greatest(F.col(f"c{y}") - discount, F.lit(0)) / max(total[y], 1) + rest[y] * MET * below[y] for y in (0, 1)]
    return counts.withColumns({"p0": p[0], "p1": p[1]})


def _ratio(a: str, b: str) -> Column:
    return F.log(F.col(a) / F.col(b))


def evidence_table(pairs: DataFrame) -> tuple[dict[str, float], DataFrame]:
    """The constants and the table (kind, key, value) of counts (kind, pair, plain, toxic)."""
    first, second = F.shiftright("pair", 32).bitwiseAND(F.lit(0xFFFFFFFF)), F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))
    rows = pairs.select("kind", "pair", first.alias("a"), second.alias("b"), "plain", "toxic")
    kinds = [F.count_if(F.col("plain") > 0).alias("c0"), F.count_if(F.col("toxic") > 0).alias("c1"), F.count("*").alias("both")]
    bigrams = rows.where("kind = 0")
    stems = stored(rows.where("kind > 0").groupBy("kind", F.col("a").alias("stem")).agg(*kinds, F.min("b").alias("a_word")), "stems")
    owns = rows.where("kind > 0").groupBy(F.col("b").alias("word")).agg(*[F.max(F.when(F.col("kind") == k, F.col("a"))).alias(f"s{k}") for k in STEMS])
    owns = stored(owns, "stems-of-words")
    constants: dict[str, float] = {}

    short, long = STEMS
    rests = _rests(stems.where(F.col("kind") == short), STEM_DISCOUNT)
    constants[str(short)] = math.log(rests[1][1] / rests[1][0])
    shared = (F.col("both") + 0.5) / rests[2]
    four = _back_off(stems.where(F.col("kind") == short), STEM_DISCOUNT, rests, [shared, shared])
    up = four.select(F.col("stem").alias(f"s{short}"), F.col("p0").alias("up0"), F.col("p1").alias("up1"), (F.col("both") + 0.5).alias("up_both"))
    rests = _rests(stems.where(F.col("kind") == long), STEM_DISCOUNT)
    constants[str(long)] = math.log(rests[1][1] / rests[1][0])
    six = stems.where(F.col("kind") == long).join(owns.select(F.col("word").alias("a_word"), f"s{short}"), "a_word").join(up, f"s{short}")
    six = stored(_back_off(six, STEM_DISCOUNT, rests, [F.col(f"up{y}") * (F.col("both") + 0.5) / F.col("up_both") for y in (0, 1)]), "long-stems")

    after = bigrams.groupBy(F.col("b").alias("word")).agg(*kinds)
    rests = _rests(after, WORD_DISCOUNT)
    constants[str(UNIT)] = math.log(rests[1][1] / rests[1][0])
    higher = six.select(F.col("stem").alias(f"s{long}"), F.col("p0").alias("long0"), F.col("p1").alias("long1"), (F.col("both") + 0.5).alias("long_both"))
    joined = after.join(owns, "word", "left").join(up, f"s{short}", "left").join(higher, f"s{long}", "left")
    own = F.col("both") + 0.5
    below = [F.coalesce(F.col(f"long{y}") * own / F.col("long_both"), F.col(f"up{y}") * own / F.col("up_both"), own / rests[2]) for y in (0, 1)]
    units = stored(_back_off(joined, WORD_DISCOUNT, rests, below).select("word", "c0", "c1", "p0", "p1"), "words")

    sums = [F.sum(c).alias(f"n{y}") for y, c in enumerate(("plain", "toxic"))] + [F.sum(F.least(c, F.lit(PAIR_DISCOUNT))).alias(f"off{y}") for y, c in enumerate(("plain", "toxic"))]
    before = bigrams.groupBy("a").agg(*sums).where((F.col("n0") >= MIN_CONTEXT) & (F.col("n1") >= MIN_CONTEXT))
    rest = {f"rest{y}": F.greatest(F.col(f"off{y}") / F.col(f"n{y}"), F.lit(1e-3)) for y in (0, 1)}
    context = stored(before.withColumns(rest), "contexts")
    clipped = lambda x: F.greatest(F.lit(-PAIR_WEIGHT), F.least(F.lit(PAIR_WEIGHT), x))
    kept = bigrams.where((F.col("plain") > PAIR_DISCOUNT) | (F.col("toxic") > PAIR_DISCOUNT)).join(context, "a").join(units.select(F.col("word").alias("b"), "p0", "p1"), "b")
    seen = {f"q{y}": F.greatest(F.col(c) - PAIR_DISCOUNT, F.lit(0)) / F.col(f"n{y}") + F.col(f"rest{y}") * F.col(f"p{y}") for y, c in enumerate(("plain", "toxic"))}
    over = lambda discount: (F.col("c0") > discount) | (F.col("c1") > discount)
    entry = lambda df, kind, key, value: df.select(F.lit(kind).cast("int").alias("kind"), F.col(key).alias("key"), value.cast("float").alias("value"))
    out = entry(kept.withColumns(seen), PAIR, "pair", clipped(_ratio("q1", "q0") - _ratio("p1", "p0")))
    out = out.unionByName(entry(context, CONTEXT, "a", clipped(_ratio("rest1", "rest0")))).unionByName(entry(units.where(over(WORD_DISCOUNT)), UNIT, "word", _ratio("p1", "p0")))
    for k, df in ((short, four), (long, six)):
        out = out.unionByName(entry(df.where(over(STEM_DISCOUNT)), k, "stem", _ratio("p1", "p0")))
    out = stored(out, "evidence")
    for step in (stems, owns, six, units, context):
        drop_stored(step)
    return constants, out


class Learned:
    """Constants and evidence table of one set of counts, and the curve."""

    def __init__(self, pairs: DataFrame):
        self.constants, self.entries = evidence_table(pairs)
        self.curve: np.ndarray | None = None
        self.small = self.entries.count() <= MODEL_ROWS
        self._held: tuple | None = None
        self._files: list | None = None

    def entries_by_kind(self) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        if self._held is None:
            rows = self.entries.toArrow()
            self._held = tuple(rows.column(c).to_numpy() for c in ("kind", "key", "value"))
        return by_kind(*self._held)

    def files(self) -> list[tuple[int, int, int, str]] | None:
        """The table in sorted files, each kind's least and greatest key in them; nothing where workers can't open them."""
        if self._files is None:
            n = math.ceil(max(self.entries.count(), 1) / SLICE_ROWS)
            rows = stored(self.entries.repartitionByRange(n, "kind", "key").sortWithinPartitions("kind", "key"), "sorted-evidence")
            path = rows.metadataColumn("_metadata")["file_path"].alias("path")
            ends = rows.select("kind", "key", path).groupBy("kind", "path").agg(F.min("key").alias("least"), F.max("key").alias("most")).collect()
            drop_stored(self.entries)
            self.entries, self._files = rows, sorted((r["kind"], r["least"], r["most"], r["path"]) for r in ends)
        return self._files if readable(self.entries, self._files[:1]) else None

    def model(self) -> Model:
        return Model(self.constants, self.entries_by_kind() if self.small else {}, self.curve)


def readable(df: DataFrame, parts: list[tuple[int, int, int, str]]) -> bool:
    """Whether a worker opens these files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            try:
                for *_, path in parts:
                    _opened(path).close()
                said = ""
            except (OSError, ValueError, ImportError, pa.ArrowException) as e:
                said = str(e) or "none"
            yield pa.RecordBatch.from_pydict({"said": pa.array([said])})

    return not any(r["said"] for r in df.sparkSession.range(1, numPartitions=1).mapInArrow(run, "said string").collect())


def by_kind(kind: np.ndarray, key: np.ndarray, value: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    out = {}
    for k in np.unique(kind).tolist():
        order = np.argsort(key[kind == k], kind="stable")
        out[k] = key[kind == k][order], value[kind == k][order]
    return out


def _mapped(df: DataFrame, learned: Learned, keep: list[str], make, schema: str) -> DataFrame:
    """The columns `keep` of df (one of its others is text) with what make(model, texts) gives, by broadcast, from files or by joining the evidence of each text."""
    spark = df.sparkSession
    files = None if learned.small else learned.files()
    held = spark.sparkContext.broadcast(learned.model() if files is None else FiledModel(learned.constants, files, learned.curve))
    fields = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in keep)
    bounds = () if files is None else (BATCH_BYTES, 1 << 20)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_chunks(batches, *bounds):
            yield pa.RecordBatch.from_pydict({c: part.column(c) for c in keep} | make(held.value, part.column("text").to_pylist()))

    if learned.small or files is not None:
        return df.mapInArrow(run, f"{fields}, {schema}")

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_chunks(batches):
            for i, text in zip(part.column("row").to_pylist(), part.column("text").to_pylist(), strict=True):
                kind, key = zip(*held.value.keys(text), strict=True)
                yield pa.RecordBatch.from_pydict({"row": pa.array([i] * len(kind), pa.int64()), "kind": pa.array(kind, pa.int32()), "key": pa.array(key, pa.int64())})

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_chunks(batches, 1 << 20, 256):
            made = []
            for text, got in zip(part.column("text").to_pylist(), part.column("got").to_pylist(), strict=True):
                found = [np.array([g[c] for g in got or []], t) for c, t in (("kind", np.int32), ("key", np.int64), ("value", np.float32))]
                made.append(make(Model(held.value.constants, by_kind(*found), held.value.curve), [text]))
            yield pa.RecordBatch.from_pydict({c: part.column(c) for c in keep} | {c: pa.concat_arrays([m[c] for m in made]) for c in made[0]})

    rows = stored(df.withColumn("row", F.monotonically_increasing_id()), "numbered-texts")
    asked = rows.select("row", "text").mapInArrow(keys, "row bigint, kind int, key bigint")
    got = asked.join(learned.entries, ["kind", "key"]).groupBy("row").agg(F.collect_list(F.struct("kind", "key", "value")).alias("got"))  # a text's own keys
    return rows.join(got, "row", "left").drop("row").mapInArrow(joined, f"{fields}, {schema}")


def learn(labelled: DataFrame, part: Column) -> Learned:
    """labelled: text and toxic (0 or 1). All rows are counted; part: 0 for rows that fit the curve by counts without them."""
    rows = labelled.where(F.col("toxic").isin(0, 1)).select(F.coalesce("text", F.lit("")).alias("text"), F.col("toxic").cast("int").alias("toxic"), part.alias("part"))
    rows = rows.withColumn("hash", F.xxhash64("text"))
    first = {r["toxic"]: r["hash"] for r in rows.groupBy("toxic").agg(F.min("hash").alias("hash")).collect()}
    curve = F.coalesce(F.col("part") == 0, F.lit(False))
    for y, h in first.items():
        curve = curve | ((F.col("toxic") == y) & (F.col("hash") == h))
    rows = rows.withColumn("curve", curve)
    names = ["toxic", "plain", "own_toxic", "own_plain"]
    counts = rows.select("text", "toxic", "curve").mapInArrow(_pairs, "kind int, pair bigint, " + ", ".join(f"{n} bigint" for n in names))
    pairs = stored(counts.groupBy("kind", "pair").agg(*[F.sum(n).alias(n) for n in names]), "pairs")
    learned = Learned(pairs.select("kind", "pair", "plain", "toxic"))
    if len(first) == 2:
        less = lambda c: (F.col(c) - F.col(f"own_{c}")).alias(c)
        others = Learned(pairs.select("kind", "pair", less("plain"), less("toxic")).where("plain > 0 or toxic > 0"))
        learned.curve = _fitted(rows.where("curve"), others)
        drop_stored(others.entries)
    drop_stored(pairs)
    return learned


def _fitted(rows: DataFrame, learned: Learned) -> np.ndarray:
    """The curve of rows (text, toxic, hash) by counts without them."""
    many = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    low = {r["toxic"]: r["hash"] for r in rows.groupBy("toxic").agg(F.min("hash").alias("hash")).collect()}
    share = {y: min(1.0, CURVE_ROWS / 2 / n) for y, n in many.items()}
    drawn = F.lit(False)
    for y in many:
        lot = F.pmod(F.xxhash64("hash"), F.lit(1 << 20)) < int(share[y] * (1 << 20))
        drawn = drawn | ((F.col("toxic") == y) & (lot | (F.col("hash") == low[y])))

    def features(model: Model, texts: list[str]) -> dict:
        x = model.features(texts)
        return {n: pa.array(x[:, i]) for i, n in enumerate(FEATURES)}

    found = _mapped(rows.where(drawn).select("text", "toxic"), learned, ["toxic"], features, ", ".join(f"{n} double" for n in FEATURES)).toArrow()
    y, *x = (found.column(n).to_numpy() for n in ("toxic", *FEATURES))
    times = np.array([many[k] / max((y == k).sum(), 1) for k in (0, 1)])[y]
    return fit_curve(np.stack(x, axis=1), y, times=times * len(y) / times.sum())


def score(df: DataFrame, learned: Learned, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score for every row."""
    return _mapped(id_and_text(df, id_col, text_col), learned, ["doc_id"], lambda model, texts: {"score": pa.array(model.scores(texts))}, "score double")


def bits_of_labels(labelled: DataFrame) -> DataFrame:
    """labelled: (file, file2, row, toxic), a row a label. Of each bucket of 32,768 rows of a file, which have a label n times or more."""
    times = labelled.groupBy("file", "file2", "row", "toxic").agg(F.count("*").alias("n"))
    each = times.withColumns({"n": F.explode(F.sequence(F.lit(1).cast("bigint"), "n")), "bucket": F.bitmap_bucket_number(F.col("row") + 1), "bit": F.bitmap_bit_position(F.col("row") + 1)})
    bits = F.expr("substring(bitmap_construct_agg(bit), 1, cast(max(bit) div 8 as int) + 1)").alias("bits")
    return stored(each.groupBy("file", "file2", "bucket", "toxic", "n").agg(bits), "label-bits")


def with_labels(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with the labels (doc_id, toxic) of their doc_id, a row a label; the texts stay where they are."""
    if labels.count() <= BROADCAST_LABELS:
        return docs.join(F.broadcast(labels), "doc_id")
    docs, key = row_keys(docs)
    bits = bits_of_labels(docs.select("doc_id", key.alias("key")).join(labels, "doc_id").select("key.*", "toxic"))
    size = bits.agg(F.sum(F.length("bits") + 100)).first()[0] or 0
    place = {"file": key["file"], "file2": key["file2"], "bucket": F.bitmap_bucket_number(key["row"] + 1), "bit": F.bitmap_bit_position(key["row"] + 1)}
    found = docs.select("*", *[c.alias(n) for n, c in place.items()]).join(F.broadcast(bits) if size <= BROADCAST_BITS else bits, ["file", "file2", "bucket"])
    is_set = F.expr("shiftright(cast(conv(hex(substring(bits, cast(bit div 8 as int) + 1, 1)), 16, 10) as int), cast(bit % 8 as int)) & 1 = 1")
    return found.where(is_set).select(*docs.columns, "toxic")


def held_out(doc_id: Column) -> Column:
    return fold(doc_id, 3) == 1


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    labelled = with_labels(docs.where(~held_out(docs["doc_id"])), labels.where(~held_out(labels["doc_id"])))
    model = learn(labelled, F.floor(fold(F.col("doc_id"), 15) / 3))
    found = score(docs, model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
