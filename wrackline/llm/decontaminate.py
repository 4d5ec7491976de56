"""Benchmark decontamination: a broadcast set of normalised test n-grams, scanned over every document's words.

Words are what `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` finds after lower-casing A-Z. A window is `size` consecutive words of
an item, or all words of a shorter item. Each worker numbers the benchmark's words, looks only at runs of numbered words
that are long enough, and checks them against the exact windows, so a hit needs no second look.

The windows are broadcast in parts of about `part_windows` windows and `PART_BYTES` bytes at most; a benchmark within one
part is scanned in one pass, a larger one in as many passes as it has parts, one after the other; a pass stores the hits of
the documents that have any, and these alone are shuffled, joined by document, and looked up in the last pass. Nothing is
sampled or cut.

Defined results: very long texts are scanned whole; a null or empty text has no words and is never contaminated; an item without words has no window; items
that share a window are all named; rows that repeat id and text are scanned and returned one by one; null ids are
carried; an empty benchmark leaves every document clean; other columns are not read.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import id_and_text, row_keys, stored, table, text_chunks, text_of

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WINDOW = 13
PART_WINDOWS, PART_BYTES = 500_000, 64 << 20
#: Documents with hits are broadcast up to this many; beyond it the last join is shuffled.
BROADCAST_HITS = 100_000
_HITS = "n_words bigint, hit_starts array<int>, hit_ends array<int>, item_ids array<string>"


def words_of(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode().lower())


def item_windows(benchmark: DataFrame, size: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(window, item_ids): every distinct window of the benchmark, words joined by one space, with the items that hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, windows = [], []
            for item, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = words_of(text)
                for i in range(max(1, len(words) - size + 1)) if words else ():
                    ids.append(item)
                    windows.append(b" ".join(words[i : i + size]))
            yield pa.RecordBatch.from_pydict({"item_id": pa.array(ids, pa.string()), "window": pa.array(windows, pa.binary())})

    rows = id_and_text(benchmark, id_col, text_col).withColumn("doc_id", F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return rows.mapInArrow(run, "item_id string, window binary").groupBy("window").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"))


class _Scanner:
    """Windows of one part, as runs of word numbers. Built once in each task from the broadcast pairs."""

    def __init__(self, windows: list[tuple[bytes, list[str]]]):
        self.number: dict[bytes, int] = {}
        self.items: dict[bytes, list[str]] = {}
        lengths = set()
        for window, items in windows:
            words = window.split(b" ")
            lengths.add(len(words))
            ids = np.array([self.number.setdefault(w, len(self.number) + 1) for w in words], np.int32)
            self.items[ids.tobytes()] = items
        self.lengths = sorted(lengths)

    def scan(self, words: list[bytes]) -> tuple[list[int], list[int], set[str]]:
        """Starts and ends of the maximal hit runs of words, and the items they come from."""
        n, found, items = len(words), [], set()
        if self.lengths and n >= self.lengths[0]:
            get = self.number.get
            ids = np.fromiter((get(w, 0) for w in words), np.int32, n)
            known = np.concatenate(([0], np.cumsum(ids > 0)))
            for length in self.lengths:
                if length > n:
                    break
                for i in np.flatnonzero(known[length:] - known[:-length] == length).tolist():
                    if held := self.items.get(ids[i : i + length].tobytes()):
                        found.append((i, i + length))
                        items.update(held)
        return *_merged(found), items


def _merged(spans: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    starts, ends = [], []
    for a, b in sorted(spans):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


#: The scanner of the part that a worker scans; it outlives the task.
_scanners: dict[str, _Scanner] = {}


def _scan(docs: DataFrame, windows: list[tuple[bytes, list[str]]]) -> tuple[DataFrame, Broadcast]:
    held, part_id = docs.sparkSession.sparkContext.broadcast(windows), uuid.uuid4().hex
    fields = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if part_id not in _scanners:
            _scanners.clear()
            _scanners[part_id] = _Scanner(held.value)
        scanner = _scanners[part_id]
        for part in text_chunks(batches):
            out = {"n_words": [], "hit_starts": [], "hit_ends": [], "item_ids": []}
            for text in text_of(part).to_pylist():
                words = words_of(text)
                starts, ends, items = scanner.scan(words)
                for name, value in zip(out, (len(words), starts, ends, sorted(items)), strict=True):
                    out[name].append(value)
            types = (pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.string()))
            yield pa.RecordBatch.from_pydict({c: part.column(c) for c in fields} | {k: pa.array(v, t) for (k, v), t in zip(out.items(), types, strict=True)})

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *T._parse_datatype_string(_HITS).fields])), held


def scan_benchmark(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, part_windows: int = PART_WINDOWS) -> DataFrame:
    """docs has a column text, or a struct row with a field text; adds n_words, hit_starts and hit_ends (maximal runs of hit words) and item_ids.

    With several parts, rows are told apart by their place in their file; docs are stored first unless they only read Parquet files.
    """
    windows = stored(item_windows(benchmark, size), "windows")
    n, size_bytes = windows.agg(F.count("*"), F.sum(F.octet_length("window") + 16 * F.size("item_ids"))).first()
    parts = max(1, -(-n // part_windows), -(-(size_bytes or 0) // PART_BYTES))
    bucket = F.pmod(F.xxhash64("window"), F.lit(parts))
    held = lambda i: [(bytes(r.window), r.item_ids) for r in windows.where(bucket == i).collect()]  # noqa: E731  part_windows rows or so
    if parts == 1:
        return _scan(docs, held(0))[0]
    docs, place = row_keys(docs)
    keyed = docs.withColumn("place", place)
    text = F.col("text") if "text" in docs.columns else F.col("row.text")
    hits = None
    for i in range(parts):
        found, sent = _scan(keyed.select("place", text.alias("text")), held(i))
        found = stored(found.where(F.size("hit_starts") > 0).select("place", F.arrays_zip("hit_starts", "hit_ends").alias("runs"), "item_ids"), "hits")
        sent.destroy()
        hits = found if hits is None else hits.unionByName(found)
    joined = hits.groupBy("place").agg(F.array_sort(F.flatten(F.collect_list("runs"))).alias("runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("all_items"))
    step = """aggregate(runs, cast(array() as array<struct<hit_starts:int,hit_ends:int>>), (acc, r) ->
        if(size(acc) > 0 and r.hit_starts <= element_at(acc, -1).hit_ends,
           concat(slice(acc, 1, size(acc) - 1), array(named_struct('hit_starts', element_at(acc, -1).hit_starts,
                  'hit_ends', greatest(element_at(acc, -1).hit_ends, r.hit_ends)))),
           concat(acc, array(r))))"""
    joined = stored(joined.withColumn("runs", F.expr(step)), "joined-hits")
    counted = _scan(keyed, [])[0].drop("hit_starts", "hit_ends", "item_ids")
    looked_up = counted.join(F.broadcast(joined) if joined.count() <= BROADCAST_HITS else joined, "place", "left")
    or_none = lambda c, kind: F.coalesce(F.col(c), F.array().cast(kind))
    return looked_up.select(*docs.columns, "n_words", or_none("runs.hit_starts", "array<int>").alias("hit_starts"), or_none("runs.hit_ends", "array<int>").alias("hit_ends"), or_none("all_items", "array<string>").alias("item_ids"))


def _n_hit():
    return F.expr("aggregate(zip_with(hit_starts, hit_ends, (a, b) -> b - a), 0L, (x, y) -> x + y)")


def _contaminated(n_words, n_hit):
    return (n_hit > 0) & (20 * n_hit >= n_words)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, part_windows: int = PART_WINDOWS) -> DataFrame:
    """The rows of docs that aren't contaminated (hit words under a twentieth), with their own columns."""
    rows = docs.select(F.struct("*").alias("row"))
    found = scan_benchmark(rows, benchmark, size, part_windows)
    return found.where(~_contaminated(F.col("n_words"), _n_hit())).select("row.*")


def op10_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = id_and_text(table(spark, sf_dir, "documents"))
    found = scan_benchmark(docs, table(spark, sf_dir, "benchmark")).withColumn("n_hit", _n_hit())
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        _contaminated(F.col("n_words"), F.col("n_hit")).alias("contaminated"),
    )


OP10_SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS l, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS i FROM bw WHERE len(w) > 0)),
lens AS (SELECT DISTINCT l FROM win),
pos AS (
  SELECT doc_id, l, i, array_to_string(w[i : i + l - 1], ' ') AS g
  FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM dw, lens WHERE len(w) >= l)),
hit AS (SELECT doc_id, item_id, i, win.l FROM pos JOIN win USING (l, g)),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + l)) AS p FROM hit) GROUP BY 1),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS s
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM hit) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)
"""
