"""Repeated byte strings by a distributed difference cover, as in suffix sorting cut off at `length` bytes.

Suffix sorting by a difference cover sorts sampled suffixes first, names them, and places the other suffixes by means of
the sample. Here only equality of `length`-byte prefixes is asked for, so a name is a hash instead of a rank, sorting is
sorting names within hash buckets, and one level of naming is enough:

1. Sample. In each text, the suffixes at offsets that are, modulo 133, in a perfect difference set of 12 are named by
   their first 268 bytes. For any two offsets exactly one shift below 133 takes both into the sample, so two equal
   strings of 400 bytes always hold a pair of sampled suffixes with one name, wherever they start.
2. Sort the names. Each batch of texts sends its distinct names, packed by bucket; in a bucket they are sorted, equal
   neighbours are marked, and each batch gets back one bit for each of its names.
3. Merge the remaining suffixes. Only suffixes that begin at most 132 bytes before a marked sample can repeat. Their
   400-byte prefixes are named by two independent hashes (64 bits within a bucket that the other hash chooses), sorted
   and compared with their neighbours in the same way. Every byte of a repeated prefix is covered.

Texts are written once, as a table bucketed by batch, and read three times from there without being shuffled; what is
shuffled are names (a tenth of the bytes sampled, 4 bytes each; 8 bytes for each possibly repeated suffix) and bits.
A batch sends a name once, however often it occurs there, so a hot string makes one row for a batch. A batch makes one row
for each bucket that it has names for. Batches grow with the root of the input, from `BATCH_BYTES` to `MOST_BYTES`, and a
bucket holds the names of `BUCKET_BATCHES` batches' worth of text, so that rows are few; there are never more than names.
Texts that are equal as a whole are found first by their digest: all are covered, and one of them alone stands for them in
the search.

Defined results: a null or empty text has no bytes and nothing removed; texts under `length` bytes are never touched;
matches never cross texts; very long texts are searched whole; repeated rows repeat each other and are removed like any copies; null ids are carried; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import id_and_text, shared_folder, stored, table, text_chunks

LENGTH = 400
#: A perfect difference set: every residue modulo 133 but 0 is the difference of exactly one pair. Fixed values.
MODULUS, COVER = 133, (0, 1, 3, 12, 20, 34, 38, 81, 88, 94, 104, 109)
BATCH_BYTES, MOST_BYTES, PIECE = 8 << 20, 32 << 20, 1 << 20
#: Batches of text whose names one bucket holds, and buckets at least.
BUCKET_BATCHES, LEAST_BUCKETS = 1, 64
#: Input at which batches begin to grow.
GROWS = 1 << 40
_FACTORS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_SIGNS = [np.random.Generator(np.random.PCG64(i)).integers(0, 1 << 64, 256, dtype=np.uint64) for i in (11, 12)]


def _powers(factor: int, n: int) -> np.ndarray:
    return np.cumprod(np.full(n, factor, np.uint64))


_UP = [_powers(f, PIECE + 2 * LENGTH) for f in _FACTORS]
_DOWN = [_powers(pow(f, -1, 1 << 64), PIECE + 2 * LENGTH) for f in _FACTORS]


def names_at(data: np.ndarray, at: np.ndarray, length: int, which: int) -> np.ndarray:
    """64-bit polynomial names of the strings of `length` bytes that start at the sorted offsets `at`."""
    out = np.empty(len(at), np.uint64)
    cuts = np.searchsorted(at, np.arange(0, len(data) + PIECE, PIECE))
    for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        if a == b:
            continue
        begin = i * PIECE
        part = _SIGNS[which][data[begin : begin + PIECE + length]]
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(part * _UP[which][: len(part)], dtype=np.uint64)))
        own = at[a:b] - begin
        name = (sums[own + length] - sums[own]) * _DOWN[which][own]
        out[a:b] = (name ^ (name >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)  # one to one: spreads the low bits upwards
    return out


class Names:
    """The distinct (bucket, name) pairs of a batch, in order, and where each occurs."""

    def __init__(self, bucket: np.ndarray, name: np.ndarray):
        self.order = np.lexsort((name, bucket))
        b, n = bucket[self.order], name[self.order]
        new = np.ones(len(b), bool)
        new[1:] = (b[1:] != b[:-1]) | (n[1:] != n[:-1])
        self.group = np.cumsum(new) - 1
        self.bucket, self.name = b[new], n[new]
        self.twice = np.bincount(self.group, minlength=len(self.name)) > 1
        self.cuts = np.concatenate(([0], np.flatnonzero(np.diff(self.bucket)) + 1, [len(self.bucket)])) if len(self.bucket) else np.zeros(1, int)

    def packed(self) -> Iterator[tuple[int, bytes]]:
        for a, b in zip(self.cuts, self.cuts[1:], strict=False):
            yield int(self.bucket[a]), self.name[a:b].tobytes()

    def marked(self, bits: dict[int, bytes]) -> np.ndarray:
        """For every occurrence, whether its name is repeated in this batch or elsewhere."""
        hit = self.twice.copy()
        for a, b in zip(self.cuts, self.cuts[1:], strict=False):
            if held := bits.get(int(self.bucket[a])):
                hit[a:b] |= np.unpackbits(np.frombuffer(held, np.uint8), count=b - a).astype(bool)
        out = np.empty(len(self.order), bool)
        out[self.order] = hit[self.group]
        return out


class Batch:
    """Texts of a batch in a fixed order, those that take part in the search joined to one array."""

    def __init__(self, docs: pa.Table, notes: pa.Table, length: int, buckets: int):
        self.length, self.buckets = length, buckets
        rows = sorted(zip(docs.column("doc_id").to_pylist(), docs.column("text").to_pylist(), docs.column("digest").to_pylist(), strict=True), key=lambda r: (r[2], r[0] is None, r[0]))
        self.ids = [r[0] for r in rows]
        self.texts = [(r[1] or "").encode() for r in rows]
        kinds, keys, data = (notes.column(c).to_pylist() for c in ("kind", "bucket", "data"))
        copies = {d[:-1].decode(): d[-1:] == b"1" for k, d in zip(kinds, data, strict=True) if k == 0}
        self.bits = [{b: d for k, b, d in zip(kinds, keys, data, strict=True) if k == kind} for kind in (1, 2)]
        self.copy = [len(t) >= length and r[2] in copies for t, r in zip(self.texts, rows, strict=True)]
        self.inside, seen = [], set()
        for i, r in enumerate(rows):
            if len(self.texts[i]) >= length and (not self.copy[i] or (copies[r[2]] and r[2] not in seen)):
                seen.add(r[2])
                self.inside.append(i)
        sizes = np.array([len(self.texts[i]) for i in self.inside], np.int64)
        self.data = np.frombuffer(b"".join([self.texts[i] for i in self.inside]), np.uint8)
        self.starts = np.concatenate((np.zeros(1, np.int64), np.cumsum(sizes)))
        self.sizes = sizes

    def samples(self) -> tuple[np.ndarray, Names]:
        """Sampled offsets and their names. A name has 32 bits within its bucket: a chance match only adds a suffix to look at."""
        block = self.length - MODULUS + 1
        cover = np.zeros(MODULUS, bool)
        cover[list(COVER)] = True
        offset = np.arange(len(self.data)) - np.repeat(self.starts[:-1], self.sizes)
        at = np.flatnonzero(cover[offset % MODULUS] & (offset + block <= np.repeat(self.sizes, self.sizes)))
        name = names_at(self.data, at, block, 0)
        return at, Names((name >> np.uint64(40)).astype(np.int64) % self.buckets, name.astype(np.uint32))

    def suffixes(self) -> tuple[np.ndarray, Names]:
        """Offsets of suffixes that may repeat for `length` bytes, and the names of those bytes."""
        at, names = self.samples()
        at = at[names.marked(self.bits[0])]
        edge = np.zeros(len(self.data) + 1, np.int32)
        text = np.searchsorted(self.starts, at, side="right") - 1
        low = np.maximum(at - MODULUS + 1, self.starts[text])
        high = np.minimum(at, self.starts[text + 1] - self.length)
        ok = low <= high
        np.add.at(edge, low[ok], 1)
        np.add.at(edge, high[ok] + 1, -1)
        at = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
        return at, Names((names_at(self.data, at, self.length, 1) >> np.uint64(20)).astype(np.int64) % self.buckets, names_at(self.data, at, self.length, 0))

    def covered(self) -> np.ndarray:
        """Which bytes of the joined texts lie in a repeated string."""
        at, names = self.suffixes()
        at = at[names.marked(self.bits[1])]
        edge = np.zeros(len(self.data) + 1, np.int32)
        edge[at] += 1
        np.add.at(edge, at + self.length, -1)
        return np.cumsum(edge[:-1]) > 0

    def results(self) -> dict[str, list]:
        cover = self.covered()
        spans: dict[int, tuple[list, list]] = {}
        for k, i in enumerate(self.inside):
            own = cover[self.starts[k] : self.starts[k + 1]]
            step = np.flatnonzero(np.diff(own.astype(np.int8), prepend=0, append=0)) if own.any() else np.zeros(0, int)
            spans[i] = (step[::2].tolist(), step[1::2].tolist())
        out: dict[str, list] = {c: [] for c in ("doc_id", "n_bytes", "starts", "ends", "kept")}
        for i, text in enumerate(self.texts):
            starts, ends = ([0], [len(text)]) if self.copy[i] else spans.get(i, ([], []))
            kept, last = [], 0
            for a, b in zip(starts, ends, strict=True):
                kept.append(text[last:a])
                last = b
            kept.append(text[last:])
            for c, v in zip(out, (self.ids[i], len(text), starts, ends, b"".join(kept)), strict=True):
                out[c].append(v)
        return out


def _batched(docs: DataFrame, batch_bytes: int) -> DataFrame:
    """Adds batch: a number for each run of about batch_bytes of text within a task of the scan."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, held, n = (TaskContext.get().partitionId() + 1) << 24, 0, 0
        for part in text_chunks(parts, batch_bytes // 8):
            size = part.column("text").nbytes
            if held and held + size > batch_bytes:
                n, held = n + 1, 0
            held += size
            yield pa.RecordBatch.from_pydict({"batch": pa.array([first + n] * part.num_rows, pa.int64())} | {c: part.column(c) for c in ("doc_id", "text", "digest")})

    return docs.mapInArrow(run, T.StructType([T.StructField("batch", T.LongType()), *docs.schema.fields]))


def _bucketed(batched: DataFrame, parts: int) -> DataFrame:
    """The texts as a table bucketed by batch, so that they are read three times without a shuffle."""
    spark = batched.sparkSession
    name = f"texts_{uuid.uuid4().hex}"
    batched.write.option("path", f"{shared_folder(spark)}/{name}").option("compression", "zstd").bucketBy(parts, "batch").saveAsTable(name)
    texts = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the catalog's entry; the files have a path of their own and stay
    return texts


def _marks(names: DataFrame, kind: int, width: type) -> DataFrame:
    """(batch, kind, bucket, data): a bit for each name that a batch sent, set if another batch sent it too."""

    def run(rows: pa.Table) -> pa.Table:
        batches, sent = rows.column("batch").to_pylist(), [np.frombuffer(x, width) for x in rows.column("data").to_pylist()]
        every = np.sort(np.concatenate(sent))
        twice = np.unique(every[1:][every[1:] == every[:-1]])
        out = []
        for batch, x in zip(batches, sent, strict=True):
            at = np.minimum(np.searchsorted(twice, x), max(len(twice) - 1, 0))
            hit = twice[at] == x if len(twice) else np.zeros(len(x), bool)
            if hit.any():
                out.append((batch, np.packbits(hit).tobytes()))
        bucket = rows.column("bucket")[0].as_py()
        return pa.table({"batch": pa.array([b for b, _ in out], pa.int64()), "kind": pa.array([kind] * len(out), pa.int32()), "bucket": pa.array([bucket] * len(out), pa.int32()), "data": pa.array([d for _, d in out], pa.binary())})

    return names.groupBy("bucket").applyInArrow(run, "batch bigint, kind int, bucket int, data binary")


def repeated_spans(df: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int | None = None, digest: bool = False) -> DataFrame:
    """doc_id, n_bytes, starts and ends (maximal covered runs, byte offsets) and kept: the remaining bytes, or with
    digest=True their SHA-256 in hex. length: from 2 * 133 on. batch_bytes: text in a batch, by the size of the input if not given."""
    if length < 2 * MODULUS:
        raise ValueError(f"length must be {2 * MODULUS} or more")
    spark = df.sparkSession
    docs = id_and_text(df, id_col, text_col).withColumn("digest", F.md5("text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    batch_bytes = batch_bytes or int(min(MOST_BYTES, BATCH_BYTES * max(1.0, (total / GROWS) ** 0.5)))
    buckets = max(LEAST_BUCKETS, total // (BUCKET_BATCHES * batch_bytes))
    parts = max(n, min(total // batch_bytes + 1, 4096), LEAST_BUCKETS)
    texts = _bucketed(_batched(docs, batch_bytes), parts)

    met = texts.where(F.octet_length("text") >= length).groupBy("digest", "batch").agg(F.count("*").alias("n"))
    whole = met.groupBy("digest").agg(F.sum("n").alias("all"), F.min("batch").alias("home")).where(F.col("all") > 1).select("digest", "home")
    copies = met.join(whole, "digest").select("batch", F.lit(0).alias("kind"), F.lit(0).alias("bucket"), F.concat("digest", F.when(F.col("batch") == F.col("home"), "1").otherwise("0")).cast("binary").alias("data"))
    copies = stored(copies, "copies")

    def passed(notes: DataFrame, make, schema) -> DataFrame:
        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            return make(Batch(left, right, length, buckets))

        return texts.groupBy("batch").cogroup(notes.groupBy("batch")).applyInArrow(lambda key, left, right: run_keyed(key, left, right, run), schema)

    def run_keyed(key, left, right, run):
        out = run(left, right)
        return out.append_column("batch", pa.array([key[0].as_py()] * out.num_rows, pa.int64())) if "data" in out.column_names else out

    def packed(names: Names) -> pa.Table:
        rows = list(names.packed())
        return pa.table({"bucket": pa.array([b for b, _ in rows], pa.int32()), "data": pa.array([d for _, d in rows], pa.binary())})

    sent = "bucket int, data binary, batch bigint"
    first = stored(_marks(passed(copies, lambda b: packed(b.samples()[1]), sent), 1, np.uint32), "sample-marks")
    notes = copies.unionByName(first)
    second = stored(_marks(passed(notes, lambda b: packed(b.suffixes()[1]), sent), 2, np.uint64), "suffix-marks")

    def final(batch: Batch) -> pa.Table:
        out = batch.results()
        if digest:
            out["kept"] = [hashlib.sha256(k).hexdigest() for k in out["kept"]]
        kinds = (id_type, pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.string() if digest else pa.binary())
        return pa.table({c: pa.array(v, t) for (c, v), t in zip(out.items(), kinds, strict=True)})

    from pyspark.sql.pandas.types import to_arrow_type

    id_field = docs.schema["doc_id"]
    id_type = to_arrow_type(id_field.dataType)
    schema = T.StructType([id_field, *T._parse_datatype_string(f"n_bytes bigint, starts array<bigint>, ends array<bigint>, kept {'string' if digest else 'binary'}").fields])
    return passed(notes.unionByName(second), final, schema)


def op2_substring_dedup(spark, sf_dir: str) -> DataFrame:
    found = repeated_spans(table(spark, sf_dir, "documents"), digest=True)
    removed = F.expr("aggregate(zip_with(starts, ends, (a, b) -> b - a), 0L, (x, y) -> x + y)")
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("starts").cast("bigint").alias("n_spans"), F.col("kept").alias("kept_sha256"), (F.size("starts") > 0).alias("repeated"))
