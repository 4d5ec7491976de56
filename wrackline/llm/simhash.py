"""SimHash near-duplicates by an inverted index over byte positions with count filtering.

A fingerprint has 8 bytes. Fingerprints that differ in at most 3 bits differ in at most 3 bytes, so they share at least 5
bytes in place. Of any 5 of 8 positions at least 3 lie in the same half, so each fingerprint is posted under the 8
byte triples within its halves (other distances post other sets, see posted_sets); lists of single bytes would each hold a 256th of everything and grow with the square of
the table. Where a pair meets first, its shared positional bytes are tallied, pairs under 5 are dropped, and the rest are
verified on their bits. Equal fingerprints are one node throughout, however many documents have them.

A posting list of up to `SHORT` fingerprints is joined with itself. A longer one is posted again, each fingerprint under
its triple and a byte of the other half (a pair within 3 bits that shares one whole half has at least one equal byte in
the other; one that shares three bytes of a half has at least two there), which makes lists 256 times shorter. What is
still longer is dealt into blocks, each pair of blocks is compared in one bounded task with the same tally, and only links
that join something new there are kept, so no list ever emits all its pairs, and no link between components is lost.

Defined results: very long texts are hashed whole; null, empty and blank texts have fingerprint zero and are linked like any other; fewer than three words
are one shingle; repeated rows come out one by one; null ids are carried, and a component without any id has a null
component_id; an empty table gives an empty result; other columns are not read by `near_duplicates`.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import anti_join, id_and_text, map_text, row_keys, stored, table
from .components import components

SEED, WORDS, BITS = 42, 3, 3
#: Fingerprints of a list, and of a list that is posted again, that are joined; fingerprints of a block.
SHORT, MIDDLE, BLOCK, SALTS = 48, 2048, 1024, 64


def posted_sets(bits: int = BITS) -> list[tuple[int, ...]]:
    """The sets of byte positions that fingerprints are posted under, those of the first half first.

    A pair within `bits` bits shares at least 8 - bits bytes, at least half of them (rounded up) in one half.
    """
    if not 0 <= bits <= 7:
        raise ValueError("bits must be 0 to 7: fingerprints farther apart may share no byte")
    size = -(-(8 - bits) // 2)
    return [*combinations(range(4), size), *combinations(range(4, 8), size)]


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """Unsigned 64-bit SimHash of a text's word shingles."""
    parts = (text or "").encode().lower().split()  # bytes: lower() changes A-Z only, split() cuts at \x20 and \x09-\x0D
    if not parts:
        return 0
    shingles = [b" ".join(s) for s in zip(*(parts[i:] for i in range(words)), strict=False)] or [b" ".join(parts)]
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for i in range(0, len(shingles), 1 << 15):
        hashes = np.array([digest(s, SEED) for s in shingles[i : i + (1 << 15)]], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(shingles), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp: the fingerprint's 64 bits as a bigint."""

    def run(part: pa.RecordBatch) -> dict:
        fps = np.array([fingerprint(t, words) for t in part.column("text").to_pylist()], np.uint64)
        return {"fp": pa.array(fps.view(np.int64))}

    return map_text(id_and_text(df, id_col, text_col), run, "fp bigint")


def _mask(places: tuple[int, ...]) -> int:
    mask = sum(0xFF << 8 * p for p in places)
    return mask - (1 << 64) if mask >> 63 else mask


def _postings(fps: DataFrame, bits: int) -> DataFrame:
    """(list, bytes, fp): list is the number of the set of places, bytes the fingerprint cut to it."""
    lists = F.array(*[F.struct(F.lit(k).alias("list"), F.col("fp").bitwiseAND(F.lit(_mask(t))).alias("bytes")) for k, t in enumerate(posted_sets(bits))])
    return fps.select("fp", F.inline(lists)).select("list", "bytes", "fp")


def _first_met(x: np.ndarray, k: int, bits: int) -> np.ndarray:
    """Which differences x belong to pairs within `bits` bits that meet in list k and in none before."""
    ok = np.bitwise_count(x) <= bits
    for t in posted_sets(bits)[:k]:
        ok &= (x & np.uint64(_mask(t) % (1 << 64))) != 0
    return ok


def _block_links(pdf: pd.DataFrame, bits: int) -> pd.DataFrame:
    """Links that span what is connected within one pair of blocks."""
    fps = np.unique(pdf["fp"].to_numpy(np.int64)).view(np.uint64)
    k, n = int(pdf["list"].iloc[0]), len(fps)
    label = np.arange(n)
    step = max(1, (1 << 20) // max(n, 1))
    while True:
        low = label.copy()
        for a in range(0, n, step):
            x = fps[a : a + step, None] ^ fps[None, :]
            near = _first_met(x, k, bits) & ((x.view(np.uint8).reshape(*x.shape, 8) == 0).sum(axis=2) >= 8 - bits)
            low[a : a + step] = np.minimum(label[a : a + step], np.where(near, label[None, :], n).min(axis=1))
        low = np.minimum(low, low[low])
        if (low == label).all():
            break
        label = low
    far = label != np.arange(n)
    return pd.DataFrame({"a": fps[far].view(np.int64), "b": fps[label[far]].view(np.int64)})


def _pairs(lists: DataFrame, keys: list[str], bits: int, refined: bool) -> DataFrame:
    """(a, b): pairs of a list that share the bytes they must, meet here first, and are near on their bits."""
    x = F.col("l.fp").bitwiseXOR(F.col("r.fp"))
    zero = F.lit(0).cast("bigint")
    equal = [x.bitwiseAND(F.lit(_mask((p,)))) == zero for p in range(8)]
    shared = sum((F.when(e, 1).otherwise(0) for e in equal), F.lit(0))
    first = F.lit(False)
    for k, places in reversed(list(enumerate(posted_sets(bits)))):  # the first list in which the pair meets
        first = F.when(x.bitwiseAND(F.lit(_mask(places))) == zero, F.col("l.list") == k).otherwise(first)
    if refined:  # and the first byte of the other half
        lowest = F.lit(False)
        for p in reversed(range(8)):
            lowest = F.when(equal[p] & ((F.col("l.position") < 4) == F.lit(p < 4)), F.col("l.position") == p).otherwise(lowest)
        first = first & lowest
    on = (F.col("l.fp") < F.col("r.fp")) & (shared >= 8 - bits) & first & (F.bit_count(x) <= bits)
    for c in keys:
        on = (F.col(f"l.{c}") == F.col(f"r.{c}")) & on
    return lists.alias("l").join(lists.alias("r"), on).select(F.col("l.fp").alias("a"), F.col("r.fp").alias("b"))


def _long_links(lists: DataFrame, keys: list[str], bits: int) -> DataFrame:
    """(a, b): links within lists (keys, fp and the list's size n) of over MIDDLE fingerprints, pair of blocks by pair of blocks."""
    long = lists.where(F.col("n") > MIDDLE).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    own = long.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = own.select(*keys, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")
    return dealt.groupBy(*keys, "i", "j").applyInPandas(lambda pdf: _block_links(pdf, bits), "a bigint, b bigint")


def links(fps: DataFrame, bits: int = BITS) -> DataFrame:
    """(a, b): links between different fingerprints at `bits` or fewer bits that connect all that such pairs connect. fps: distinct fp.

    bits: 0 to 7. Beyond 3, lists are of fewer bytes and so longer, and a pair may share no byte of the other half: lists
    over MIDDLE are compared in blocks at once.
    """
    posted = stored(_postings(fps, bits), "postings")
    sizes = posted.groupBy("list", "bytes").agg(F.count("*").alias("n")).where("n > 1")
    met = stored(posted.join(sizes, ["list", "bytes"]), "met")
    again_from = SHORT if bits <= 3 else MIDDLE
    near = _pairs(met.where(F.col("n") <= again_from).select("list", "bytes", "fp"), ["list", "bytes"], bits, False)
    if bits > 3:
        return near.unionByName(_long_links(met, ["list", "bytes"], bits))

    # the first half of the lists is of bytes 0 to 3, so their other half are bytes 4 to 7
    others = F.when(F.col("list") < len(posted_sets(bits)) // 2, F.array(*[F.lit(p) for p in range(4, 8)])).otherwise(F.array(*[F.lit(p) for p in range(4)]))
    again = met.where(F.col("n") > SHORT).select("list", "bytes", "fp", F.explode(others).alias("position"))
    again = again.withColumn("byte", F.expr("cast(shiftrightunsigned(fp, position * 8) & 255 as int)"))
    keys = ["list", "bytes", "position", "byte"]
    sizes = again.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    refined = stored(again.join(sizes, keys), "refined")
    near = near.unionByName(_pairs(refined.where(F.col("n") <= MIDDLE).select(*keys, "fp"), keys, bits, True))

    return near.unionByName(_long_links(refined, keys, bits))


def _named(docs: DataFrame, low: Column, bits: int) -> DataFrame:
    """docs (fp, salt and keys), stored, with `least`: the least `low` of all rows that can be reached over links."""
    parts = docs.groupBy("fp", "salt").agg(F.min(low).alias("low"))
    nodes = stored(parts.groupBy("fp").agg(F.min("low").alias("low")), "nodes")
    roots = components(links(nodes.select("fp"), bits))
    rooted = nodes.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("low").alias("least")), "root").select("fp", "least")
    return docs.join(parts.select("fp", "salt").join(named, "fp"), ["fp", "salt"])


def near_duplicates(df: DataFrame, words: int = WORDS, bits: int = BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp, component_id (the least id that can be reached over links, the document's own included)."""
    docs = stored(fingerprints(df, words, id_col, text_col).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")), "fingerprints")
    return _named(docs, F.col("doc_id"), bits).select("doc_id", "fp", F.col("least").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, words: int = WORDS, bits: int = BITS) -> DataFrame:
    """Of each component one row, that of the least doc_id, with its own columns; null ids lose against any id.

    Rows are told apart by their place in their file; docs are stored first unless they only read Parquet files.
    """
    docs, place = row_keys(docs)
    keyed = docs.select(F.struct("*").alias("row"), place.alias("key"), docs["doc_id"].alias("own_id"), docs["text"].alias("text"))
    fps = fingerprints(keyed.select(F.struct("key", "own_id").alias("doc_id"), "text"), words)
    slim = stored(fps.select("doc_id.key", "doc_id.own_id", "fp").withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int")), "fingerprints")
    found = _named(slim, F.struct(F.col("own_id").isNull(), "own_id", "key"), bits)
    return anti_join(keyed.select("row", "key"), found.where(F.col("key") != F.col("least.key")).select("key"), "key").select("row.*")


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
