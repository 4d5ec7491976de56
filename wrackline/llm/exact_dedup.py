"""Exact deduplication with two-pass Bloom filtering, in DataFrame functions only.

Pass 1 sets two bits for each text hash. Every partition ORs its bits into 64-bit words and counts its hits on each word;
the partial words are ORed and their hits summed. A word that was hit more often than it has bits holds a bit that was hit
twice. Pass 2 probes every row: a row with a word without such a bit cannot have a copy and goes straight to the result.
Only the rows left, and of them only keys and hash, are shuffled and grouped. A false positive costs a shuffled row, never
a wrong answer, because the groups are made on SHA-256. Texts are read where they lie and are never shuffled for the search.

Defined results: a null text counts as empty; empty texts are equal to each other; very long texts are hashed whole; texts
are equal if they are after lower-casing A-Z. The largest id of a group stays; null ids lose against any id. `find_copies`
goes by ids, so rows that repeat both id and text all carry that id and are marked alike, and null ids stay only where a
group has no other. `drop_copies` goes by rows: exactly one row of each group stays, as it came. An empty table gives an
empty result. Only id and text are read by `find_copies`; other columns may be called anything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import anti_join, ascii_lower, id_and_text, row_keys, stored, table

#: Bits of the filter for each row: with two bits a row, some four hits a word of 64 leave about one false positive in a hundred rows.
BITS_PER_ROW = 32
#: The words with a repeated bit are broadcast up to this many (8 bytes each); beyond it keys and hashes are shuffled to them.
BROADCAST_WORDS = 1_000_000
#: Sub-groups of a group of copies, so that no task gets a whole hot group.
SALTS = 256


def _bit(sha: Column, k: int, words: int) -> tuple[Column, Column]:
    """The word that a hash hits with its k-th bit, and that bit."""
    at = F.conv(F.substring(sha, 1 + 15 * k, 15), 16, 10).cast("bigint") % (64 * words)
    return F.shiftright(at, 6), at % 64


def repeated_words(hashes: DataFrame, words: int) -> DataFrame:
    """word: those of the Bloom filter in which a bit was hit more than once."""
    hits = F.array(*[F.struct(w.alias("word"), b.cast("int").alias("bit")) for w, b in (_bit(F.col("sha"), k, words) for k in (0, 1))])
    filter_words = hashes.select(F.inline(hits)).groupBy("word").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits"), F.count("*").alias("hits"))
    return filter_words.where(F.col("hits") > F.bit_count("bits")).select("word")


def _maybe(rows: DataFrame, repeated: DataFrame, words: int, small: bool) -> DataFrame:
    """rows (sha and keys) with `maybe`: whether both words of the hash hold a repeated bit.

    Beyond a broadcast, distinct pairs of words are looked up, so that many copies of one text make no hot key.
    """
    both = rows.withColumns({f"word{k}": _bit(F.col("sha"), k, words)[0] for k in (0, 1)})
    asked = both if small else both.select("word0", "word1").distinct()
    for k in (0, 1):
        side = repeated.select(F.col("word").alias(f"word{k}"), F.lit(True).alias(f"in{k}"))
        asked = asked.join(F.broadcast(side) if small else side, f"word{k}", "left")
    asked = asked.withColumn("maybe", F.coalesce(F.col("in0") & F.col("in1"), F.lit(False))).drop("in0", "in1")
    return (asked if small else both.join(asked, ["word0", "word1"])).drop("word0", "word1")


def _probed(rows: DataFrame) -> DataFrame:
    """rows has sha; adds `maybe` after building the filter over all of them."""
    words = max(1024, -(-BITS_PER_ROW * rows.count() // 64))
    repeated = stored(repeated_words(rows.select("sha"), words), "bloom-words")
    return _maybe(rows, repeated, words, repeated.count() <= BROADCAST_WORDS)


def _groups(maybe: DataFrame, top: Column) -> DataFrame:
    """(sha, salt, keep, group_size) of the possibly repeated rows: counted by sub-group, then by group."""
    parts = maybe.groupBy("sha", "salt").agg(F.max(top).alias("top"), F.count("*").alias("n"))
    whole = parts.groupBy("sha").agg(F.max("top").alias("keep"), F.sum("n").alias("group_size"))
    return parts.select("sha", "salt").join(whole, "sha")


def _salted(rows: DataFrame, key: str) -> DataFrame:
    return rows.withColumn("salt", F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int"))


def _sha(text: Column) -> Column:
    return F.sha2(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), 256)


def find_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row."""
    rows = _probed(stored(id_and_text(df, id_col, text_col).select("doc_id", _sha(F.col("text")).alias("sha")), "text-hashes"))
    alone = rows.where(~F.col("maybe")).select("doc_id", "sha", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"))
    maybe = _salted(rows.where("maybe"), "doc_id")
    grouped = maybe.join(_groups(maybe, F.col("doc_id")), ["sha", "salt"]).select("doc_id", "sha", F.col("keep").alias("keep_id"), "group_size")
    return alone.unionByName(grouped).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256")
    )


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of equal texts, that of the largest id, with its own columns; the others' keys are joined last.

    Rows are told apart by their place in their file; df is stored first unless it only reads Parquet files.
    """
    df, place = row_keys(df)
    keyed = df.select(F.struct("*").alias("row"), df[id_col].alias("doc_id"), df[text_col].alias("text"), place.alias("key"))
    rows = _probed(stored(keyed.select("key", "doc_id", _sha(F.col("text")).alias("sha")), "text-hashes"))
    maybe = _salted(rows.where("maybe"), "key")
    kept = maybe.join(_groups(maybe, F.struct("doc_id", "key")), ["sha", "salt"])
    return anti_join(keyed.select("row", "key"), kept.where(F.col("key") != F.col("keep.key")).select("key"), "key").select("row.*")


def op6_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return find_copies(table(spark, sf_dir, "documents"))


OP6_SQL = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
           FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""
