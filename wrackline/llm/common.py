"""Helpers shared by the corpus operators: column access, stored intermediates, Arrow batches."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Two columns, doc_id and text; a null text counts as empty. Every other column is left out, so no name can clash."""
    return df.select(df[id_col].alias("doc_id"), F.coalesce(df[text_col].cast("string"), F.lit("")).alias("text"))


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % parts


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only. lower() does the same on pure ASCII and is much the faster there."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as spark.checkpoint.dir names it. Where that is unset, a local run gets a new local one; a cluster must name it."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: later jobs start from the files, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Plan nodes that change, repeat or move rows; what has none of them reads the rows of files as they lie there.
_MOVES = ("Exchange", "Python", "Arrow", "Pandas", "Generate", "Expand", "Union", "Limit", "Sample", "Join", "Aggregate", "Window", "LocalTableScan", "ExistingRDD")


def row_keys(df: DataFrame) -> tuple[DataFrame, Column]:
    """df and a column that tells its rows apart: the file a row lies in and its place there.

    However the files are split, also if executors come and go between two reads, a row has the same key. A df that does
    more than read Parquet files is stored first.
    """
    plan = df._jdf.queryExecution().executedPlan().toString()
    if "parquet" not in plan or any(x in plan for x in _MOVES) or not df.inputFiles():
        df = stored(df, "rows")
    at = df.metadataColumn("_metadata")
    return df, F.struct(F.xxhash64(at["file_path"]).alias("file"), F.hash(at["file_path"]).alias("file2"), at["row_index"].alias("row"))


def drop_stored(df: DataFrame) -> None:
    """Deletes the files behind a stored() table that nothing reads any more."""
    spark = df.sparkSession
    for file in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Keys of dropped rows are broadcast up to this many (some 40 bytes each); beyond it the join is shuffled.
BROADCAST_KEYS = 500_000


def anti_join(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """rows without those whose key is in gone; rows stay where they are if there are few enough keys."""
    gone = stored(gone, "dropped-keys")
    return rows.join(F.broadcast(gone) if gone.count() <= BROADCAST_KEYS else gone, key, "left_anti")


def text_of(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    """The text column of a batch, which may be a field of its `row` column."""
    texts = batch.column(name) if name in batch.schema.names else batch.column("row").field(name)
    return texts if pa.types.is_string(texts.type) else texts.cast(pa.string())


def text_chunks(batches: Iterator[pa.RecordBatch], max_bytes: int = 4 << 20, max_rows: int = 4096, name: str = "text") -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches with a text column into slices of about max_bytes of text (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(text_of(batch, name)), 0).to_pylist()
        start = held = 0
        for i, n in enumerate(sizes):
            if i > start and (held + n > max_bytes or i - start >= max_rows):
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        yield batch.slice(start)
        del batch
        pa.default_memory_pool().release_unused()


def map_text(df: DataFrame, row_batch: Callable[[pa.RecordBatch], dict], schema: str, max_bytes: int = 4 << 20) -> DataFrame:
    """mapInArrow over (doc_id, text) slices of bounded size. row_batch returns the new columns; doc_id is added in front, with its own type."""
    id_type = df.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_chunks(batches, max_bytes):
            cols = row_batch(part)
            yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), **cols})

    return df.mapInArrow(run, f"doc_id {id_type}, {schema}")
