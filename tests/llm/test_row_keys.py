"""Keys of rows that stay the same however files are split."""

import pytest
from pyspark.sql import functions as F

from wrackline.llm import common, decontaminate, exact_dedup, simhash

from .conftest import prose


@pytest.fixture
def files(spark, tmp_path):
    """Files of several row groups, so that they can be split in many ways."""
    rows = [(i, prose(i % 40, 60) if i % 3 else prose(i, 60), f"m{i}") for i in range(900)]
    path = str(tmp_path / "docs")
    df = spark.createDataFrame(rows, "doc_id bigint, text string, _metadata string").repartition(3)
    df.write.option("parquet.block.size", 4096).option("parquet.page.size", 1024).parquet(path)
    return path


def split(spark, parallelism):
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    spark.conf.set("spark.sql.leafNodeDefaultParallelism", str(parallelism))


@pytest.fixture(autouse=True)
def as_before(spark):
    yield
    for c in ("spark.sql.files.openCostInBytes", "spark.sql.leafNodeDefaultParallelism"):
        spark.conf.unset(c)


def keys(df):
    rows, key = common.row_keys(df)
    return {r.doc_id: tuple(r.key) for r in rows.select("doc_id", key.alias("key")).collect()}


def test_keys_follow_the_files(spark, files):
    split(spark, 1)
    df = spark.read.parquet(files)
    few = df.rdd.getNumPartitions()
    first = keys(df)
    split(spark, 16)
    df = spark.read.parquet(files)
    assert df.rdd.getNumPartitions() > few
    assert keys(df) == first and len(set(first.values())) == 900
    assert keys(df.where("doc_id > 5").select("text", "doc_id")) == {i: k for i, k in first.items() if i > 5}


def test_other_inputs_are_stored(spark, files):
    df = spark.read.parquet(files)
    for other in (df.union(df), df.select("*", F.explode(F.array(F.lit(1), F.lit(2)))), df.repartition(4), df.limit(10), spark.createDataFrame([(1, "a"), (1, "a")], "doc_id int, text string")):
        rows, key = common.row_keys(other)
        assert rows.select(key.alias("k")).distinct().count() == rows.count() == other.count()


def test_stages_keep_the_right_rows_when_splits_change(spark, files, monkeypatch):
    """The number of cores changes between the scans of a stage; exactly one row of each text stays."""
    want = sorted({prose(i % 40, 60) if i % 3 else prose(i, 60) for i in range(900)})

    real = common.stored

    def moved(df, name):
        out = real(df, name)
        split(spark, 16)
        return out

    for module, stage in ((exact_dedup, exact_dedup.drop_copies), (simhash, simhash.drop_near_duplicates)):
        split(spark, 1)
        monkeypatch.setattr(module, "stored", moved)
        kept = stage(spark.read.parquet(files)).collect()
        assert sorted(r.text for r in kept) == want and all(r._metadata == f"m{r.doc_id}" for r in kept)
    split(spark, 1)
    monkeypatch.setattr(decontaminate, "stored", moved)
    bench = spark.createDataFrame([("a", prose(0, 60)), ("b", prose(7, 60)), ("c", prose(3, 60))], "item_id string, text string")
    kept = decontaminate.drop_contaminated(spark.read.parquet(files), bench, part_windows=30).collect()
    assert sorted(r.doc_id for r in kept) == [i for i in range(900) if (i % 40 if i % 3 else i) not in (0, 3, 7)]
