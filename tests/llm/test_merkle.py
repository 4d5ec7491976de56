"""Hash trees against a plain recursive version."""

import hashlib
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from wrackline.llm import merkle

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(nodes, fanout):
    """Root, and for each node the (left, right) siblings on its way up."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(paths):
            start = at[i] - at[i] % fanout
            p.append((nodes[start : at[i]], nodes[at[i] + 1 : start + fanout]))
            at[i] //= fanout
        nodes = [sha("".join(nodes[i : i + fanout])) for i in range(0, len(nodes), fanout)]
    return nodes[0], paths


def brute(rows, fanout):
    """(doc_id, leaf, subroot, root, path) by rows of COLUMNS."""
    groups = {}
    for r in rows:
        groups.setdefault("" if r[1] is None else "=" + r[1], []).append((r[0], leaf(r)))
    names = sorted(groups, key=lambda s: s.encode())
    subs = [tree([h for _, h in sorted(groups[s], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))], fanout) for s in names]
    root, tops = tree([s[0] for s in subs], fanout)
    out = []
    for name, (sub, paths), top in zip(names, subs, tops, strict=True):
        for (i, h), p in zip(sorted(groups[name], key=lambda x: (x[0] is not None, x[0] or 0, x[1])), paths, strict=True):
            out.append((i, h, sub, root, p + top))
    return sorted(out, key=str)


def rows_of(n, sources):
    out = []
    for i in range(n):
        source = None if i % 11 == 3 else f"s{i % sources if i % 3 else 0}"
        out.append((i, source, None if i % 7 == 0 else "en", i * 3, None if i % 13 == 5 else "" if i % 13 == 6 else f"Text ä {i % 50}"))
    return out + out[5:9] + [(None, "s0", "en", 1, "Q"), (None, None, None, None, None), (-4, "é", "xx", 0, "x" * 300_000)]


def got(df, **more):
    return sorted(((r.id, r.leaf, r.subroot, r.root, [(p.left, p.right) for p in r.path]) for r in merkle.manifest(df, **more).collect()), key=str)


@pytest.mark.parametrize(("n", "sources", "fanout", "levels"), [(150, 4, 2, 1), (300, 40, 3, 1), (90, 2, 4, 2), (500, 1, 2, 2), (400, 7, 16, 3), (40, 3, 2, 0)])
def test_against_recursion(spark, n, sources, fanout, levels):
    """Complete and incomplete blocks, one group and many, rounds within groups and over them."""
    rows = rows_of(n, sources)
    df = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars bigint, text string").repartition(3)
    assert got(df, fanout=fanout, block_levels=levels) == brute(rows, fanout)


def test_starts_joined_in_a_shuffle_and_short_steps(spark, monkeypatch):
    monkeypatch.setattr(merkle, "BROADCAST_STARTS", -1)
    monkeypatch.setattr(merkle, "STEP", 2)
    rows = rows_of(200, 9)
    df = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars bigint, text string").repartition(5)
    assert got(df, fanout=2, block_levels=1) == brute(rows, 2)


def test_one_row_and_none(spark):
    df = spark.createDataFrame([(1, "s", "en", 1, "a")], "doc_id bigint, source string, lang string, n_chars bigint, text string")
    only = merkle.manifest(df).first()
    assert only.leaf == only.subroot == only.root and only.path == []
    assert merkle.manifest(df.where("doc_id > 1")).count() == 0


def test_clashing_names_and_repeats(spark):
    names = ["g", "tree", "id", "leaf", "h", "pos", "first", "rank", "runs", "tie", "part", "path", "root"]
    rows = [(7, "s", "en", 1, "a")] * 30
    df = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars bigint, text string").withColumns({c: F.lit(c) for c in names})
    assert got(df, fanout=2, block_levels=1) == brute(rows, 2)
    carried = merkle.manifest(df, carry=["leaf", "g"]).select("carried.leaf", "carried.g").distinct().collect()
    assert [tuple(r) for r in carried] == [("leaf", "g")]


def test_folding_finds_what_was_changed(spark):
    rows = rows_of(60, 3)
    df = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars bigint, text string")
    other = merkle.leaf_hash([F.col(c) if c != "text" else F.concat("text", F.lit("!")) for c in COLUMNS])
    found = merkle.manifest(df.withColumn("other", other), carry=["other"], fanout=2, block_levels=1)
    folded = found.select("id", "root", merkle.fold_path(F.col("leaf"), F.col("path")).alias("own"), merkle.fold_path(F.col("carried.other"), F.col("path")).alias("changed"), (F.col("leaf") != F.col("carried.other")).alias("differs"))
    assert all(r.own == r.root and (r.changed != r.root) == r.differs for r in folded.collect())


def test_query_against_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    rel = con.sql(merkle.OP12_SQL)
    rows = merkle.op12_merkle(spark, sf_dir).collect()
    assert sorted(tuple(r[c] for c in rel.columns) for r in rows) == sorted(rel.fetchall())
    texts = {r[0]: r[1] for r in con.sql("SELECT doc_id, text FROM documents").fetchall()}
    assert all(r.verified != (zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and any("A" <= c <= "Z" for c in texts[r.doc_id] or "")) for r in rows)
