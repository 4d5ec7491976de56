"""Archives written, normalised and read back, against a plain version."""

import glob
import gzip
import hashlib
import json
import os
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from wrackline.llm import warc

LONG = "<p>ä</p>" * 200
PAGES = [
    (1, "http://a/1", LONG), (2, "http://a/2", LONG), (9, None, LONG), (3, "http://a/3 x\r\nWARC-Type: y", "<p>short</p>"), (4, "u", "<p>short</p>"), (5, "u", None), (6, "u", ""),
    (None, "u", LONG), (None, "n", "q" * 1000), (None, "n", "q" * 1000), (7, "u", "é" * 3_000_000), (9, "again", LONG), (11, "x", "z" * 999), (10, "x", "z" * 999), (12, "y", "WARC/1.1\r\n\r\n" * 100), (13, "y", "WARC/1.1\r\n\r\n" * 100),
    (14, "z", "\x00  \r\n\r\n binary"),
]


def brute(pages):
    top = {}
    for i, _, h in pages:
        h = (h or "").encode()
        if i is not None:
            top[h] = max(top.get(h, i), i)
    out = []
    for i, _, h in pages:
        h = (h or "").encode()
        refers = top.get(h) if len(h) >= 1000 and i != top.get(h) else None
        out.append((i, len(h), hashlib.sha1(h).hexdigest(), "response" if refers is None else "revisit", refers))
    return sorted(out, key=str)


@pytest.fixture
def pages(spark):
    df = spark.createDataFrame(PAGES, "page_id bigint, url string, html string")
    return df.withColumns({c: F.lit("c") for c in ("key", "salt", "payload", "digest", "top", "archive", "refers_to", "n")}).repartition(3)


def read_back(spark, df, folder, **more):
    normal = warc.normalise(warc.write_monolithic(df, f"{folder}/mono", **more), f"{folder}/normal")
    return normal, warc.fetch(warc.read_index(normal)).collect()


def summary(rows):
    number = lambda urn: int(urn[len("<urn:x-page:") : -1]) if urn and urn.startswith("<urn:x-page:") else None
    out = []
    for r in rows:
        if r.payload is not None:
            assert (r.payload_bytes, r.payload_digest) == (len(r.payload), hashlib.sha1(bytes(r.payload)).hexdigest())
        out.append((number(r.record_id), r.payload_bytes, r.payload_digest, r.record_type, number(r.refers_to)))
    return sorted(out, key=str)


@pytest.mark.parametrize(("repeats", "archive_bytes"), [(warc.BROADCAST_REPEATS, 64 << 20), (-1, 3000)])
def test_round_trip(spark, pages, tmp_path, monkeypatch, repeats, archive_bytes):
    monkeypatch.setattr(warc, "BROADCAST_REPEATS", repeats)
    normal, rows = read_back(spark, warc.records(pages), f"file://{tmp_path}", archive_bytes=archive_bytes)
    assert summary(rows) == brute(PAGES)
    assert {bytes(r.payload) for r in rows if r.payload is not None} == {(h or "").encode() for _, _, h in PAGES}
    for path in glob.glob(f"{tmp_path}/mono/*.warc.gz"):
        unpack = zlib.decompressobj(31)
        unpack.decompress(open(path, "rb").read())
        assert unpack.eof and not unpack.unused_data  # one stream a file
    for path in glob.glob(f"{tmp_path}/normal/*.warc.gz"):
        data, lines = open(path, "rb").read(), [json.loads(x) for x in open(path + ".idx")]
        assert [x["offset"] for x in lines] == [sum(x["length"] for x in lines[:i]) for i in range(len(lines))] and sum(x["length"] for x in lines) == len(data)
        for x in lines:
            member = zlib.decompress(data[x["offset"] : x["offset"] + x["length"]], 31)
            assert member.startswith(b"WARC/1.1\r\n") and member.endswith(b"\r\n\r\n")
    assert sum(r.n_records for r in normal.collect()) == len(PAGES)


def test_other_layouts(spark, tmp_path):
    """Plain text, members already, members of several records, folded headers, no blank lines at the end."""
    rec = lambda i, body: b"WARC/1.0\r\nWARC-Type: resource\r\nwarc-record-id: <urn:x-page:%d>\r\nX-Long: a\r\n  b\r\nContent-Length: %d\r\n\r\n" % (i, len(body)) + body
    recs = [rec(i, b"x" * i) + b"\r\n\r\n" for i in range(5)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/plain.warc").write_bytes(b"".join(recs).rstrip(b"\r\n"))
    (tmp_path / "in/members.warc.gz").write_bytes(b"".join(map(gzip.compress, recs)))
    (tmp_path / "in/mixed.warc.gz").write_bytes(gzip.compress(b"".join(recs[:3])) + gzip.compress(b"".join(recs[3:])))
    (tmp_path / "in/none.warc.gz").write_bytes(gzip.compress(b""))
    archives = spark.createDataFrame([(f"file://{p}",) for p in glob.glob(f"{tmp_path}/in/*")], "archive string")
    normal = warc.normalise(archives, f"file://{tmp_path}/out")
    rows = warc.fetch(warc.read_index(normal)).collect()
    assert sorted((r.record_id, bytes(r.payload)) for r in rows) == sorted((f"<urn:x-page:{i}>", b"x" * i) for i in range(5) for _ in range(3))
    assert sorted(r.n_records for r in normal.collect()) == [0, 5, 5, 5]


def test_damage(spark, tmp_path):
    whole = b"".join(b"WARC/1.0\r\nWARC-Type: resource\r\nContent-Length: 3000\r\n\r\n" + os.urandom(3000) + b"\r\n\r\n" for _ in range(4))
    (tmp_path / "cut.warc.gz").write_bytes(gzip.compress(whole)[:-5000])
    (tmp_path / "bad.warc.gz").write_bytes(gzip.compress(whole + b"garbage\r\n"))
    (tmp_path / "length.warc").write_bytes(b"WARC/1.0\r\nWARC-Type: resource\r\n\r\nabc")
    paths = [f"file://{tmp_path}/{n}" for n in ("cut.warc.gz", "bad.warc.gz", "length.warc")]
    archives = spark.createDataFrame([(p,) for p in paths], "archive string")
    kept = warc.normalise(archives, f"file://{tmp_path}/out", strict=False)
    assert sorted(r.n_records for r in kept.collect()) == [0, 2, 4] and all(r.damage for r in kept.collect())
    assert warc.fetch(warc.read_index(kept)).count() == 6
    for p in paths:
        with pytest.raises(Exception, match="after . records"):
            warc.normalise(archives.where(F.col("archive") == p), f"file://{tmp_path}/out")


def test_empty_table(spark, pages, tmp_path):
    normal, rows = read_back(spark, warc.records(pages.where("page_id < 0")), f"file://{tmp_path}")
    assert rows == [] and normal.count() == 0


def test_query_against_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf_dir}/pages.parquet'")
    rel = con.sql(warc.OP13_SQL)
    assert sorted((tuple(r[c] for c in rel.columns) for r in warc.op13_warc(spark, sf_dir).collect()), key=str) == sorted(rel.fetchall(), key=str)
    con.execute("CREATE OR REPLACE VIEW pages AS SELECT * FROM (VALUES (1, repeat('a', 1000)), (2, repeat('a', 1000)), (3, 'b'), (4, 'b'), (5, NULL)) t(page_id, html)")
    assert sorted(con.sql(warc.OP13_SQL).fetchall(), key=str) == brute([(1, "", "a" * 1000), (2, "", "a" * 1000), (3, "", "b"), (4, "", "b"), (5, "", None)])
