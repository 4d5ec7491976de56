"""Licence scans against brute force, and inheritance along paths."""

import math
import re
from collections import Counter

import pyspark.sql.functions as F

import __spark_entry__
from wrackline.llm import licences as li

MIT = "Released under the MIT License."
APACHE = "Licensed under the Apache License, Version 2.0."
ROWS = [
    (1, "LICENSE", MIT),
    (2, "a/x.py", "print the sum of one"),
    (3, "a/b/LICENSE.txt", "This work is licensed under the GNU General Public License, version 3."),
    (4, "a/b/c/y.py", "of the other sum"),
    (5, "a/b/c/z.py", f"# {APACHE}\nx = 1"),
    (6, "a/b/c/z.py", f"a text that ends so; {APACHE} And goes on with other words of the day"),
    (7, None, "no path"),
    (None, "ab/w.py", ""),
    (None, "ab/w.py", None),
    (8, "d/LICENSE", "nothing of that sort"),
    (9, "d/v.py", "the day"),
]


def words(text):
    out = re.sub(r"[^\w.]|_", " ", (text or "").lower())
    out = re.sub(r"(?<![0-9])\.|\.(?![0-9])", " ", out)
    return out.split()


def brute(rows):
    """Best cosine of every row, without any pruning."""
    df = Counter(t for _, _, text in rows for t in set(words(text)))
    vector = lambda text: {t: k * li.idf(df[t], len(rows)) for t, k in Counter(words(text)).items()}
    length = lambda v: math.sqrt(sum(x * x for x in v.values()))
    out = []
    for _, path, text in rows:
        text = text or ""
        passages = re.split(r"[\r\n]+", text) + re.split(r"[\r\n]+|(?<=[.!?;])\s+", text) + re.split(r"\r?\n[^\w\n]*\n", text)
        if re.match(li.LICENCE_FILE, (path or "").split("/")[-1]):
            passages.append(text)
        best = (0.0, None)
        for p in map(vector, passages):
            marks = {li.MARKS[t] for t in p if t in li.MARKS}
            for name, template in li.TEMPLATES:
                decides = li.deciding(name, template)
                if marks & decides != {li.MARKS[t] for t in words(template) if t in li.MARKS} & decides:
                    continue
                t = vector(template)
                cos = sum(x * t.get(k, 0) for k, x in p.items()) / (length(p) * length(t)) if p else 0
                best = min(best, (-round(cos, 9), name)) if cos >= li.LEAST else best
        out.append(best)
    return out


def test_inheritance(spark):
    docs = spark.createDataFrame(ROWS, "doc_id int, path string, text string")
    got = [(r.doc_id, r.licence, r.origin, r.licensed_by) for r in li.find_licences(docs, docs.path).collect()]
    want = [
        (1, "MIT", "own", None),
        (2, "MIT", "inherited", ""),
        (3, "GPL-3.0", "own", None),
        (4, "GPL-3.0", "inherited", "a/b"),
        (5, "Apache-2.0", "own", None),
        (6, "Apache-2.0", "own", None),
        (7, None, "none", None),
        (None, "MIT", "inherited", ""),
        (None, "MIT", "inherited", ""),
        (8, "MIT", "inherited", ""),
        (9, "MIT", "inherited", ""),
    ]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_salted_folders(spark, monkeypatch):
    docs = spark.createDataFrame(ROWS, "doc_id int, path string, text string")
    want = sorted(map(str, li.find_licences(docs, docs.path).collect()))
    monkeypatch.setattr(li, "BROADCAST_FOLDERS", -1)
    assert sorted(map(str, li.find_licences(docs, docs.path).collect())) == want


def test_query_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()
    want = dict(zip((d.doc_id for d in docs), brute([(d.doc_id, f"{d.source}/{d.doc_id}", d.text) for d in docs]), strict=True))
    got = __spark_entry__.queries()["op5_licences"](spark, sf_dir).collect()
    assert len(got) == len(docs) and any(r.licence for r in got)
    for r in got:
        minus, name = want[r.doc_id]
        assert r.licence == name and (name is None or abs(r.score + minus) < 1e-6), r


def test_query_inherits_within_sources(spark, tmp_path):
    """Documents that are mostly licence text are the licence files of their sources."""
    rows = [
        (1, "s1", MIT),
        (2, "s1", "the sum of one"),
        (3, "s1/sub", "other words"),
        (4, "s1/own", "Licensed under the Apache\n\nLicense, Version 2.0."),
        (5, "s1/own", None),
        (6, "s2", f"a long text of many words that are not those of any licence whatever and that tells of tides\n{MIT}"),
        (7, "s2", "of the day"),
        (8, None, APACHE),
        (9, None, "of a sum"),
        (10, "", APACHE),
        (11, "", "the sum"),
        (12, "s3", "the day"),
        (None, "s1", "one day"),
    ]
    spark.createDataFrame(rows, "doc_id int, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.licence, r.origin, r.licensed_by) for r in __spark_entry__.queries()["op5_licences"](spark, str(tmp_path)).collect()}
    mit, apache, none = ("MIT", "inherited", "s1"), ("Apache-2.0", "own", None), (None, "none", None)
    assert got == {
        1: ("MIT", "own", None), 2: mit, 3: mit, 4: apache, 5: ("Apache-2.0", "inherited", "s1/own"), 6: ("MIT", "own", None),
        7: none, 8: apache, 9: none, 10: apache, 11: none, 12: none, None: mit,
    }


NEAR = [
    ("GNU LESSER GENERAL PUBLIC LICENSE\n Version 2.1, February 1999", "LGPL-2.1"),
    ("x = 1\n\nGNU LESSER GENERAL PUBLIC LICENSE\nVersion 2.1, February 1999\n\ny", "LGPL-2.1"),
    ("Licensed under the GNU Lesser General Public License, version 2.1.", "LGPL-2.1"),
    ("Licensed under the GNU Lesser General Public License, version 3.", "LGPL-3.0"),
    ("Licensed under the GNU General Public License, version 2.0.", "GPL-2.0"),
    ("Licensed under the GNU General Public License, version 7.", None),
    ("GNU LIBRARY GENERAL PUBLIC LICENSE Version 2, June 1991", "LGPL-2.0"),
    ("Licensed under CC BY-ND 4.0.", "CC-BY-ND-4.0"),
    ("Licensed under CC BY-NC-SA 4.0.", "CC-BY-NC-SA-4.0"),
    ("Licensed under CC BY 4.0.", "CC-BY-4.0"),
    ("Licensed under CC BY 3.0.", None),
    ("Apache License, Version 1.1", "Apache-1.1"),
    ("Licensed under the Apache License, Version 1.0.", None),
    ("Licensed under the Apache License, Version 2.0.", "Apache-2.0"),
    ("# SPDX-License-Identifier: MIT", "MIT"),
    ("/* SPDX-License-Identifier: GPL-2.0-or-later */", "GPL-2.0"),
    ("// SPDX-License-Identifier: CC-BY-NC-4.0", "CC-BY-NC-4.0"),
    ("// SPDX-License-Identifier: MIT OR Apache-2.0", None),
    ("// SPDX-License-Identifier: Zlib", None),
    ("Eclipse Public License - v 2.0", "EPL-2.0"),
    ("Eclipse Public License - v 1.0", "EPL-1.0"),
    ("MIT License", "MIT"),
    ("The MIT License (MIT)", "MIT"),
    ("Licensed under the BSD 3-Clause License.", "BSD-3-Clause"),
    ("Licensed under the BSD 4-Clause License.", None),
    (li._BSD, "BSD-2-Clause"),
    (li._BSD + li._BSD3, "BSD-3-Clause"),
]


def test_versions_and_clauses_decide(spark):
    filler = [(100 + i, "a/f.txt", "the print of this work and that license file is under no other version of the day") for i in range(40)]
    docs = spark.createDataFrame([(i, f"a/{i}.py", text) for i, (text, _) in enumerate(NEAR)] + filler, "doc_id int, path string, text string")
    got = {r.doc_id: r.licence for r in li.find_licences(docs, docs.path).collect()}
    assert [got[i] for i in range(len(NEAR))] == [name for _, name in NEAR]


def test_long_texts_repeated_rows_and_clashing_columns(spark):
    long = "word and other words of the day. " * 60_000
    rows = [(1, "p/a", long + APACHE + " " + long), (2, "p/b", MIT), (2, "p/b", MIT), (3, "p/c", f"{MIT}\n{APACHE}")]
    docs = spark.createDataFrame(rows, "doc_id int, path string, text string")
    for c in ("row", "term", "tf", "df", "w", "folder", "best", "passages", "marks", "licence", "near"):
        docs = docs.withColumn(c, F.lit(c))
    got = sorted((r.doc_id, r.licence, r.origin) for r in li.find_licences(docs, docs.path).collect())
    tie = next(name for i, name, _ in got if i == 3)
    assert tie in ("MIT", "Apache-2.0")
    assert got == [(1, "Apache-2.0", "own"), (2, "MIT", "own"), (2, "MIT", "own"), (3, tie, "own")]


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id int, path string, text string")
    assert li.find_licences(docs, F.col("path")).count() == 0
