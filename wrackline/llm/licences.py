"""Licence scans: sparse TF-IDF cosine of passages to licence templates, then inheritance from the nearest ancestor folder.

Passages are the lines, the sentences and the blocks between blank lines of every text, and the whole text of a licence
file (LICENSE, COPYING and so on by its name) or of a row without a file name (its path ends with a slash). Terms are lower-case runs of letters and digits; their document frequencies
are counted over all rows. Document frequencies below are those of the table at hand.

Only passages that can reach `LEAST` are kept, by two bounds after Cauchy and Schwarz that drop no match: a passage without
any of the rarest terms of a template (as many as leave the other terms under LEAST of its length) has a smaller cosine to
it; and so has one of which the terms of all templates make up less than LEAST of its length, other terms weighing 1 at least.
The terms of the kept passages meet their document frequencies in a join: terms in over a thousandth of the rows are at
most a thousand times the mean number of distinct terms of a text and are broadcast, the others join by hash. The
templates are constants of this module.

Near licences differ in few terms, so these decide: of a licence with versions or clauses (GNU, Apache, Creative Commons,
Eclipse, Mozilla, BSD) only a template counts whose version and clause terms are those of the passage. A version or
combination that no template has, and a notice of such a licence without its version, match nothing.

A row without a licence of its own takes that of the deepest ancestor folder that has a licence file with one; of several
such files in a folder the best match counts. A row without a file name is a licence file if its text is mostly one: if the
cosine of the whole text is MOSTLY or more, half of its squared length being along the template.

Defined results: null and empty texts have no licence of their own; very long texts are scanned whole; null ids
are carried; repeated rows are scanned one by one; a null path inherits nothing and gives nothing; ties go to the first licence by name; other
columns are not read, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored, table

LEAST = 0.6
MOSTLY = math.sqrt(0.5)
FREQUENT = 1000
#: Folder tables are broadcast up to this many rows; beyond it the join is shuffled, with each folder dealt to SALTS keys.
BROADCAST_FOLDERS, SALTS = 500_000, 16
LICENCE_FILE = r"(?i)^(licen[cs]e|copying|copyright|notice|unlicense)([._-].*)?$"
_CREATIVE = "This work is licensed under a Creative Commons {} International License."
_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} General Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD3 = " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
#: Notices, headers and main clauses of each licence.
TEMPLATES: list[tuple[str, str]] = [
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", _GNU.format("Affero", 3)),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-2-Clause", _BSD),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", _BSD + _BSD3),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", _CREATIVE.format("Attribution 4.0")),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", _CREATIVE.format("Attribution-NonCommercial 4.0")),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", _CREATIVE.format("Attribution-ShareAlike 4.0")),
    ("CC0-1.0", "Released under CC0 1.0 Universal, dedicated to the public domain."),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", _GNU.format("", 2)),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", _GNU.format("", 3)),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", _GNU.format("Lesser", 3)),
    ("MIT", "Released under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("Apache-1.1", "The Apache Software License, Version 1.1"),
    ("Apache-1.1", "Licensed under the Apache License, Version 1.1."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("CC-BY-NC-ND-4.0", _CREATIVE.format("Attribution-NonCommercial-NoDerivatives 4.0")),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-SA-4.0", _CREATIVE.format("Attribution-NonCommercial-ShareAlike 4.0")),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-ND-4.0", _CREATIVE.format("Attribution-NoDerivatives 4.0")),
    ("EPL-1.0", "Eclipse Public License - v 1.0"),
    ("EPL-2.0", "Eclipse Public License - v 2.0"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("LGPL-2.0", "GNU LIBRARY GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("LGPL-2.1", "Licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-2.1", _GNU.format("Lesser", 2.1)),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("MIT", "The MIT License"),
    ("MPL-1.1", "Mozilla Public License Version 1.1"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
]


_SPDX = "SPDX-License-Identifier: "
TEMPLATES += [(name, _SPDX + name) for name in sorted({name for name, _ in TEMPLATES})]

#: Terms that decide between near licences, each with what it stands for; versions stand for themselves, without a last ".0".
_NAMES = {"affero": "affero", "lesser": "lesser", "library": "library", "endorse": "endorse", "nc": "nc", "noncommercial": "nc", "nd": "nd", "noderivatives": "nd", "noderivs": "nd", "sa": "sa", "sharealike": "sa"}
_VERSIONS = ("0", "1", "1.1", "1.2", "2", "2.1", "2.5", "3", "4")
_FAMILIES = "agpl apache bsd by cc cc0 epl gpl isc lgpl mit mpl unlicense".split()
MARKS = {**_NAMES, **{v: v for v in _VERSIONS}, **{f"{v}.0": v for v in _VERSIONS if "." not in v}, **{t: t for t in _FAMILIES}}
#: What a passage must have just as the template does, by the start of a licence's name.
_DECIDES = {
    "AGPL": ("affero", "lesser", "library", *_VERSIONS), "GPL": ("affero", "lesser", "library", *_VERSIONS), "LGPL-2.0": ("library", *_VERSIONS), "LGPL": ("affero", "lesser", *_VERSIONS),
    "Apache": _VERSIONS, "CC-": ("nc", "nd", "sa", *_VERSIONS), "EPL": _VERSIONS, "MPL": _VERSIONS,
}


def deciding(name: str, text: str) -> set[str]:
    """The marks that a passage must share with this template, where either has them."""
    if text.startswith(_SPDX):  # the identifier as a whole; an expression of several licences has none
        return set(MARKS.values())
    if name.startswith("BSD"):  # notices by their number of clauses, texts by the third clause
        return {"endorse"} if text.startswith("Redistribution") else {"endorse", *_VERSIONS}
    return set(next((marks for start, marks in _DECIDES.items() if name.startswith(start)), ()))


def terms_of(text: Column) -> Column:
    """Lower-case runs of letters and digits, in order; a dot between digits belongs to the run, so that 2.1 is a term."""
    return F.filter(F.split(F.lower(text), r"(?:(?<![0-9])\.|\.(?![0-9])|[^\p{L}\p{N}.])+"), lambda t: t != "")


def _template_terms() -> list[dict[str, int]]:
    out = []
    for _, text in TEMPLATES:
        found: dict[str, int] = {}
        for t in filter(None, re.split(r"(?:(?<![0-9])\.|\.(?![0-9])|[^\w.]|_)+", text.lower())):
            found[t] = found.get(t, 0) + 1
        out.append(found)
    return out


def idf(df: float, rows: int) -> float:
    return math.log((1 + rows) / (1 + df)) + 1


def anchors(vectors: list[dict[str, float]], seen: dict[str, int], least: float = LEAST) -> set[str]:
    """Terms of which a passage must have one to reach `least`: the rarest of each template of length 1."""
    out = set()
    for vector in vectors:
        rest = 1.0
        for term, w in sorted(vector.items(), key=lambda x: (seen.get(x[0], 0), x[0])):
            if rest < (least - 1e-6) ** 2:
                break
            out.add(term)
            rest -= w * w
    return out


def word_pattern(words: set[str]) -> str:
    """One of the words, between signs that belong to no term; branches share their first letter."""
    first: dict[str, list[str]] = {}
    for w in sorted(words):
        first.setdefault(w[0], []).append(re.escape(w[1:]))
    return r"(?:^|[^\p{L}\p{N}])(?:" + "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in first.items()) + r")(?![\p{L}\p{N}])"


def can_reach(terms: list[str], weight: dict[str, float], least: float = LEAST) -> bool:
    """Whether terms of templates may make up `least` of the passage's length; weight: IDF of those terms."""
    within = without = 0.0
    for t, k in Counter(terms).items():
        if t in weight:
            within += (k * weight[t]) ** 2
        else:
            without += k * k
    return within >= (least - 1e-6) ** 2 * (within + without)


def _passages(text: Column, whole: Column, pattern: str) -> Column:
    """Terms of each passage with a word of the pattern. The first is the whole text, without terms where that is no passage."""
    parts = F.concat(F.split(text, r"[\r\n]+"), F.split(text, r"[\r\n]+|(?<=[.!?;])\s+"), F.split(text, r"\r?\n[^\p{L}\p{N}\n]*\n"))
    none = F.array().cast("array<string>")
    parts = F.array_except(parts, F.when(whole, F.array(text)).otherwise(none))  # each passage once
    return F.concat(F.array(F.when(whole, terms_of(text)).otherwise(none)), F.transform(F.filter(parts, lambda p: F.lower(p).rlike(pattern)), terms_of))


def _own(base: DataFrame, frequency: DataFrame, n: int, vectors: list[dict[str, float]]) -> DataFrame:
    """row, best (score, licence) of the rows of base with a passage that reaches LEAST, and whole: that of the whole text."""
    spark = base.sparkSession
    one = base.select("row", F.posexplode("passages").alias("passage", "terms")).select("row", "passage", F.explode("terms").alias("term"))
    tf = one.groupBy("row", "passage", "term").agg(F.count("*").alias("tf"))
    common = frequency.where(F.col("df") * FREQUENT > n)
    rare = frequency.where(F.col("df") * FREQUENT <= n)
    met = tf.join(F.broadcast(common), "term", "left")
    known = met.where("df is not null")
    found = met.where("df is null").drop("df").join(rare, "term").select(known.columns).unionByName(known)
    weight = F.col("tf") * (F.log((1.0 + n) / (1.0 + F.col("df"))) + 1.0)
    every = sorted({t for v in vectors for t in v})
    weights = spark.createDataFrame([(t, [v.get(t, 0.0) for v in vectors]) for t in every], "term string, w array<double>")
    bit = {mark: 1 << i for i, mark in enumerate(sorted(set(MARKS.values())))}
    has = F.create_map(*[F.lit(v) for term, mark in MARKS.items() for v in (term, bit[mark])])
    x = found.join(F.broadcast(weights), "term", "left").select("row", "passage", weight.alias("x"), "w", F.coalesce(has[F.col("term")], F.lit(0)).cast("bigint").alias("mark"))
    sums = [F.sum(F.when(F.col("w").isNotNull(), F.col("x") * F.col("w")[i])).alias(f"t{i}") for i in range(len(vectors))]
    dots = x.groupBy("row", "passage").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"), F.bit_or("mark").alias("marks"), *sums)
    # the least of (-cosine, name), cosines to 9 digits so that sums in another order give the same
    each = []
    for i, ((name, text), terms) in enumerate(zip(TEMPLATES, _template_terms(), strict=True)):
        decides = deciding(name, text)
        own = sum({bit[MARKS[t]] for t in terms if MARKS.get(t) in decides})
        alike = F.col("marks").bitwiseAND(F.lit(sum(bit[m] for m in decides)).cast("bigint")) == own
        cosine = F.when(alike, F.coalesce(F.col(f"t{i}") / F.col("norm"), F.lit(0.0))).otherwise(0.0)
        each.append(F.struct((-F.round(cosine, 9)).alias("minus"), F.lit(name).alias("licence")))
    cosines = F.array(*each)
    best = dots.select("row", "passage", F.array_min(cosines).alias("best"))
    best = best.groupBy("row").agg(F.min("best").alias("best"), F.min(F.when(F.col("passage") == 0, F.col("best"))).alias("whole"))
    return best.where(F.col("best.minus") <= -LEAST)


def _with_folder(rows: DataFrame, folders: DataFrame, n: int, how: str) -> DataFrame:
    """Joins folders to rows on `folder`: by broadcast up to a fixed size, beyond it dealt to SALTS keys of each folder."""
    if n <= BROADCAST_FOLDERS:
        return rows.join(F.broadcast(folders), "folder", how)
    salted = folders.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    return rows.withColumn("salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int")).join(salted, ["folder", "salt"], how).drop("salt")


def find_licences(df: DataFrame, path: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, licence, score (of its own passage, else null), origin ('own', 'inherited' or 'none'), licensed_by (folder)."""
    text = F.coalesce(df[text_col].cast("string"), F.lit(""))
    rows = df.select(df[id_col].alias("doc_id"), path.cast("string").alias("path"), text.alias("text"))
    # counting goes before keeping: the anchors depend on the frequencies of the templates' terms
    frequency = stored(rows.select(F.explode(F.array_distinct(terms_of(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("df")), "frequencies")
    n = rows.count()
    own_terms = _template_terms()
    every = sorted({t for v in own_terms for t in v})
    seen = {r["term"]: r["df"] for r in frequency.where(F.col("term").isin(every)).collect()}
    vectors = []
    for v in own_terms:
        w = {t: k * idf(seen.get(t, 0), n) for t, k in v.items()}
        length = math.sqrt(sum(x * x for x in w.values()))
        vectors.append({t: x / length for t, x in w.items()})
    pattern = word_pattern(anchors(vectors, seen))
    weight = {t: idf(seen.get(t, 0), n) for t in every}

    name = F.element_at(F.split("path", "/"), -1)
    is_file = F.coalesce(name.rlike(LICENCE_FILE), F.lit(False))
    nameless = F.coalesce(name == "", F.lit(False))
    folder = F.regexp_replace("path", "/?[^/]*$", "")
    met = rows.select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        folder.alias("folder"),
        is_file.alias("is_file"),
        nameless.alias("nameless"),
        F.when(F.lower("text").rlike(pattern), _passages(F.col("text"), is_file | nameless, pattern)).alias("passages"),
    )

    def reaching(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            some = [kept(p.as_py()) for p in b.column("passages")]  # a row at a time: whole texts may be long
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(some, pa.list_(pa.list_(pa.string())))], schema.names)

    def kept(passages: list[list[str]] | None) -> list[list[str]] | None:
        if passages is None:
            return None
        whole, *parts = [ts if can_reach(ts, weight) else [] for ts in passages]
        parts = list(filter(None, parts))
        return [whole, *parts] if whole or parts else None

    schema = T.StructType([*met.schema.fields[:5], T.StructField("passages", T._parse_datatype_string("array<array<string>>"))])
    base = stored(met.mapInArrow(reaching, schema), "passages")
    best = stored(_own(base.where("passages is not null"), frequency, n, vectors), "licences")
    licensed = base.drop("passages").join(best, "row", "left")

    # the least (-cosine, name) of each folder's licence files, then the deepest licensed ancestor of every folder in use
    file = F.when(F.col("is_file"), F.col("best")).when(F.col("nameless") & (F.col("whole.minus") <= -MOSTLY), F.col("whole"))
    files = stored(licensed.select("folder", file.alias("file")).where("folder is not null and file is not null").groupBy("folder").agg(F.min("file").alias("file")), "files")
    used = licensed.select("folder").where("folder is not null").distinct()
    parts = F.split("here", "/")
    depths = F.sequence(F.lit(0), F.when(F.col("here") == "", 0).otherwise(F.size(parts)))
    above = used.select(F.col("folder").alias("here")).select("here", F.explode(depths).alias("depth"), parts.alias("parts"))
    above = above.select("here", "depth", F.array_join(F.slice("parts", 1, F.col("depth")), "/").alias("folder"))
    above = above.where((F.col("depth") == 0) | (F.col("folder") != ""))  # '/a' has the root twice
    nearest = _with_folder(above, files, files.count(), "inner").groupBy("here").agg(F.max_by(F.struct("folder", "file"), "depth").alias("near"))
    nearest = stored(nearest.select(F.col("here").alias("folder"), "near"), "nearest")
    out = _with_folder(licensed, nearest, nearest.count(), "left")
    return out.select(
        "doc_id",
        F.coalesce("best.licence", "near.file.licence").alias("licence"),
        (-F.col("best.minus")).alias("score"),
        F.when(F.col("best").isNotNull(), "own").when(F.col("near").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(F.col("best").isNull(), F.col("near.folder")).alias("licensed_by"),
    )


def op5_licences(spark, sf_dir: str) -> DataFrame:
    """A document lies in the folder of its source, in none if that is null or empty. Documents have no file names, so those
    that are mostly licence text are the licence files."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return find_licences(docs, F.concat(F.nullif("source", F.lit("")), F.lit("/")))
