import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from wrackline.llm import toxicity as tx

from .conftest import prose


def labelled_rows(n=900):
    r = random.Random(4)
    rows = []
    for i in range(n):
        words = prose(100 + i, r.randint(20, 200)).split()
        bad = i % 5 == 0
        for _ in range(3 if bad else 0):
            words.insert(r.randrange(len(words)), r.choice(("vile", "nasty", "awful")))
        rows.append((i, " ".join(words), int(bad)))
    return rows


@pytest.fixture(scope="module")
def model(spark):
    df = spark.createDataFrame(labelled_rows()[:600] + [(None, None, 1), (1, "x", None)], "doc_id int, text string, toxic int")
    return tx.learn(df, F.coalesce(F.col("doc_id") % 4, F.lit(1)))


def test_held_out(model):
    rows = labelled_rows()[600:]
    score = model.model().scores([t for _, t, _ in rows])
    y = np.array([b for _, _, b in rows])
    assert ((score >= tx.THRESHOLD) == y).mean() > 0.97


def plain_model(texts):
    """P(word) and what a context adds, straight from the formulas: functions own(word) and added(first, second) of both classes."""
    P = tx.PAIR_DISCOUNT
    words = {y: [["", *tx.words_of(t)] for t, k in texts if k == y] for y in (0, 1)}
    pairs = {y: Counter(p for w in words[y] for p in zip(w, w[1:], strict=False)) for y in (0, 1)}
    every = [{w for ws in words[y] for w in ws[1:]} for y in (0, 1)]

    def level(types, D):  # types: of each class, the distinct (what is counted, by what) pairs
        c = [Counter(a for a, _ in types[y]) for y in (0, 1)]
        both = Counter(a for a, _ in types[0] | types[1])
        total = [sum(x.values()) for x in c]
        rest = [max(1e-3, sum(min(n, D) for n in x.values()) / t) if t else 1.0 for x, t in zip(c, total, strict=True)]
        return c, both, total, rest, sum(n + 0.5 for n in both.values()) or 1.0, D

    stem = {k: level([{(w[:k], w) for w in every[y] if len(w) >= k} for y in (0, 1)], tx.STEM_DISCOUNT) for k in tx.STEMS}
    unit = level([{(b, a) for a, b in pairs[y]} for y in (0, 1)], tx.WORD_DISCOUNT)

    def prob(lv, key, y, below):
        c, _, total, rest, _, D = lv
        return max(c[y][key] - D, 0) / max(total[y], 1) + rest[y] * tx.MET * below

    def four(w, y):
        return prob(stem[4], w[:4], y, (stem[4][1][w[:4]] + 0.5) / stem[4][4])

    def six(w, y):
        return prob(stem[6], w[:6], y, four(w, y) * (stem[6][1][w[:6]] + 0.5) / (stem[4][1][w[:4]] + 0.5))

    def word(w, y):
        n = unit[1][w] + 0.5
        if len(w) >= 6:
            return prob(unit, w, y, six(w, y) * n / (stem[6][1][w[:6]] + 0.5))
        return prob(unit, w, y, four(w, y) * n / (stem[4][1][w[:4]] + 0.5) if len(w) >= 4 else n / unit[4])

    seen = [Counter() for _ in (0, 1)]
    off = [Counter() for _ in (0, 1)]
    for y in (0, 1):
        for (a, _), n in pairs[y].items():
            seen[y][a] += n
            off[y][a] += min(n, P)

    def evidence(text):
        w = ["", *tx.words_of(text)]
        out = []
        for a, b in zip(w, w[1:], strict=False):
            p = [word(b, y) for y in (0, 1)]
            own = math.log(p[1] / p[0])
            more = 0.0
            if min(seen[0][a], seen[1][a]) >= tx.MIN_CONTEXT:
                q = [max(pairs[y][a, b] - P, 0) / seen[y][a] + max(1e-3, off[y][a] / seen[y][a]) * p[y] for y in (0, 1)]
                more = max(-tx.PAIR_WEIGHT, min(tx.PAIR_WEIGHT, math.log(q[1] / q[0]) - own))
            out.append(own + more)
        return out

    return evidence


def test_evidence_against_plain_formulas(spark, monkeypatch):
    monkeypatch.setattr(tx, "MIN_CONTEXT", 8)
    monkeypatch.setattr(tx, "STEM_DISCOUNT", 3)
    rows = [(t, y) for _, t, y in labelled_rows(200)] + [("vile viler vilest vilely vileness vilenesses vilenessy vilenessly vilenessish nastiest awfully", 1)] * 3 + [("reliable relic", 0)]
    learned = tx.learn(spark.createDataFrame(rows, "text string, toxic int").repartition(3), F.lit(1))
    want, model = plain_model(rows), learned.model()
    for text in [t for t, _ in rows[::9]] + ["vilenesses unknown x viles nastier relia to be", "vile", ""]:
        assert np.allclose(model.evidence(text), want(text), rtol=1e-4, atol=1e-4), text
    assert {tx.PAIR, tx.CONTEXT, tx.UNIT, *tx.STEMS} == set(learned.entries_by_kind())


def test_whole_scores_by_broadcast_and_by_join(spark, monkeypatch):
    """Scores of every row from plain evidence, windows and the curve; a table too large to broadcast gives the same."""
    rows = [(i, t, y) for i, t, y in labelled_rows(250)] + [(None, None, None), (7, "", None), (7, "vilely " * 300, None)]
    df = spark.createDataFrame(rows, "doc_id int, text string, toxic int").repartition(3)
    learned = tx.learn(df, F.coalesce(F.col("doc_id") % 4, F.lit(1)))
    evidence = plain_model([(t, y) for _, t, y in rows if y is not None])

    def slow(text):
        e = evidence(text)
        best = [max(np.mean(e[i : i + w]) for i in range(len(e) - w + 1)) if len(e) > w else np.mean(e) for w in tx.WINDOWS] if e else []
        x = [1.0, *([np.mean(e), *best, math.log(len(e))] if e else [0.0] * (len(tx.WINDOWS) + 2))]
        return 1 / (1 + math.exp(-min(30, max(-30, float(np.dot(x, learned.curve))))))

    want = sorted((str(i), slow(t)) for i, t, _ in rows)
    for most in (tx.MODEL_ROWS, 0):
        monkeypatch.setattr(tx, "MODEL_ROWS", most)
        learned.small = learned.entries.count() <= most
        got = sorted((str(r.doc_id), r.score) for r in tx.score(df, learned).collect())
        assert [i for i, _ in got] == [i for i, _ in want] and np.allclose([x for _, x in got], [x for _, x in want], atol=1e-3)


def test_empty_and_null_texts(spark, model):
    df = spark.createDataFrame([(1, None), (2, ""), (2, ""), (None, "vile " * 4000)], "doc_id int, text string")
    got = tx.score(df, model).collect()
    assert len(got) == 4 and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (1, 2)}) == 1


def test_without_labels(docs, empty):
    model = tx.learn(empty.select("text", F.lit(1).alias("toxic")), F.lit(1))
    assert {r.score for r in tx.score(docs, model).collect()} == {0.0}
    assert tx.score(empty, model).count() == 0


def test_all_labelled_rows_are_counted(spark, monkeypatch):
    """A word that only rows of the curve hold has evidence; a model of the other rows alone knows nothing of it."""
    rows = labelled_rows()[:300]
    monkeypatch.setattr(tx, "STEM_DISCOUNT", 3)
    df = spark.createDataFrame([(i, t + ("".join(f" dreadful{c}" for c in "abcdefgh") if y and i % 4 == 0 else ""), y) for i, t, y in rows], "doc_id int, text string, toxic int")
    model = tx.learn(df, F.col("doc_id") % 4)
    own = {r.key: r.value for r in model.entries.where(F.col("kind") == 6).collect()}
    assert own[tx.number("6:dreadf")] > 0 and model.model().evidence("dreadful")[0] > 0


def test_curve_if_its_part_lacks_a_class(spark):
    df = spark.createDataFrame(labelled_rows()[:600], "doc_id int, text string, toxic int")
    for part in (1 - F.col("toxic"), F.col("toxic"), F.lit(1)):
        assert tx.learn(df, part).curve is not None


def test_large_tables_shuffle_no_texts(spark, tmp_path, monkeypatch):
    """Labels and evidence beyond what is broadcast: the same scores, and neither texts nor their keys in an exchange or a stored step."""
    rows = [(i, t, y) for i, t, y in labelled_rows(250)] + [(None, "vile", 1), (7, "", 1), (7, "vilely " * 300, 0), (500, "unlabelled vile", None)]
    spark.createDataFrame([r[:2] for r in rows], "doc_id int, text string").repartition(3).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if y is not None] + [(9, 1), (9, 1), (9, 0), (11, None)], "doc_id int, toxic int")
    part = F.coalesce(F.col("doc_id") % 4, F.lit(1))
    held = lambda df: sorted((r.doc_id, r.text, str(r.toxic)) for r in df.collect())
    want = held(tx.with_labels(docs, labels))
    few = tx.learn(tx.with_labels(docs, labels), part)
    want_scores = sorted((str(r.doc_id), r.score) for r in tx.score(docs, few).collect())

    for name, most in (("BROADCAST_LABELS", 0), ("MODEL_ROWS", 0), ("SLICE_ROWS", 40), ("BATCH_BYTES", 9000)):
        monkeypatch.setattr(tx, name, most)
    labelled = tx.with_labels(docs, labels)
    assert held(labelled) == want
    assert "Exchange hash" not in (plan := labelled._jdf.queryExecution().executedPlan().toString()) and "SortMergeJoin" not in plan
    learned = tx.learn(labelled, part)
    names = []
    real = tx.common.stored
    monkeypatch.setattr(tx.common, "stored", lambda df, name: names.append((name, df.columns)) or real(df, name))
    scored = tx.score(docs, learned)
    assert not learned.small and len({path for *_, path in learned.files()}) > 3
    assert "Exchange" not in scored._jdf.queryExecution().executedPlan().toString()
    assert names == [("sorted-evidence", ["kind", "key", "value"])]
    got = sorted((str(r.doc_id), r.score) for r in scored.collect())
    assert [i for i, _ in got] == [i for i, _ in want_scores] and np.allclose([x for _, x in got], [x for _, x in want_scores], atol=1e-9)


def test_files_that_workers_cannot_open(spark, monkeypatch):
    """There the table is joined to the keys of each text, with the same scores."""
    df = spark.createDataFrame(labelled_rows(200), "doc_id int, text string, toxic int").repartition(3)
    learned = tx.learn(df, F.col("doc_id") % 4)
    want = sorted((r.doc_id, r.score) for r in tx.score(df, learned).collect())
    assert tx.readable(df, [(0, 0, 0, df.sparkSession.conf.get("spark.sql.warehouse.dir"))]) is False
    monkeypatch.setattr(tx, "readable", lambda df, parts: False)
    learned.small = False
    scored = tx.score(df, learned)
    assert "Join" in scored._jdf.queryExecution().executedPlan().toString()
    got = sorted((r.doc_id, r.score) for r in scored.collect())
    assert [i for i, _ in got] == [i for i, _ in want] and np.allclose([x for _, x in got], [x for _, x in want], atol=1e-9)
