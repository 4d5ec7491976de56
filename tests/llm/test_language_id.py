import numpy as np
import pytest

from pyspark.sql import functions as F

from wrackline.llm import language_id as li

TEXTS = {
    "en": "the quick brown fox jumps over the lazy dog and then they went to the house with the others",
    "fr": "le renard brun saute par dessus le chien paresseux et puis ils sont allés à la maison avec les autres",
    "ru": "быстрая коричневая лиса прыгает через ленивую собаку и потом они пошли домой вместе с другими",
}


@pytest.fixture(scope="module")
def model(spark):
    rows = [(lang, text) for lang, text in TEXTS.items() for _ in range(3)] + [(None, "zzz"), ("en", None)]
    return li.learn(spark.createDataFrame(rows, "lang string, text string"))


def slow_labels(model, words):
    """Viterbi a word at a time."""
    score = model.word_scores(words)
    best, back = score[0], []
    for s in score[1:]:
        lead = int(best.argmax())
        back.append([k if best[k] >= best[lead] - np.float32(li.SWITCH) else lead for k in range(len(best))])
        best = s + np.array([max(b, best[lead] - np.float32(li.SWITCH)) for b in best], np.float32)
    at = [int(best.argmax())]
    for b in reversed(back):
        at.append(b[at[-1]])
    return at[::-1]


def test_viterbi_in_step_is_viterbi(model):
    texts = ["", None, "12 34", TEXTS["en"], TEXTS["fr"] + " " + TEXTS["ru"], "fox " * 50 + TEXTS["fr"], "zzz", "中文 fox"]
    labels, letters = model.label(texts)
    for text, label, n in zip(texts, labels, letters, strict=True):
        words = li.words_of(text)
        assert len(label) == len(words) == len(n)
        if words:
            assert label.tolist() == slow_labels(model, words)


def test_scripts_narrow(model):
    ru = model.langs.index("ru")
    assert model.candidate[li.scripts_of(["дом"])[0]].tolist() == [k == ru for k in range(3)]
    assert li.scripts_of(["a", "é", "я", "中", "한", "あ", "ع"]).tolist() == [li._NAMES.index(n) for n in ("Latin", "Latin", "Cyrillic", "Han", "Hangul", "Kana", "Arabic")]


def test_spans_and_und(spark, model):
    rows = [(1, TEXTS["en"] + " " + TEXTS["ru"]), (2, None), (3, "123 !"), (4, TEXTS["fr"]), (4, TEXTS["fr"])]
    got = li.identify(spark.createDataFrame(rows, "doc_id int, text string"), model).collect()
    by = {r.row.doc_id: r for r in got}
    assert len(got) == 5 and by[4].lang_pred == "fr" and by[4].score == 1.0
    assert [s.lang for s in by[1].spans] == ["en", "ru"] and by[1].spans[0].end_word == len(TEXTS["en"].split())
    assert (by[2].lang_pred, by[2].score, by[3].lang_pred) == ("und", 0.0, "und")


def test_without_labels_all_is_und(spark, docs, empty):
    none = li.learn(docs.where("false"))
    assert {r.lang_pred for r in li.identify(docs.select("doc_id", "text"), none).collect()} == {"und"}
    assert li.identify(empty.select("doc_id", "text"), none).count() == 0


def test_numerals_are_no_letters(spark, model):
    rows = [(1, "½ ² 12"), (2, "½ fox")]
    got = {r.row.doc_id: r.lang_pred for r in li.identify(spark.createDataFrame(rows, "doc_id int, text string"), model).collect()}
    assert got == {1: "und", 2: "en"}


def test_mixed_and_unlabelled_texts_stay(spark):
    """An even text in three languages is identified span by span and stays; so do texts with letters where nothing is labelled."""
    rows = [(i, t, k) for i, (k, t) in enumerate(TEXTS.items())] + [(90, " ".join(TEXTS.values()), None), (91, "12 ½", None), (None, None, None)]
    df = spark.createDataFrame(rows, "doc_id int, text string, lang string")
    assert {r.doc_id for r in li.keep_identified(df).collect()} == {r[0] for r in rows if r[0] is not None} - {91}
    bare = df.withColumn("lang", F.lit(None).cast("string"))
    assert li.keep_identified(bare).count() == len(TEXTS) + 1


def test_keep_identified(docs):
    kept = li.keep_identified(docs)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert not ids & {6, 7, 8} and {1, 9, 12, 15} <= ids


def test_held_out_accuracy(spark, sf_dir):
    got = li.op4_language_id(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang_pred == r.lang for r in got]) > 0.95
