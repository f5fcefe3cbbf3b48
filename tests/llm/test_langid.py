from collections import Counter

import numpy as np
import pytest

from rollweave.llm import langid, pairs
from rollweave.llm import textkit as tk

TEXTS = {
    "en": "The sides of a rectangle are long and the perimeter grows when both sides grow. There is a shorter way but this one is safe for all of the cases. I can help with that request, so you can ask for this.",
    "zh": "因此所求的值是这个数，两个正整数的和为一百，积为二十，求其中较大的一个。我们先设未知数，再把条件写成等式。",
    "de": "Die Seiten eines Rechtecks sind lang und der Umfang wächst, wenn beide Seiten wachsen. Für die übrigen Fälle zählen wir jeweils dazu.",
    "fr": "Les côtés d’un rectangle mesurent beaucoup et le périmètre augmente quand chaque côté augmente. Il reste une équation plus simple pour tous.",
    "es": "Los lados de un rectángulo son largos y el perímetro crece cuando ambos lados crecen. Queda una ecuación más sencilla para todos los casos.",
    "ru": "Стороны прямоугольника равны и периметр растёт, если обе стороны увеличить. Остаётся более простое уравнение для всех случаев.",
}


@pytest.fixture(scope="module")
def model():
    return langid.fit({k: Counter(w for w in tk.lower_words(t) * 20 if len(w) > 1) for k, t in TEXTS.items()}, langid.RESPONSE_LANGS)


def test_forward_sum_equals_brute_force(model):
    s = langid.Scorer(model)

    def brute(b, k):
        if not b:
            return 1.0
        total = 0.0
        for n in range(1, min(len(b), s.longest) + 1):
            r = model.rows.get(b[:n])
            if r is not None or n == 1:
                total += (model.table[r, k] if r is not None else langid.FLOOR) * brute(b[n:], k)
        return total

    for w in ("the", "sides", "равны"):
        got = s.word(w)
        for k in range(len(model.langs)):
            assert got[k] == pytest.approx(np.log(brute((" " + w).encode(), k)), rel=1e-6)


@pytest.mark.parametrize(("w", "k"), [("равны" * 200, 5), ("因此所求的值是" * 150, 1)])
def test_long_words_are_scored_whole(model, w, k):
    v = langid.Scorer(model).word(w)
    assert np.isfinite(v).all() and v.argmax() == k
    # No cut: the score of the whole is no sum over fixed chunks, and grows in proportion.
    assert v[k] == pytest.approx(2 * langid.Scorer(model).word(w[: len(w) // 2])[k], rel=0.02)


def test_expectations_of_long_words(model):
    p = {b"a": 0.5, b"aa": 0.25, b"b": 0.25}
    voc = frozenset(p)
    short = dict.fromkeys(p, 0.0)
    for piece, x in langid._expected(b"aab", p, voc):
        short[piece] += x
    assert short[b"a"] == pytest.approx(2 * 0.25 / 0.5) and short[b"aa"] == pytest.approx(0.5) and short[b"b"] == pytest.approx(1.0)
    assert sum(x * len(piece) for piece, x in langid._expected(b"b" * 3000, {b"b": 1e-3}, frozenset([b"b"]))) == pytest.approx(3000)


def test_languages_mixtures_and_nothing(model):
    s = langid.Scorer(model)
    for lang, t in TEXTS.items():
        d = langid.detect_many([t], s)[0]
        assert (d.lang, d.langs) == (lang, (lang,)) and d.conf > 0.9
    mixed = langid.detect_many([TEXTS["en"] + " " + "Die Seiten eines Rechtecks sind lang und der Umfang wächst."], s)[0]
    assert mixed.langs == ("en", "de") and [x[0] for x in mixed.segments] == ["en", "de"]
    label = langid.detect_many([TEXTS["zh"] + "\n\nAnswer: 5"], s)[0]
    assert label.langs == ("zh",)
    assert [d.lang for d in langid.detect_many([None, "", "5", "Answer: 12", "\\boxed{3}", "!" * 90], s)] == [None] * 6
    assert langid.detect_many([], s) == []


def test_mislabelled(spark, model):
    df = spark.createDataFrame([(1, TEXTS["en"]), (2, TEXTS["de"]), (3, TEXTS["fr"]), (4, None), (5, TEXTS["en"] + " " + TEXTS["de"]), (1, TEXTS["en"])], "line_no bigint, text string").selectExpr("*", "1 AS k", "2 AS lang")
    labels = spark.createDataFrame([(1, "en_GB"), (1, "en_GB"), (2, "unk"), (5, "en"), (4, "en")], "line_no bigint, lang_main string")
    found = langid.mislabelled(langid.detect_languages(df, "line_no", "text", model), labels, "line_no", "lang_main").collect()
    assert sorted((r[0], r[1]) for r in found) == [(2, "de"), (3, "fr"), (5, "de"), (5, "en")]
    empty = spark.createDataFrame([], "line_no bigint, text string")
    assert langid.mislabelled(langid.detect_languages(empty, "line_no", "text", model), labels, "line_no", "lang_main").count() == 0


def test_pair_defects(spark, model):
    prompt = "User: Please solve this exercise and justify every step you take.\nThe sides of a rectangle are 5 and 6 units long. What is its perimeter?\n\nAssistant:"
    rows = [(1, prompt, TEXTS["en"]), (2, prompt, TEXTS["de"]), (3, prompt, None), (4, None, TEXTS["de"]), (5, prompt, "I can't help with this request."), (6, prompt, "The sides of a rectangle are 5 and 6 units long. What is its perimeter?"), (7, prompt, TEXTS["en"] + " The perimeter (which is"), (3, prompt, None)]
    df = spark.createDataFrame(rows, "line_no bigint, p string, r string").selectExpr("*", "'s' AS source", "false AS limited", "1 AS lang")
    f = pairs.pair_features(df, "line_no", "p", "r", ["source", "limited"], model)
    got = sorted((r[0], r[1]) for r in pairs.defects(f, "line_no", "source", "limited").collect())
    assert got == [(2, "other_language"), (3, "empty"), (3, "empty"), (5, "refusal"), (6, "copy"), (7, "truncated")]


def test_training_sample_is_bounded(spark):
    docs = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(list(TEXTS.items()) * 5)] + [(900, None, "en"), (901, "x", None)], "doc_id bigint, text string, lang string")
    m = langid.train(spark, docs, sample_docs=3)
    assert langid.detect_many([TEXTS["fr"]], langid.Scorer(m))[0].lang == "fr"
