import os
import random

import pandas as pd
import pytest

from rollweave.llm import mojibake, textkit

SENT = {
    "en": "It’s the naïve bound: √{n} ≈ 21, and the model’s “final” answer – so far – is ≤ 82. That’s why the second “café” problem needs {n}° instead of 2°… The learning rate was halved at step {n}.",
    "fr": "Après le redémarrage, certaines lignes ont été écrites deux fois et doivent être fusionnées. La récompense moyenne est passée de {n} à 0,88 à l’étape {n}. C’est-à-dire que la réponse est déjà là.",
    "de": "Während der Prüfung müssen die Einträge für die größere Übung geprüft werden. Die Läufe {n} wären früher fertig, also zählen wir jeweils {n} dazu.",
    "ru": "После перезапуска часть строк была записана дважды, и их нужно объединить. На шаге {n} средняя награда выросла до {n}.",
    "zh": "验证集上的准确率在{n}步内提高了二十三个百分点。过长的回答往往反复检查同一个等式，也就是说“最后一行”必须写成{n}。",
}


@pytest.fixture(scope="module")
def repairer():
    return mojibake.Repairer(mojibake.fit({k: [s.format(n=n) + " " + s.format(n=n + 7) for n in range(100, 180)] for k, s in SENT.items()}, usual_share=0.03))


@pytest.mark.parametrize("lang", list(SENT))
@pytest.mark.parametrize("read_as", ["cp1252", "latin-1"])
@pytest.mark.parametrize("times", [1, 2])
def test_round_trip_of_utf8(repairer, lang, read_as, times):
    text = garbled = SENT[lang].format(n=55)
    for _ in range(times):
        b = garbled.encode()
        garbled = "".join(bytes([x]).decode(read_as, "replace") if read_as != "cp1252" or x not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else chr(x) for x in b)
    r = repairer.repair(garbled)
    assert r.found and r.restored == text


@pytest.mark.parametrize(("lang", "really", "read_as"), [("ru", "cp1251", "cp1252"), ("de", "cp1252", "mac_roman"), ("zh", "gb18030", "cp1252"), ("ru", "koi8-r", "cp1251")])
def test_round_trip_of_others(repairer, lang, really, read_as):
    text = SENT[lang].format(n=55)
    garbled = "".join(bytes([x]).decode(read_as) if x not in (0x81, 0x8D, 0x8F, 0x90, 0x9D, 0x98) else chr(x) for x in text.encode(really, "ignore"))
    r = repairer.repair(garbled)
    assert r.found
    if lang != "zh":
        assert r.restored == text


@pytest.mark.parametrize("text", [*[s.format(n=33) for s in SENT.values()], None, "", "plain ascii", "PÂTÉ, CHÂTEAU, ÂGE", "√, ©, ¬, ®", "Ш Ж", "50 % &eacute; \\u00e9 %C3%A9 what?", "Ünïcødé-203 stands here"])
def test_clean_texts_stay(repairer, text):
    assert not repairer.repair(text).found


def test_lost_characters_are_found_but_not_restored(repairer):
    r = repairer.repair(SENT["en"].format(n=5) + " Das St�ck.")
    assert r.found and r.restored is None


def test_frame(spark):
    docs = spark.createDataFrame([(i, SENT[k].format(n=i), k) for i in range(200, 240) for k in SENT] + [(900, None, "en"), (901, "", None)], "doc_id bigint, text string, lang string").selectExpr("*", "1 AS k", "2 AS garbled")
    bad = spark.createDataFrame([(1000, SENT["fr"].format(n=9).encode().decode("latin-1"), None)], "doc_id bigint, text string, lang string").selectExpr("*", "1 AS k", "2 AS garbled")
    model = mojibake.train(spark, docs)
    got = mojibake.repair_texts(docs.unionByName(bad), "doc_id", "text", model).where("garbled").collect()
    assert [(r["doc_id"], r["restored"]) for r in got] == [(1000, SENT["fr"].format(n=9))]
    assert mojibake.repair_texts(docs.limit(0), "doc_id", "text", model).count() == 0


STARTS = "Время идёт. Если слово верно, ответ тоже верен. Здесь не всё просто. Мы так и решали. Но слово дано. Ответ есть. При этом мы правы. Решение верно. Слово верно. Теперь время. У нас время. Что дано? Это слово."


@pytest.fixture(scope="module")
def capitals():
    """A model to which the capitals that swapped Cyrillic gives are usual."""
    return mojibake.Repairer(mojibake.fit({k: [f"{STARTS if k == 'ru' else ''} {s.format(n=n)} {s.format(n=n + 7)}" for n in range(100, 180)] for k, s in SENT.items()}, usual_share=0.03))


@pytest.mark.parametrize("word", ["слово", "время"])
def test_swaps_to_usual_characters_are_found(capitals, word):
    text = f"Здесь {word} верно. " + SENT["ru"].format(n=55)
    garbled = text.replace(word, word.encode("koi8-r").decode("cp1251"))
    assert not any(c > "\x7f" and c not in capitals.m.usual["ru"] for c in garbled)
    assert capitals.repair(garbled) == mojibake.Repair(True, text, "koi8-r read as cp1251") and not capitals.repair(text).found


def test_wholly_swapped_text_is_restored_wholly(capitals):
    text = "Мы так и решали, но не всё просто. " + SENT["ru"].format(n=55)
    assert capitals.repair(text.encode("koi8-r").decode("cp1251")).restored == text


def test_chains_of_any_length(repairer):
    text = garbled = SENT["fr"].format(n=5)
    for read_as in ("latin-1",) * 5:
        garbled = garbled.encode().decode(read_as)
        assert repairer.repair(garbled).restored == text


DOCS = "/root/testdata/sf0.1/documents.parquet"
SWAPS = [("ru", "koi8-r", "cp1251"), ("ru", "cp1251", "koi8-r"), ("ru", "cp1251", "cp866"), ("ru", "cp866", "cp1251"), ("ru", "cp1251", "cp1252"), ("ru", "utf-8", "cp1251"), ("ru", "utf-8", "gb18030"), ("ru", "utf-8", "koi8-r"), ("de", "utf-8", "cp1252"), ("de", "utf-8", "gb18030"), ("de", "cp1252", "mac_roman"), ("es", "utf-8", "gb18030"), ("es", "cp1252", "cp850"), ("fr", "utf-8", "mac_roman"), ("zh", "gb18030", "cp1252")]


@pytest.fixture(scope="module")
def held_out():
    """A model fitted on one half of the labelled documents, and clean texts of the other half."""
    if not os.path.exists(DOCS):
        pytest.skip("no test data")
    d = pd.read_parquet(DOCS, columns=["doc_id", "text", "lang"]).dropna().query("doc_id < 3000")
    fit, rest = {}, {}
    for i, t, lang in zip(d.doc_id, d.text, d.lang.map(textkit.norm_label)):
        if lang and 60 < len(t) < 4000:
            (fit if i % 2 else rest).setdefault(lang, []).append(t)
    seen = {t for ts in fit.values() for t in ts}
    r = mojibake.Repairer(mojibake.fit({k: v[:300] for k, v in fit.items()}))
    return r, {k: [t for t in v if t not in seen and not mojibake.looks_garbled(t) and not r.repair(t).found][:20] for k, v in rest.items()}


@pytest.mark.parametrize(("lang", "really", "read_as"), SWAPS)
@pytest.mark.parametrize("whole", [True, False])
def test_held_out_texts_are_restored_rightly_or_not_at_all(held_out, lang, really, read_as, whole):
    repairer, texts = held_out
    n = found = 0
    for i, t in enumerate(texts[lang]):
        words = [w for w in mojibake.TOKEN_RE.findall(t) if len(w) > 3]
        part = t if whole else random.Random(i).choice(words) if words else ""
        try:
            bad = part.encode(really).decode(read_as)
        except UnicodeError:
            continue
        if bad == part:
            continue
        r = repairer.repair(t.replace(part, bad, 1))
        n, found = n + 1, found + r.found
        assert r.restored in (None, t), [(a, b) for a, b in zip(t.split(), r.restored.split()) if a != b]
    assert found >= 0.9 * n


def test_many_garbled_words_among_good_ones(repairer):
    good = SENT["de"].format(n=5)
    for k in (2, 11, 13, 60):
        bad = good + " " + " ".join(["Übung".encode().decode("cp1252")] * k)
        assert repairer.repair(bad).restored == good + " " + " ".join(["Übung"] * k)


def test_model_counts_every_document_of_any_length(spark):
    long, rare = SENT["de"].format(n=5) + " Füllwörter" * 1000, SENT["de"].format(n=6) + " Sündenböcke"
    docs = spark.createDataFrame([(i, SENT["de"].format(n=i) if i % 100 else long if i % 200 else rare, "deu") for i in range(2000)], "doc_id int, text string, lang string")
    model = mojibake.train(spark, docs.repartition(5))
    assert {"füllwörter", "sündenböcke"} <= model.words and set("üöä") <= model.usual["de"]
    assert mojibake.train(spark, docs, least_share=0.006).words < model.words
    assert mojibake.train(spark, docs.limit(0)).dictionaries == {}


def test_counts_leave_out_what_looks_garbled():
    c = mojibake.Counted()
    for t in ("für uns", "fÃ¼r uns", "f�r uns", "f\x9fr uns", "daß ÀÈÌÒ uns", None, ""):
        c.add("de", t)
    assert dict(c.counts["de"]["w"]) == {"für": 1, "uns": 1} and c.counts["de"]["d"][""] == 1


def test_condensed_pieces_come_from_everywhere():
    pieces = [SENT["de" if i < 1500 else "fr"].format(n=i).encode() for i in range(3000)]
    got = mojibake._condensed(pieces, 8192)
    text = b"".join(got).decode()
    assert sum(map(len, got)) <= 8192 and "Einträge" in text and "réponse" in text and mojibake._condensed(pieces[:3], 8192) == pieces[:3]
