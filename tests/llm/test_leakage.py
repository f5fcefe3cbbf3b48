import re
import unicodedata

import numpy as np
import pytest

from rollweave.llm import leakage

ITEM = "Behind a tarnished tannery, 28 silent pouches hold 165 walnut shells plus 360 curved clay tokens. After 37 rounds, Oduya trades three sevenths of the curved silver thimbles and 738 painted glass prisms. Find the least number of curved hampers the surveyor needs."
ALIKE = ITEM.replace("28", "31").replace("165", "99").replace("360", "12").replace("37", "40").replace("738", "11").replace("Oduya", "Velka").replace("tarnished", "pale").replace("walnut", "oak").replace("silver", "iron").replace("curved", "mossy").replace("glass", "tin").replace("surveyor", "potter")
SHARED = "Assume that all choices are equally likely and independent of each other unless the statement says something different."
ZH = "铜制灯塔后面放着23只藤篮，里面有136件绳圈和21件镀金蜡封。与此同时养蜂人南枝每航程掩埋199件绳圈，第20个航程除外。每个旬都有335件陶符离开苍白的灯塔。"
COUNT = "On Monday Petra put 14 pears into 3 baskets and gave 14 pears to Anton, who ate 5 pears and sold the rest for 9 coins each. How many coins did Anton get in the end?"
ITEMS = [(1, ITEM), (2, ZH), (3, f"First of all the others here is a text about nothing. {SHARED}"), (4, f"The second one tells about another thing. {SHARED}"), (5, f"A third one is different in all respects. {SHARED}"), (7, COUNT)]
FILLER = "We keep the raw text beside the features, since thresholds will change later. "
SWAP = {"14": "26", "3": "4", "5": "8", "9": "2", "Petra": "Vera", "Anton": "Boris", "pears": "plums", "Monday": "Sunday"}


def swapped(text, to):
    return re.sub(r"\w+", lambda m: to.get(m[0], m[0]), text)


CASES = {
    FILLER + ITEM + FILLER: [1],
    FILLER + ITEM.upper().replace(" ", "  ").replace(".", " . ") + FILLER: [1],
    FILLER + ITEM.replace(" tannery", " tan-\nnery").replace("pouches", "**pouches**") + FILLER: [1],
    FILLER + ITEM.replace("silent", "loud").replace("clay", "mud") + FILLER: [1],
    FILLER + " ".join(ITEM.split()[5:27]) + " " + FILLER: [1],
    FILLER + unicodedata.normalize("NFD", ZH) + FILLER: [2],
    "\n".join(ZH[i : i + 12] for i in range(0, len(ZH), 12)): [2],
    "word " * 30_000 + ITEM: [1],
    "a b c": [],
    ALIKE: [],
    " ".join(ITEM.split()[3:16]): [],
    f"Something else. {SHARED}": [],
    ZH[:30]: [],
    FILLER + swapped(COUNT, SWAP): [],
}


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([*ITEMS, (6, None), (1, ITEM)], "item_id bigint, text string")


def leaks(spark, items, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").selectExpr("*", "1 AS k", "2 AS t", "3 AS item_id", "4 AS u", "5 AS r").repartition(3)
    out = {i: [] for i in range(len(texts))}
    for r in leakage.find_leaks(docs, items, "doc_id", "text", "item_id", "text").collect():
        out[r["doc_id"]].append((r["item_id"], r["leak"]))
    return out


def test_leaks_in_every_form_and_none_else(spark, items):
    got = leaks(spark, items, [*CASES, None, "", ITEM])
    for i, (text, ids) in enumerate(CASES.items()):
        assert sorted(k for k, leak in got[i] if leak == "verbatim") == ids, text[:80]
    assert got[len(CASES)] == got[len(CASES) + 1] == [] and got[len(CASES) + 2] == [(1, "verbatim")]


def test_placeholders_find_reparameterised_problems_with_consistent_slots(spark, items, monkeypatch):
    same = swapped(COUNT, SWAP)
    # 14 pears twice: now two numbers for one slot value.
    other = same.replace("26 plums to", "27 plums to")
    got = leaks(spark, items, [same, other, COUNT])
    assert got == {0: [(7, "reparameterised")], 1: [], 2: [(7, "verbatim")]}
    x = leakage.words_of([COUNT])
    assert leakage.consistent(x, leakage.words_of([same]), [(i, i) for i in range(len(x.of))])
    assert not leakage.consistent(x, leakage.words_of([other]), [(i, i) for i in range(len(x.of))])
    # Without placeholders no window of the re-parameterised problem agrees.
    monkeypatch.setattr(leakage.Words, "typed", property(lambda s: s.exact), raising=False)
    assert len(leakage.windows(leakage.words_of([same]))[0]) and not leakage.windows(leakage.words_of([same]))[2].any()


def test_words_do_not_depend_on_the_batch():
    texts = [*CASES, "", "Straße STRASSE", "a\n-b", "x-\ny", "١٢ 3,5 №7"]
    whole = leakage.words_of(texts)
    for i, t in enumerate(texts):
        one = leakage.words_of([t])
        a, b = np.searchsorted(whole.of, [i, i + 1])
        for f in ("kind", "size", "exact", "numbers", "typed"):
            assert (getattr(whole, f)[a:b] == getattr(one, f)).all()
    x = leakage.words_of(["Straße STRASSE x-\ny xy"])
    assert x.exact[0] == x.exact[1] and x.exact[2] == x.exact[3]


def test_many_items_stay_within_the_bitmap(spark, monkeypatch):
    monkeypatch.setattr(leakage, "MOST_BITS", 1 << 16)
    many = spark.range(3000).selectExpr("id + 100 AS item_id", "concat_ws(' ', transform(sequence(1, 40), x -> substr(sha2(concat(id, '-', x), 256), 1, 6))) AS text")
    docs = many.where("item_id % 50 = 0").selectExpr("item_id AS doc_id", "text")
    got = leakage.find_leaks(docs, many, "doc_id", "text", "item_id", "text").collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == sorted((r["doc_id"], r["doc_id"]) for r in docs.collect())


def test_empty_tables(spark, items):
    docs = spark.createDataFrame([(1, ITEM)], "doc_id bigint, text string")
    assert leakage.find_leaks(docs, items.limit(0), "doc_id", "text", "item_id", "text").count() == 0
    assert leakage.find_leaks(docs.limit(0), items, "doc_id", "text", "item_id", "text").count() == 0
