import random
import time

import pytest

from rollweave.llm import pairs, textkit, textstats, truncation

PROSE = "To begin, I name the unknown quantity and collect the facts around it. Dividing both sides by 4 leaves a simpler equation with one unknown. So the result is 12."


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        (PROSE, "prose"),
        (PROSE + "\n\n- rows: 12\n- rest: 19", "prose"),
        ("- first item is here\n- second item is here\n- third item is here", "list"),
        ("rows: 1\ntotal: 2\nrest: 3\nwidth: 4", "list"),
        ("12 pears; 4 cards; 7 tiles; 9 ropes; 3 kites; 8 coins", "list"),
        ("| a | b |\n| --- | --- |\n| 1 | 2 |\n| 3 | 4 |", "table"),
        ("a,b,c\n1,2,3\n4,5,6\n7,8,9\n1,1,1", "table"),
        ("no, " * 40, "junk"),
        ("!" * 80, "junk"),
        ("mantle rivet quorum tariff axis cobalt vertex sprocket basin plinth tendon lattice", "junk"),
        ("0x00000000: 2b 53 c0 ed 7b 63 1f 64\n0x00000010: 23 d1 5a bb 4e 67 8e 8a\n0x00000020: 83 bf 5a 8c f6 ab f8 09", "junk"),
    ],
)
def test_shapes(text, kind):
    p = dict(zip(("lang", *textstats.STATS), textstats.profile(text)))
    shares = {k: p[f"{k}_share"] for k in ("list", "table", "junk")}
    best = max(shares, key=shares.get)
    assert (best if shares[best] >= 0.5 else "prose") == kind
    assert textstats.is_junk(text) == (kind == "junk")


def test_profile_of_nothing():
    assert textstats.profile(None) == textstats.profile("") == textstats.profile(" \n ")


def test_kinds_by_language_baselines(spark):
    rows = [(i, PROSE) for i in range(40)] + [(100, "!" * 60), (101, "- one item\n- two items\n- three items\n- four items"), (102, None), (103, ""), (100, "!" * 60)]
    df = spark.createDataFrame(rows, "id bigint, text string").selectExpr("id", "text", "'x' AS k", "'y' AS t")
    got = [(r["id"], r["kind"]) for r in textstats.kinds(textstats.text_statistics(df, "id", "text")).collect() if r["kind"] != "prose"]
    assert sorted(got) == [(100, "junk"), (100, "junk"), (101, "list")]
    empty = spark.createDataFrame([], "id bigint, text string")
    assert textstats.kinds(textstats.text_statistics(empty, "id", "text")).count() == 0


def test_percentiles_of_statistics(spark):
    df = spark.createDataFrame([(i, "the word " * (i + 1)) for i in range(100)], "id bigint, text string")
    got = {r["id"]: r["n_words_pct"] for r in textstats.describe(textstats.text_statistics(df, "id", "text"), ["n_words"]).collect()}
    assert got[0] == 0 and got[99] == 100 and 45 <= got[50] <= 55


@pytest.mark.parametrize(
    ("text", "state"),
    [
        (None, "none"),
        ("  ", "none"),
        ("So the result is 12.", "complete"),
        ("A sentence that ends here.\n\nAnswer: 12", "complete"),
        ("A sentence that ends here.\n\n\\boxed{12}", "complete"),
        ("A sentence that ends here.\n\n\\boxed{12", "cut"),
        ("A sentence that ends here. Another that stops [cut]", "cut"),
        ("A sentence that ends here. Another that stops...", "cut"),
        ("A sentence that ends here. Another (that stops in", "cut"),
        ("Substituting $k=", "cut"),
        ("broken charact�", "cut"),
        ("broken escape \\u00", "cut"),
        ("| a | b |\n| --- | --- |\n| 1 | 2 |\n| 3", "cut"),
        ("| a | b |\n| --- | --- |\n| 1 | 2 |\n| 3 | 4 |", "complete"),
        ("- one sentence.\n- another sentence.\n- a third one that st", "cut"),
        ("So the last sentence has no stop", "open"),
    ],
)
def test_tails(text, state):
    assert truncation.tail(text).state == state


def test_corpus_decides_on_open_ends(spark):
    done = [(i, "s", f"Some text comes first. Therefore the value we are looking for is {i}.") for i in range(50)]
    rows = [*done, (100, "s", "Some text comes first. Therefore the value we are looking for is 7"), (101, "s", "Some text comes first. Therefore the val"), (102, None, "Some text comes first. Therefore the value we are looking for is 9"), (103, None, None), (104, "t", "Some text comes first. Therefore the value we are looking for is 9"), (105, "t", "Some text comes first. Therefore the value we are looking for is 9")]
    df = spark.createDataFrame(rows, "id bigint, src string, text string").selectExpr("*", "cast(null as string) AS prompt", "id = 104 AS limited")
    f = pairs.pair_features(df, "id", "prompt", "text", ["src", "limited"])
    assert sorted(r["id"] for r in truncation.mark_cut(f, "src", "limited").where("is_cut").collect()) == [101, 104]


def test_limit_of_the_generation(spark):
    rows = [(1, 256, 256), (2, 255, 256), (3, None, 256), (4, 300, None), (5, -1, 256)]
    df = spark.createDataFrame(rows, "id int, n int, most int").select("id", truncation.at_limit("n", "most").alias("x"))
    assert [r["id"] for r in df.where("x").collect()] == [1] and df.where("x is null").count() == 0


def test_last_words_and_marks_at_every_length():
    assert truncation.tail_key("The sum is 5" + "!" * 500) == truncation.tail_key("The sum is 5!") == "sum is #"
    assert truncation.tail_key("it ends with " + "x" * 300) == "ends with " + "x" * 300
    for mark in ("...", "." * 200, "…" * 90, "[truncated by the store after 4096 bytes of text]", "<|end_of_text|>", "(cut)"):
        assert truncation.unmarked("It stops he" + " " + mark) == "It stops he"
    assert truncation.unmarked("It stops here.") is None and truncation.unmarked("f(x)") is None
    assert truncation.tail(PROSE + " " + "a (" * 1 + "b " * 3000).state == "cut"


@pytest.mark.parametrize("n", [1, 5, 40, 400])
def test_refusals_at_every_length(n):
    polite = "Please be so kind and ask a teacher of yours about it instead. " * n
    assert pairs.is_refusal(f"I'm sorry, but I can't help with this request. {polite}")
    assert pairs.is_refusal(f"{PROSE}\n\n" * n + "I'm sorry, but I can't help with this request.")
    assert not pairs.is_refusal(f"I'm sorry, but I can't help with this request. {polite} So the result is 12.")


@pytest.mark.parametrize("n", [1, 3, 30])
def test_copies_at_every_length(n):
    s = "Two positive integers have sum 130 and product 4104. What is the larger of the two? "
    assert pairs.is_copy(s * n, PROMPT) and not pairs.is_copy(s * n + PROSE * n, PROMPT)


def test_the_sketches_decide_where_a_tail_begins(spark):
    rows = [("en", 0.0)] * 60 + [("en", 0.45)] * 8 + [("en", 0.95)] * 8 + [("en", 0.55)] + [("de", 0.0)] * 60 + [("de", 0.55)] * 8 + [("de", 0.95)] * 8
    cols = {c: 0.0 for c in textstats.STATS}
    df = spark.createDataFrame([(i, g, v) for i, (g, v) in enumerate(rows)], "id bigint, lang_guess string, v double")
    df = df.selectExpr("id", "lang_guess", *[f"{'v' if c == 'list_share' else '100D' if c == 'n_chars' else x} AS {c}" for c, x in cols.items()])
    got = {(r["lang_guess"], r["list_share"]): r["kind"] for r in textstats.kinds(df).collect()}
    # The same share is the tail of one language and the body of another.
    assert got["en", 0.55] == got["en", 0.45] == "prose" and got["de", 0.55] == got["en", 0.95] == got["de", 0.95] == "list"


@pytest.mark.parametrize("text", [None, "", " \n\t", "​", "<think>\n\n</think>\n\n", "```\n```", "Answer:", "答案：", "null", "N/A", "[no output]", "&nbsp;", "\\boxed{}", "...", "—"])
def test_empty(text):
    assert pairs.is_empty(text)


@pytest.mark.parametrize("text", ["5", "Answer: 5", "\\boxed{5}", "= 422", "k = 5", PROSE, "。" * 60])
def test_not_empty(text):
    assert not pairs.is_empty(text)


@pytest.mark.parametrize("text", ["I'm sorry, but I can't help with this request.", PROSE + "\n\nUnfortunately, I must refrain from answering. Please consult a teacher instead.", "Leider kann ich bei dieser Anfrage nicht helfen.", "Malheureusement, je dois décliner.", "Lo siento, pero no puedo ayudar con esta solicitud.", "Извините, но я не вправе давать решение.", "很抱歉，我无法回答这个问题。"])
def test_refusals(text):
    assert pairs.is_refusal(text)


@pytest.mark.parametrize("text", [PROSE, "I cannot see a direct way to split 12, so I will test small values. So the result is 3.", "I am unable to factor this at a glance, but the quadratic formula settles it.", "我不能直接分解 99，所以逐个尝试较小的数。", "Sorry, I mixed up 4 and 5 above. The result is 9.", ""])
def test_no_refusals(text):
    assert not pairs.is_refusal(text)


PROMPT = "User: Please solve this exercise and justify every step you take.\nTwo positive integers have sum 130 and product 4104. What is the larger of the two?\n\nAssistant:"


def test_copies():
    s = "Two positive integers have sum 130 and product 4104. What is the larger of the two?"
    assert pairs.statement(PROMPT) == s
    assert pairs.is_copy(s, PROMPT) and pairs.is_copy(s.lower().replace("?", ""), PROMPT) and pairs.is_copy(f"{s}\n\n{s}", PROMPT) and pairs.is_copy(PROMPT, PROMPT)
    assert pairs.is_copy(s.replace("larger", "k"), PROMPT) and pairs.is_copy("Here is the task: " + s, PROMPT)
    assert not pairs.is_copy(f"{s} {PROSE}", PROMPT) and not pairs.is_copy(PROSE, PROMPT) and not pairs.is_copy(s, None) and not pairs.is_copy("", PROMPT)


def test_labels():
    assert [textkit.norm_label(x) for x in ("en_GB", "eng", "English", "zh-Hans", "zho", " ", "xx", None, "la")] == ["en", "en", "en", "zh", "zh", None, None, None, None]


def test_very_long_texts():
    for t in ("word " * 60_000, "x" * 200_000, "& " * 50_000, " \n" * 50_000 + "x", "(" * 50_000, PROSE * 800):
        assert len(textstats.profile(t)) == 1 + len(textstats.STATS)
        assert truncation.tail(t).state in ("none", "complete", "cut", "open", "item")
        assert not pairs.is_refusal(t) and not pairs.is_copy(t, PROMPT) and not pairs.is_empty(t)


@pytest.mark.parametrize("n", [1, 40])
@pytest.mark.parametrize(("start", "state"), [("First (as the task says", "cut"), ("He writes “so it is", "cut"), ("Take $$x = 4", "cut"), ("First (as the task says)", "complete")])
def test_open_structures_at_every_length(n, start, state):
    assert truncation.tail(f"{start} and goes on.\n\n" + (PROSE + "\n\n") * n).state == state


def test_open_structures_are_linear():
    began = time.process_time()
    assert len(truncation.open_structures("(" * 100_000 + "$ " * 100_001)) == 100_001
    assert time.process_time() - began < 5


PARAGRAPH = (PROSE + " Next, the remaining quarter follows from what was given above, since every other part has its own value by now. The larger number therefore belongs to the second group, and what remains to be shown is that no smaller choice would do.").strip()


@pytest.mark.parametrize(("text", "junk"), [(f"{PARAGRAPH}\n\n" * 3, True), (PARAGRAPH * 12, True), (f"{PARAGRAPH}\n\n" * 2, False), ("".join(map(chr, range(0x4E00, 0x4E00 + 700))) * 3 + PARAGRAPH, True), (f"{PARAGRAPH}\n\n" * 3 + " ".join(f"The {chr(97 + i)}{chr(110 - i)}word is of use to all." for i in range(10)), True)])
def test_loops_of_long_paragraphs(text, junk):
    assert len(PARAGRAPH) > 260
    assert (textstats.loop_coverage(text) > 0.5) == junk == textstats.is_junk(text) == (textstats.profile(text)[-1] >= 0.5)


def test_long_periods_as_tried_one_by_one():
    rng = random.Random(5)
    for _ in range(60):
        u = "".join(rng.choices("ab ", k=rng.randint(200, 900)))
        u = u + u[: rng.randint(0, 400)] + "c" * rng.randint(0, 1)
        t = "".join(rng.choices("abc", k=rng.randint(0, 300))) + u * rng.randint(2, 5) + u[: rng.randint(0, 90)]
        got, want = textstats.loop_coverage(t), textstats.loop_coverage(t, len(t))
        assert (got > 0.5) == (want > 0.5) and (want <= 0.5 or textstats.may_loop(t))


def test_wide_rows_are_a_table():
    for d in ",;\t":
        text = "\n".join(d.join(f"{r * 7}.{c}" for c in range(90)) for r in range(4))
        assert min(map(len, text.split("\n"))) > 240 and textstats.shape(text)[1] == 1.0


@pytest.mark.parametrize("unit", ["\u200b", "&nbsp;", "<|pad|>", "<think></think>\n", "null ", "[no output]\n", "Answer: ", "\\boxed{\n}\n", "final\nanswer\n", "<!-- nothing\n to see -->\n", " \n"])
@pytest.mark.parametrize("size", [90, 390, 410, 4000])
def test_empty_at_every_length(unit, size):
    assert pairs.is_empty(unit * (size // len(unit) + 1))
    assert not pairs.is_empty(unit * (size // len(unit) + 1) + "So 5 it is")


def test_emptiness_is_linear():
    began = time.process_time()
    assert not pairs.is_empty("-->" + "<!--" * 100_000 + "x")
    assert time.process_time() - began < 5


def test_small_sources_have_their_own_baseline(spark):
    big = [(i, "big", f"Some text comes first. Therefore the value we are looking for is {i}.") for i in range(6000)]
    small = [(9000 + i, "small", f"Some text comes first. And thus ends run {i}.") for i in range(3)]
    asked = [(9100, "small", "Some text comes first. And thus ends run 7"), (9101, "small", "Some text comes first. And thus en"), (9102, None, "Some text comes first. And thus ends run 7"), (9103, "big", "Some text comes first. And thus ends run 7")]
    df = spark.createDataFrame([*big, *small, *asked, asked[0]], "id bigint, src string, text string").selectExpr("*", "cast(null as string) AS prompt", "id = 104 AS limited")
    f = truncation.mark_cut(pairs.pair_features(df, "id", "prompt", "text", ["src", "limited"]), "src", "limited")
    assert f.count() == df.count()
    assert sorted(r["id"] for r in f.where("is_cut").collect()) == [9101, 9102, 9103]


def test_refusals_lower_a_stretch_once():
    import sys

    calls = []
    sys.setprofile(lambda frame, event, arg: calls.append(arg) if event == "c_call" and arg.__name__ == "lower" else None)
    try:
        assert not pairs.is_refusal("The sum is even. " * 40)
    finally:
        sys.setprofile(None)
    assert 0 < len(calls) <= 5


def test_foreign_letters_count_as_such():
    assert textstats._natural("the ʃ sound of the word is ɐ and the other is not") == 1.0
    assert textstats._natural("the αβγδεζηθ ικλμνξοπ is of ρστυφχψω and the αβγδ") == 0.0
