import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from rollweave.functions import bounds as B
from rollweave.functions import managers as M
from rollweave.functions import scoring as C
from rollweave.functions import text as T
from rollweave.functions.arrays import scan
from rollweave.operators import advantages as A
from rollweave.operators import batch as D
from rollweave.operators import joins as J
from rollweave.operators import layout as L
from rollweave.operators import sampling as S
from rollweave.sources import tables as R


def test_scan_equals_a_loop_and_handles_nothing(spark):
    rows = [(None,), ([],), ([1.0],), ([1.0, 2.0, 4.0, 8.0, 16.0],), ([float(i % 7) for i in range(1000)],)]
    df = spark.createDataFrame(rows, "x array<double>")
    got = [r[0] for r in df.select(scan(F.col("x"), F.lit(0.0), lambda s, x: s * 0.5 + x)).collect()]
    for (x,), y in zip(rows, got):
        want, s = [], 0.0
        for v in x or []:
            s = s * 0.5 + v
            want.append(s)
        assert y == pytest.approx(want)
    before = df.select(scan(F.col("x"), F.lit(0.0), lambda s, x: s + x, before=True)).collect()
    assert before[3][0] == [0.0, 1.0, 3.0, 7.0, 15.0] and before[0][0] == []


def test_sequences_of_twenty_thousand_tokens(spark):
    df = spark.range(20_000).selectExpr("1 AS seq", "id AS pos", "double(id % 3) AS r", "0.5D AS v", "1 AS m")
    began = time.time()
    out = A.gae(df, "seq", ["pos"], "r", "v", "m", 1.0, 0.95).orderBy("pos").select("ret").collect()
    run, nv, want = 0.0, 0.0, []
    for i in reversed(range(20_000)):
        run = (i % 3) + nv - 0.5 + 0.95 * run
        nv = 0.5
        want.append(run + 0.5)
    assert np.allclose([r[0] for r in out], want[::-1]) and time.time() - began < 90


def test_a_group_with_a_tenth_of_the_rows_and_null_groups(spark):
    df = spark.range(3000).selectExpr("id", "CASE WHEN id % 10 = 0 THEN 'hot' WHEN id % 10 = 1 THEN null ELSE concat('g', id % 400) END AS uid", "double(id % 13) AS s").repartition(4)
    pdf = df.toPandas()
    pdf["g"] = pdf.uid.fillna("~")
    g = pdf.groupby("g").s
    want = (pdf.s - g.transform("mean")) / (g.transform("std") + A.EPS)
    got = A.grpo(df, "uid", "s").toPandas().set_index("id").adv
    assert len(got) == 3000 and np.allclose(got.loc[pdf.id].to_numpy(), want.to_numpy())


def test_collate_and_back(spark):
    df = spark.createDataFrame([(1, 0, "a", None), (1, 1, None, 2), (2, 0, "c", 3)], "b int, i int, x string, y int")
    c = L.collate(df, "b", ["i"], ["x", "y"])
    assert {r["b"]: (r["x"], r["y"]) for r in c.collect()} == {1: (["a", None], [None, 2]), 2: (["c"], [3])}
    assert sorted((r["b"], r["pos"], r["x"], r["y"]) for r in L.rows_of(c, "b", ["x", "y"]).collect() if r["b"] == 2) == [(2, 0, "c", 3)]
    assert L.collate(df.limit(0), "b", ["i"], ["x"]).count() == 0
    assert L.column_kinds(df) == {"b": "tensor", "i": "tensor", "x": "object", "y": "tensor"}
    with pytest.raises(ValueError):
        L.from_columns(spark, {"a": [1], "b": [1, 2]})


def test_reattach_never_multiplies(spark):
    f = spark.createDataFrame([(1,), (2,), (2,), (3,), (None,)], "k int")
    t = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b"), (None, "n")], "k int, text string")
    assert sorted(((r["k"], r["text"]) for r in L.reattach(f, t, "k", ["text"]).collect()), key=str) == sorted([(1, "a"), (2, "b"), (2, "b"), (3, None), (None, None)], key=str)


def test_reuse_makes_once_and_not_from_half_written(spark, tmp_path):
    calls = []

    def make():
        calls.append(1)
        return spark.range(3)

    path = f"file://{tmp_path}/x"
    assert L.reuse(spark, path, make).count() == L.reuse(spark, path, make).count() == 3 and len(calls) == 1
    (tmp_path / "x" / "_SUCCESS").unlink()
    assert L.reuse(spark, path, make).count() == 3 and len(calls) == 2


def test_dispatch_and_map_rows(spark):
    n = D.with_index(spark.range(10).withColumnRenamed("id", "k"), ["k"])
    assert L.dispatch("dp_compute")(lambda d: d.agg(F.sum("k").alias("s")))(n, 3).agg(F.sum("s")).first()[0] == 45
    assert [d.count() for d in L.dispatch("one_to_all")(lambda d: d)(n, 2)] == [10, 10]
    with pytest.raises(ValueError):
        L.dispatch("all_to_all")(lambda d: d)([n], 2)
    with pytest.raises(ValueError):
        L.dispatch("some")
    assert L.map_rows(spark.range(3), lambda r: [{"x": r["id"]}] * r["id"], "x bigint", flat=True).count() == 3
    assert L.map_rows(spark.range(0), lambda r: r, "id bigint").count() == 0


def test_managers(spark):
    df = spark.createDataFrame([(1, "#### 5", "5", "s", 10), (2, None, "5", "s", None), (3, "slow", "5", "t", 300)], "k int, r string, g string, src string, n int")
    naive = {x["k"]: x["score"] for x in M.score_records(df, "naive", response="r", truth="g", source="src", by={"s": "gsm8k"}).collect()}
    assert naive == {1: 1.0, 2: 0.0, 3: None}

    def scorer(r, g):
        if r == "slow":
            time.sleep(5)
        return float(g in r)

    prime = {x["k"]: x["reward"] for x in M.score_records(df, "prime", cols=["r", "g"], scorer=scorer, seconds=0.3).collect()}
    assert prime == {1: 1.0, 2: 0.0, 3: 0.0}
    batch = {x["k"]: (x["score"], x["reward"]) for x in M.score_records(df, "batch", cols=["r"], scorer=lambda p: p["r"].map(len, na_action="ignore")).collect()}
    assert batch == {1: (6.0, 6.0), 2: (None, 0.0), 3: (4.0, 4.0)}
    dapo = {x["k"]: x["reward"] for x in M.score_records(df, "dapo", scorer=F.lit(1.0), length="n", most=256, buffer=64, factor=0.5).collect()}
    assert dapo[1] == 1.0 and dapo[2] == 1.0 and dapo[3] < 1.0
    with pytest.raises(ValueError):
        M.score_records(df, "none")


# Answers and their normal forms.
@pytest.mark.parametrize(("raw", "form"), [("x = $12$ dollars", "12"), ("1,234", "1234"), ("\\boxed{7}", "7"), ("$\\frac12$", "\\frac{1}{2}"), ("\\text{5 cm}", "5"), ("$90^\\circ$", "90"), ("\\sqrt2", "\\sqrt{2}"), ("10,20", "10,20"), ("5,\\text{and}6", "5,6"), ("12.", "12"), ("", ""), ("{" * 5000, "{" * 5000)])
def test_final_answers(raw, form):
    assert C.final_answer(raw) == form


@pytest.mark.parametrize(("raw", "form"), [("\\frac12", "\\frac{1}{2}"), ("3/4", "\\frac{3}{4}"), ("\\dfrac{3}{4}", "\\frac{3}{4}"), ("0.5", "\\frac{1}{2}"), ("x=5", "5"), ("5\\text{ cm}", "5"), ("50\\%", "50"), ("\\sqrt3", "\\sqrt{3}"), ("\\sqrt[3]{2}", "\\sqrt[3]{2}"), ("\\left(1, 2\\right)", "(1,2)"), ("90^{\\circ}", "90"), ("", ""), ("{" * 3000 + "}" * 3000, "{" * 3000 + "}" * 3000)])
def test_latex_forms(raw, form):
    assert C.latex_normal(raw) == form


def test_greedy_parts():
    for equal in (False, True):
        parts = S.greedy([5, 1, 4, 2, 3, 6, 9], 3, equal)
        assert sorted(i for p in parts for i in p) == list(range(7))
        if equal:
            assert max(map(len, parts)) - min(map(len, parts)) <= 1
    assert S.greedy([], 2) == [[], []]
    parts = S.karmarkar_karp([3, 1, 2, 8, 5], 2, True)
    assert sorted(i for p in parts for i in p) == [0, 1, 2, 3, 4] and abs(len(parts[0]) - len(parts[1])) == 1


def test_positional_join_and_large_samples(spark, monkeypatch):
    a = spark.createDataFrame([(3, "c"), (1, "a"), (2, "b")], "k int, x string")
    b = spark.createDataFrame([(9,), (7,)], "y int")
    assert sorted((r["x"], r["y"]) for r in J.positional(a, ["k"], b, ["y"]).collect()) == [("a", 7), ("b", 9)]
    small = {r[0] for r in S.reservoir(spark.range(500), "id", 40).collect()}
    monkeypatch.setattr(S, "HEAP_ROWS", 10)
    assert {r[0] for r in S.reservoir(spark.range(500), "id", 40).collect()} == small


def test_newton_equals_bisection():
    p = np.array([1e-6, 0.01, 0.3, 0.5, 0.9, 0.999999])
    for delta in (1e-4, 0.05, 1.0):
        for x, y in zip(B.bisect(p, delta, B.f_kl, 80), B.newton(p, delta)):
            assert np.allclose(x, y, rtol=1e-6, atol=1e-9)


def test_alignment_ids_languages_and_maps(spark):
    df = spark.createDataFrame([("One  two.\nThree four!\" Five", ["One two.", "Three four!", "not there", "Five"]), (None, ["x"]), ("abc", None), ("", [])], "t string, s array<string>")
    got = [r[0] for r in df.select(T.aligned("t", "s")).collect()]
    text = "One  two.\nThree four!\" Five"
    assert [text[x["start"] : x["end"]] if x else None for x in got[0]] == ["One  two.", 'Three four!"', None, "Five"] and got[1] is None and got[2] is None and got[3] == []
    ids = spark.createDataFrame([(["b", "a", "b", None, None],), ([],), (None,)], "a array<string>").select(T.token_ids("a")).collect()
    assert [r[0] for r in ids] == [[0, 1, 0, 2, 2], [], None]
    langs = spark.createDataFrame([("so we take the sum of it",), ("also ist das nicht die Summe",), ("Итак, сумма",), ("所以结果是",), ("x=5",), (None,), ("カタカナのテスト",)], "t string").select(T.guess_language(F.col("t"))).collect()
    assert [r[0] for r in langs] == ["en", "de", "ru", "zh", None, None, "ja"]
    io = spark.createDataFrame([("q", '{"inputs": ["1"], "outputs": ["2"]}'), ("q", "{"), ("q", '{"inputs": [], "outputs": []}'), (None, '{"inputs": ["1"], "outputs": ["2"]}'), ("q", None)], "q string, io string")
    assert R.verified_io(io, "io", "q").count() == 1


def test_folds_over_counts(spark):
    df = spark.createDataFrame([(["a", "b", "a", "a"],), ([],), (["x"] * 3000,)], "a array<string>")
    rows = df.select(T.top_share(F.col("a")).alias("t"), T.entropy_bits(F.col("a")).alias("e"), T.trigram_repeat(F.col("a")).alias("r")).collect()
    assert rows[0]["t"] == 0.75 and rows[0]["e"] == pytest.approx(0.8112781245) and rows[0]["r"] == 0.0
    assert (rows[1]["t"], rows[1]["e"], rows[1]["r"]) == (0.0, 0.0, 0.0) and (rows[2]["t"], rows[2]["e"], rows[2]["r"]) == (1.0, 0.0, 1.0)


def test_scratch_folder_is_asked_for_on_a_cluster():
    from types import SimpleNamespace

    from rollweave import session

    fake = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError):
        session.scratch_dir(fake)
