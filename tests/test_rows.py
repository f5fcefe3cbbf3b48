import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rollweave import catalog
from rollweave.functions import embeddings as E
from rollweave.functions import scoring as C
from rollweave.functions import text as T
from rollweave.operators import aggregates as G
from rollweave.operators import filters as P
from rollweave.operators import joins as J
from rollweave.sources import jsonl, tables
from rollweave.streaming import online


def test_majority_and_ties(spark):
    def first(rows):
        return G.majority(spark.createDataFrame([(1, i, p, v) for i, (p, v) in enumerate(rows)], "g int, i int, p string, v double"), "g", "p", "v", "i").first()["v"]

    assert first([("A", 0.9), ("B", 0.8), ("A", 0.7)]) == 0.9
    assert first([("A", 0.9), ("B", 0.8), ("B", 0.7), ("A", 0.6)]) == 0.9


def test_validation_metrics(spark):
    rows = [("s", u, float(i % 2), "AB"[i % 2], i) for u in ("x", "y") for i in range(4)] + [("s", "z", 1.0, None, 0), ("s", "z", None, "A", 1)]
    df = spark.createDataFrame(rows, "data_source string, uid string, score double, pred string, o int")
    got = {r["metric"]: r["value"] for r in G.validation_metrics(df, "data_source", "uid", "score", "pred", "o").collect()}
    assert got["mean@4"] == 0.5 and got["std@4"] == 0.5 and got["mean@1"] == 1.0
    assert got["best@2/mean"] == pytest.approx(0.75, abs=0.05) and got["worst@4/mean"] < 0.1
    assert G.ladder(6) == [2, 4, 6] and G.ladder(1) == []
    with pytest.raises(ValueError):
        G.bootstrap(np.array([]), 2, {"max": np.max})
    assert G.bootstrap(np.array([3.0]), 2, {"max": np.max})["max"] == (3.0, 0.0)


def test_null_keys_in_set_operations(spark):
    a = spark.createDataFrame([("1", 1), (" 2 ", 2), (None, 3), ("x", 4), ("2", 5)], "k string, n int")
    b = spark.createDataFrame([("2",), (None,), ("y",), ("7",)], "k string")
    assert sorted(r["n"] for r in J.a_minus_b(a, b, "k").collect()) == [1, 2, 3, 4]
    assert sorted(r["n"] for r in J.a_and_b(a, b, "k").collect()) == [2, 5]
    assert [r["k"] for r in J.b_minus_a(a, b, "k").collect()] == ["7"]


def test_pairs_contrast_and_preferences(spark):
    df = spark.createDataFrame([(1, 1, 0.5, 1.0), (1, 2, 0.1, 0.0), (1, 3, 0.9, 1.0), (2, 4, 0.3, 0.0)], "g int, k int, q double, acc double")
    assert {(r["a_k"], r["b_k"]) for r in J.pairs_within(df, "g", "k", ["q"]).collect()} == {(1, 2), (1, 3), (2, 3)}
    c = {r["k"]: r["contrast"] for r in J.contrast_mean(df, "g", "acc", "q").collect()}
    assert c == {1: 0.1, 2: None, 3: 0.1, 4: None}
    assert J.concordance(df, "g", "k", "q", "acc").first()[0] == 1.0
    p = spark.createDataFrame([("p", "A", "x", "y"), ("q", "B", "x", "y"), ("r", "Tie", "x", "y")], "p string, l string, a string, b string")
    assert [(r["p"], r["completion"]) for r in J.preference_rows(p, ["p"], "l", "a", "b").where("role = 'chosen'").orderBy("p").collect()] == [("p", "x"), ("q", "y"), ("r", "y")]


def test_nan_and_null_never_pass_a_threshold(spark):
    df = spark.createDataFrame([(2.0,), (float("nan"),), (None,), (1.0,)], "x double")
    assert df.where(P.guarded("x", "gt", 1.5)).count() == 1
    assert df.where(P.thresholds(ge=["x:1"], le=["x:1.5"])).count() == 1
    assert df.where(P.thresholds(where="x < 5")).count() == 2
    with pytest.raises(ValueError):
        P.parse_comparisons(["x"])


def test_classes_and_groups(spark):
    df = spark.createDataFrame([("true", 0.0), ("no", 1.0), ("0.3", None), (None, 2.0), (None, float("nan")), ("?", -1.0)], "v string, r double")
    assert [r[0] for r in df.select(P.record_class([F.col("v")], F.col("r"))).collect()] == [1, 0, 1, 1, 2, 0]
    g = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 1.0), ("b", 2.0), ("c", 5.0)], "g string, m double")
    assert sorted(r["g"] for r in P.varied_groups(g, "g", "m").collect()) == ["b", "b", "c"]
    assert {r["g"] for r in P.varied_or_first(g.where("g <> 'b'"), "g", "m").collect()} == {"a"}


def test_text_features(spark):
    df = spark.createDataFrame([("aab  b b b c",), ("",), (None,), ("   ",), ("等一下 but So",), ("x　x y",)], "t string")
    m = T.text_metrics(df, "t", compress=True).collect()
    assert (m[0]["repeat_char_run_max"], m[0]["repeat_word_run_max"], m[0]["unique_word_ratio"], m[0]["top1_word_prop"]) == (2.0, 3.0, 0.6, 0.6)
    assert m[1]["compress_ratio"] == 1.0 and m[2]["resp_char_len"] == 0.0 and m[3]["repeat_word_run_max"] == 3.0
    assert m[0]["char_entropy_bits_per_char"] == pytest.approx(-sum(p * math.log2(p) for p in (2 / 12, 4 / 12, 1 / 12, 5 / 12)))
    assert m[5]["unique_word_ratio"] == pytest.approx(2 / 3)
    k = df.select(T.markers(F.col("t")).alias("m")).collect()
    assert (k[4]["m"]["mask"], k[4]["m"]["wait_like"], k[2]["m"]["mask"]) == (7, 1, 0)
    s = spark.createDataFrame([("a.\n\nb",), ("\n\nx",)], "t string").select(T.sections(F.col("t"))).collect()
    assert [r[0] for r in s] == [["a.\n\n", "b"], ["\n\n", "x"]]
    seg = T.segments(spark.createDataFrame([(1, "One two. Three!\nFour")], "k int, t string"), "k", "t").orderBy("char_start").collect()
    assert [r["text"] for r in seg] == ["One two. ", "Three!\n", "Four"] and [r["char_start"] for r in seg] == [0, 9, 16]
    assert T.tandem_blocks(np.array([1, 2] * 20)) == (20, 40) and T.tandem_blocks(np.array([1, 2, 3])) == (1, 0)


def test_segment_invariants_broadcasts_no_texts(spark, tmp_path):
    """The planner's size of the sentences is far below theirs, so at its default limit it would send all texts to the driver."""
    rows = [(i, "One two. Three!\nFour? " * 50 + str(i)) for i in range(200)] + [(200, ""), (201, None), (202, "\n\n")]
    spark.createDataFrame(rows, "line_no long, response_text string").write.parquet(str(tmp_path / "filtered_random4by53.parquet"))
    df = catalog.queries()["segment_invariants"](spark, str(tmp_path))
    got = df.collect()
    assert sorted(r["line_no"] for r in got) == [*range(200), 202] and all(r["any_line"] and r["covers"] for r in got)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_scores(spark):
    df = spark.createDataFrame([("so #### 1,234", "1234"), ("no number", "5"), ("#### 7", "8")], "r string, g string")
    assert [r[0] for r in df.select(C.gsm8k_score(F.col("r"), F.col("g"), format_score=0.1)).collect()] == [1.0, 0.0, 0.1]
    boxes = spark.createDataFrame([("x \\boxed{\\frac{1}{2}}", "0.5"), ("\\boxed{1", "1"), (None, "1"), ("\\boxed{(1, 2)}", "(1,2.0)")], "r string, g string")
    assert [r[0] for r in boxes.select(C.grade(F.col("r"), F.col("g"))).collect()] == [1.0, 0.0, 0.0, 1.0]
    assert C.final_answer("x = $12$ dollars") == "12" and C.latex_normal("\\frac12") == "\\frac{1}{2}" and C.latex_normal("3/4") == "\\frac{3}{4}"
    letters = spark.createDataFrame([("Answer: b",), ("the answer is C.",), ("x\nD\n",), ("none",), (None,)], "r string")
    assert [r[0] for r in letters.select(C.choice_letter(F.col("r"))).collect()] == ["B", "C", "D", None, None]
    qa = spark.createDataFrame([("<answer>The Cat!</answer>", ["a cat"]), ("cat", ["cat"])], "r string, g array<string>")
    assert [r[0] for r in qa.select(C.tagged_score(F.col("r"), F.col("g"))).collect()] == [1.0, 0.0]
    with pytest.raises(Exception, match="no scorer"):
        df.select(C.dispatch(F.lit("other"), F.col("r"), F.col("g"), {"a": "gsm8k"})).collect()


def test_embedding_measures(spark):
    assert E.metrics(np.zeros((1, 3))) == (0.0, 1.0, 1.0, 1.0, 1.0, 1.0) and math.isnan(E.metrics(np.zeros((0, 3)))[0])
    x = np.array([[1.0, 0], [1, 0], [0, 1], [1, 0]])
    dup, clusters, largest, rho, _, plateau = E.metrics(x)
    assert (dup, clusters, largest, rho, plateau) == (0.75, 2.0, 3.0, 0.75, 2.0)
    df = spark.createDataFrame([(1, i, [float(v) for v in r]) for i, r in enumerate(x)] + [(2, 0, None)], "s int, i int, e array<float>")
    a = E.sample_metrics(df, "s", ["i"], "e", {"all": None}).collect()
    assert [r["s"] for r in a] == [1] and a[0]["all_loopiness"] == pytest.approx(E.loopiness(df.where("s = 1"), "s", "i", "e").first()["loopiness"])


def test_json_lines(spark, tmp_path):
    f = tmp_path / "a.jsonl"
    f.write_text("# comment\n\n" + "\n".join(json.dumps({"uid": f"u{i}", "global_step": i}) for i in range(5)) + "\nnot json\n")
    d = jsonl.read(spark, str(f)).cache()
    assert d.where(F.col(jsonl.BAD).isNotNull()).count() == 2 and d.where("uid = 'u3'").first()["global_step"] == 3
    assert jsonl.line(spark, str(f), 4).first()["value"] == json.dumps({"uid": "u1", "global_step": 1})
    assert jsonl.first_keys(spark, str(f)) == ["uid", "global_step"]
    rows = spark.createDataFrame([("a/b", 1), (None, 2), ("", 3)], "g string, v int")
    jsonl.write_by_group(rows, str(tmp_path / "out"), "g")
    assert {p.name for p in (tmp_path / "out").iterdir() if p.is_dir()} == {"bucket=a_b", "bucket=__MISSING__", "bucket=EMPTY"}
    kept = P.mark_patterns(spark.createDataFrame([(3.0,), (1.0,), (None,)], "ce_ref_seq_mean double"), {"ce": P.PATTERNS["ce_ref_mean_too_large"]()})
    jsonl.write_good_bad(kept, str(tmp_path / "gb"))
    assert spark.read.json(str(tmp_path / "gb" / "part=bad_samples")).count() == 1


def test_row_maps(spark):
    chat = spark.createDataFrame([("\n\nHuman: hi there\n\nAssistant: hello\n\nHuman: bye",)], "t string").select(tables.parse_dialogue(F.col("t"))).first()[0]
    assert [(m["role"], m["content"]) for m in chat] == [("user", "hi there"), ("assistant", "hello"), ("user", "bye")]
    calls, rest = tables.tool_calls(F.col("t"))
    r = spark.createDataFrame([('a<tool_call>{"name": "f", "arguments": "{}"}</tool_call>b<tool_call>bad</tool_call>',)], "t string").select(calls.alias("c"), rest.alias("r")).first()
    assert [c["name"] for c in r["c"]] == ["f"] and r["r"] == "ab"


def test_streams(spark, tmp_path):
    src, schema = tmp_path / "in", "run string, uid string, ce_ref_seq_mean double"
    src.mkdir()
    from pyspark.sql.types import StructType

    s = online.records(spark, str(src), StructType.fromDDL(schema))
    (src / "1.json").write_text("\n".join(json.dumps({"run": "r", "uid": f"u{i}", "ce_ref_seq_mean": float(i)}) for i in range(5)))
    masked = online.keep_mask(s, {"ce": P.PATTERNS["ce_ref_mean_too_large"]()}).select("uid", "keep")
    online.write_stream(masked, str(tmp_path / "mask"), str(tmp_path / "c1")).awaitTermination()
    assert {r["uid"]: r["keep"] for r in spark.read.parquet(str(tmp_path / "mask")).collect()} == {"u0": True, "u1": True, "u2": False, "u3": False, "u4": False}
    acc = online.accumulate(s, "run", "uid", 3)
    online.write_stream(acc, str(tmp_path / "acc"), str(tmp_path / "c2")).awaitTermination()
    (src / "2.json").write_text(json.dumps({"run": "r", "uid": "u9"}))
    online.write_stream(acc, str(tmp_path / "acc"), str(tmp_path / "c2")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "acc")).groupBy("batch").count().collect()
    assert {(r["batch"], r["count"]) for r in got} == {(0, 3), (1, 3)}


def test_curriculum(spark):
    c = online.Curriculum()
    df = spark.createDataFrame([("a", 1.0, 1), ("b", 0.0, 2), ("c", 0.5, 3)], "g string, s double, k int")
    c.update(df.where("g <> 'c'"), "g", "s")
    assert [r["g"] for r in c.order(df, "g", "k").collect()] == ["c", "b", "a"]
    c.update(spark.createDataFrame([("b", 4.0), ("c", 0.1), (None, 9.0), ("c", None)], "g string, s double"), "g", "s")
    assert {r["_g"]: r["_w"] for r in c.weights.collect()} == {"a": 1.0, "b": 2.0, "c": 0.1, None: 9.0}
    assert [r["g"] for r in c.order(df, "g", "k").collect()] == ["c", "a", "b"] and c.order(df.limit(0), "g", "k").count() == 0


def test_scorer_dispatch_covers_every_rollout(spark, tmp_path):
    from rollweave.plans.text_queries import scorer_dispatch

    sources = ["step_arith", "step-arith", "STEP_ARITH", "step_arith ", "olymp_lite", None]
    df = spark.createDataFrame([(i, s, "Answer: 5", "5") for i, s in enumerate(sources)], "line_no bigint, data_source string, response_text string, ground_truth string")
    df.write.parquet(f"{tmp_path}/filtered_random4by53.parquet")
    got = {r["line_no"]: r["score"] for r in scorer_dispatch(spark, str(tmp_path)).collect()}
    assert sorted(got) == list(range(6)) and got[4] is None and got[5] is None
    assert got[0] is not None and got[0] == got[1] == got[2] == got[3]


def test_weighted_resample_draws_as_many_as_there_are_rows(spark, tmp_path):
    from rollweave.plans.group_queries import weighted_resample

    spark.range(2500).selectExpr("id AS o_orderkey", "id % 7 AS o_custkey", "cast(1000 + id AS double) AS o_totalprice").write.parquet(f"{tmp_path}/orders.parquet")
    got = weighted_resample(spark, str(tmp_path))
    assert sorted(r["draw"] for r in got.collect()) == list(range(2500))
