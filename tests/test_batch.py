import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rollweave.functions import sequences as Q
from rollweave.operators import batch as B
from rollweave.operators import sampling as S


def frame(spark, n):
    return spark.range(n).select(F.col("id").alias("idx"), F.concat(F.lit("r"), "id").alias("v"))


def rows(df, col="v"):
    return [r[col] for r in df.orderBy("idx").collect()]


def test_repeat_and_sample_level_repeat(spark):
    df = spark.createDataFrame([(0, "a", 3), (1, "b", 1), (2, "c", 2), (3, "d", 0), (4, "e", None)], "idx bigint, v string, n int")
    assert rows(B.repeat(df.where("idx < 3"), 2, 3)) == list("aabbcc")
    assert rows(B.repeat(df.where("idx < 3"), 2, 3, False)) == list("abcabc")
    assert [r["v"] for r in B.repeat_each(df, "n").orderBy("idx", "copy").collect()] == list("aaabcc")


@pytest.mark.parametrize(("n", "d"), [(10, 4), (3, 8), (8, 4), (1, 5), (0, 3)])
def test_pad_and_unpad(spark, n, d):
    df = frame(spark, n)
    padded, pad = B.pad_to_divisor(df, n, d)
    got = rows(padded)
    assert len(got) == n + pad and (n + pad) % d == 0 and got == [f"r{i % n}" for i in range(n + pad)]
    assert rows(B.unpad(padded, n + pad, pad)) == rows(df)


def test_fold_chunk_split_and_gather(spark):
    df = frame(spark, 12)
    assert rows(B.unfold(B.fold(df, 4, ["v"]), 4)) == rows(df)
    n = frame(spark, 5)
    assert [r[0] for r in n.orderBy("idx").select(B.split_list_id(5, 2)).collect()] == [0, 0, 1, 1, 1]
    assert [r[0] for r in n.orderBy("idx").select(B.chunk_id(5, 2)).collect()] == [0, 0, 0, 1, 1]
    pick = spark.createDataFrame([(0, 3), (1, 3), (2, 0)], "pos bigint, idx bigint")
    assert rows(B.select_positions(df, pick)) == ["r3", "r3", "r0"]
    assert rows(B.concat([n, n], [5, 5])) == [f"r{i}" for i in (0, 1, 2, 3, 4) * 2]
    assert rows(B.padding(n, 5, 2, last=True))[-2:] == ["r4", "r4"] and rows(B.padding(n, 5, 0)) == rows(n)


def test_union_of_columns_checks_equality(spark):
    a = spark.createDataFrame([(0, float("nan"), None), (1, 2.0, "x")], "idx bigint, q double, s string")
    assert B.union_columns(a, a.withColumn("z", F.lit(1))).count() == 2
    with pytest.raises(Exception, match="column q differs"):
        B.union_columns(a, a.withColumn("q", F.lit(7.0))).collect()


def test_positions_are_dense_for_ties_nulls_and_no_rows(spark):
    df = spark.createDataFrame([(i % 3 or None, i) for i in range(40)], "a int, b int").repartition(7)
    got = sorted(r["idx"] for r in B.with_index(df, ["a", "b"]).collect())
    assert got == list(range(40))
    assert B.with_index(df.limit(0), ["a", "b"]).count() == 0


def test_nested_and_flatten(spark):
    df = spark.createDataFrame([((1, ("x",)),)], "a struct<b: int, c: struct<d: string>>")
    assert B.flatten(df).columns == ["a/b", "a/c/d"]
    assert df.select(B.nested(df, "a.c.e", "none").alias("y")).first()[0] == "none"
    assert B.put_nested(df, "a.b", F.lit(9)).first()["a"]["b"] == 9
    with pytest.raises(ValueError):
        B.merge_meta({"a": 1}, {"a": 2})


def test_arrays(spark):
    df = spark.createDataFrame([([1, 2, 3, 4, 5],), ([],)], "a array<bigint>")
    a = F.col("a")
    got = df.select(Q.pad(a, 7, 0).alias("p"), Q.pad(a, 7, 0, True).alias("l"), Q.truncate(a, 3, "middle").alias("m"), Q.truncate(a, 2, "left").alias("t"), Q.response_mask(a, 3).alias("e")).collect()
    assert (got[0]["p"], got[0]["l"], got[0]["m"], got[0]["t"], got[0]["e"]) == ([1, 2, 3, 4, 5, 0, 0], [0, 0, 1, 2, 3, 4, 5], [1, 4, 5], [4, 5], [1, 1, 1, 0, 0])
    assert got[1]["p"] == [0] * 7 and got[1]["e"] == []
    with pytest.raises(Exception, match="longer"):
        df.select(Q.truncate(a, 3, "error")).collect()
    w = spark.createDataFrame([([9, 8, 7], [1, 0, 1])], "i array<bigint>, m array<int>")
    assert w.select(Q.without_pad(F.col("i"), F.col("m"))).first()[0] == [9, 7]


def test_turns_merge_while_the_observation_extends_what_came_before(spark):
    df = spark.createDataFrame([(1, 0, [1, 2], [3]), (1, 1, [1, 2, 3, 4], [5]), (1, 2, [9], [8])], "t int, turn int, o array<bigint>, a array<bigint>")
    got = [(r["run"], r["tokens"], r["mask"]) for r in Q.merge_turns(df, "t", "turn", "o", "a").orderBy("run").collect()]
    assert got == [(0, [1, 2, 3, 4, 5], [0, 0, 1, 0, 1]), (1, [9, 8], [0, 1])]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 500), min_size=1, max_size=40), st.integers(1, 6), st.booleans())
def test_balanced_partitions_hold_every_item_once(weights, parts, equal):
    if equal:
        weights = weights[: len(weights) // parts * parts]
    if not weights:
        return
    for f in (S.karmarkar_karp, S.greedy):
        got = f(weights, parts, equal)
        assert sorted(i for p in got for i in p) == list(range(len(weights))) and len(got) == parts
        if equal:
            assert {len(p) for p in got} == {len(weights) // parts}


def test_resampling_follows_the_weights(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 3.0), (3, 0.0), (4, None), (5, float("nan"))], "k bigint, w double")
    got = S.resample(df, "k", F.col("w"), 4000, 3).groupBy("k").count().collect()
    n = {r["k"]: r["count"] for r in got}
    assert set(n) == {1, 2} and sum(n.values()) == 4000 and abs(n[2] / 4000 - 0.75) < 0.05


def test_stratified_counts_equal_targets(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2] if i % 5 else None) for i in range(100)], "k bigint, g string")
    n = {r["g"]: r["count"] for r in S.stratified(df, "g", S.arithmetic_key("k"), "k", 0.1, "floor", 3, 4).groupBy("g").count().collect()}
    assert n == {"a": 4, "b": 4, None: 3}


def test_first_share(spark):
    df = frame(spark, 10)
    assert rows(B.first_share(df, ["idx"], 0.35, 1)) == ["r0", "r1", "r2"]
    assert rows(B.first_share(df, ["idx"], 0.01, 1)) == ["r0"]
    assert B.first_share(df.limit(0), ["idx"], 0.5, 1).count() == 0
