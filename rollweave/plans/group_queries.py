"""Queries on sequence rows and groups: advantages, group filters, statistics, sets, sampling.

``orders`` stands for sequences (group: customer, score: price), ``events`` for metric logs and votes, ``val_scores`` for
validation runs, the rollout tables for themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollweave.functions import losses as L
from rollweave.operators import advantages as A
from rollweave.operators import aggregates as G
from rollweave.operators import filters as P
from rollweave.operators import joins as J
from rollweave.operators import sampling as S
from rollweave.plans.registry import query, r6
from rollweave.session import table

ROLL = "filtered_random4by53"
SEQ = "s AS (SELECT o_orderkey AS k, o_custkey AS g, o_totalprice / 77777e0 AS score, coalesce(n, 0) AS len FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)"


def sequences(spark: SparkSession, d: str, lengths: bool = False) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("g"), (F.col("o_totalprice") / 77777.0).alias("score"))
    if not lengths:
        return o
    n = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("len"))
    return o.join(n, F.col("k") == F.col("l_orderkey"), "left").drop("l_orderkey").fillna(0, ["len"])


def _advantage(name: str, estimator: str, sql: str, lengths: bool = False, **options: object) -> None:
    @query(f"WITH {SEQ} {sql}", name)
    def _(spark: SparkSession, d: str) -> DataFrame:
        s = A.compute_advantage(sequences(spark, d, lengths), estimator, group="g", score="score", **options)
        return s.select("k", r6("adv").alias("adv"))


_W = "WINDOW w AS (PARTITION BY g)"
_advantage("grpo_advantage", "grpo", f"SELECT k, round(CASE WHEN count(*) OVER w = 1 THEN score / (1 + 1e-6) ELSE (score - avg(score) OVER w) / (stddev_samp(score) OVER w + 1e-6) END, 6) + 0.0 AS adv FROM s {_W}")
_advantage("grpo_advantage_no_std", "grpo", f"SELECT k, round(CASE WHEN count(*) OVER w = 1 THEN score ELSE score - avg(score) OVER w END, 6) + 0.0 AS adv FROM s {_W}", by_std=False)
_advantage("rloo_advantage", "rloo", f"SELECT k, round(CASE WHEN count(*) OVER w = 1 THEN score ELSE (score - avg(score) OVER w) * count(*) OVER w / (count(*) OVER w - 1) END, 6) + 0.0 AS adv FROM s {_W}")
_advantage("opo_advantage", "opo", f"SELECT k, round(CASE WHEN count(*) OVER w = 1 THEN score ELSE score - sum(len * score) OVER w / sum(len) OVER w END, 6) + 0.0 AS adv FROM s {_W}", lengths=True, length="len")
_advantage("gpg_advantage", "gpg", f"SELECT k, round((SELECT count(*) / count(*) FILTER (WHERE score <> 0) FROM s) * CASE WHEN count(*) OVER w = 1 THEN score ELSE score - avg(score) OVER w END, 6) + 0.0 AS adv FROM s {_W}")
_advantage("group_centred_advantage", "group_centred", f"SELECT k, round(score - avg(score) OVER w, 6) + 0.0 AS adv FROM s {_W}")


@query(f"WITH {SEQ}, r AS (SELECT k, g, score, count(*) OVER w AS n, stddev_samp(score) OVER w AS sd, row_number() OVER (PARTITION BY g ORDER BY score DESC, k) AS rn, lead(score) OVER (PARTITION BY g ORDER BY score DESC, k) AS nxt FROM s {_W}) SELECT k, round(CASE WHEN rn = 1 THEN (score - nxt) / (sd + 1e-6) ELSE 0e0 END, 6) + 0.0 AS adv FROM r WHERE n > 1")
def grpo_passk_advantage(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql.window import Window

    s = sequences(spark, d).withColumn("n", F.count("*").over(Window.partitionBy("g"))).where("n > 1")
    return A.grpo_passk(s, "g", "score", "k").select("k", r6("adv").alias("adv"))


@query(f"""WITH {SEQ}, c AS (SELECT k, CASE WHEN len > 2 THEN 1 ELSE 0 END AS m, CASE WHEN count(*) OVER w = 1 THEN score ELSE score - avg(score) OVER w END AS x FROM s {_W}),
m AS (SELECT sum(m) AS n, sum(m * x) / (sum(m) + 1e-8) AS mean FROM c), v AS (SELECT mean, (SELECT sum(m * (x - mean) ^ 2) FROM c) / (n + 1e-8) * n / (n - 1) AS var FROM m)
SELECT k, round((x - mean) / sqrt(var + 1e-8), 6) + 0.0 AS adv FROM c, v""")
def rfpp_baseline_whitened(spark: SparkSession, d: str) -> DataFrame:
    s = sequences(spark, d, True).withColumn("m", F.when(F.col("len") > 2, 1).otherwise(0))
    return A.rfpp_baseline(s, "g", "score", "m").select("k", r6("adv").alias("adv"))


@query(f"WITH {SEQ}, m AS (SELECT max(2e0 * score) AS t FROM s), z AS (SELECT (t + ln(sum(exp(2e0 * score - t))) - ln(count(*))) / 2e0 AS sm FROM s, m GROUP BY t) SELECT k, round(score - sm, 6) + 0.0 AS adv FROM s, z")
def sppo_advantage(spark: SparkSession, d: str) -> DataFrame:
    return A.sppo(sequences(spark, d), "score", 2.0).select("k", r6("adv").alias("adv"))


@query(f"WITH {SEQ}, f AS (SELECT *, min(score) OVER w AS lo, max(score) OVER w AS hi, count(*) OVER w AS n FROM s {_W}) SELECT k, g, round(score, 6) AS score FROM f WHERE lo <> hi OR n = 1")
def dynamic_sampling_filter(spark: SparkSession, d: str) -> DataFrame:
    return P.varied_groups(sequences(spark, d), "g", "score").select("k", "g", r6("score").alias("score"))


@query(f"WITH {SEQ}, f AS (SELECT k, g, score, min(score) OVER w AS lo, max(score) OVER w AS hi, count(*) OVER w AS n, avg(score) OVER w AS mu, stddev_samp(score) OVER w AS sd FROM s {_W}) SELECT k, g, round(CASE WHEN n = 1 THEN score / (1 + 1e-6) ELSE (score - mu) / (sd + 1e-6) END, 6) + 0.0 AS adv FROM f WHERE lo <> hi OR n = 1")
def dynamic_sampling_grpo(spark: SparkSession, d: str) -> DataFrame:
    return A.grpo(P.varied_groups(sequences(spark, d), "g", "score"), "g", "score").select("k", "g", r6("adv").alias("adv"))


@query(f"WITH {SEQ}, v AS (SELECT g FROM s GROUP BY g HAVING min(len) <> max(len)) SELECT k, g, len FROM s WHERE g IN (SELECT g FROM v) OR (NOT EXISTS (SELECT 1 FROM v) AND g = (SELECT min(g) FROM s))")
def constant_group_removal(spark: SparkSession, d: str) -> DataFrame:
    return P.varied_or_first(sequences(spark, d, True), "g", "len").select("k", "g", "len")


@query(f"WITH {SEQ}, f AS (SELECT *, avg(CASE WHEN score > 1.5e0 THEN 1e0 ELSE 0e0 END) OVER w BETWEEN 0.2e0 AND 0.8e0 AND max(len) OVER w < 14 AS passes FROM s {_W}), n AS (SELECT CAST(floor(count(*) / 2e0) AS BIGINT) AS n FROM s), r AS (SELECT *, row_number() OVER (ORDER BY passes DESC, g, k) AS rn FROM f) SELECT k, g, passes FROM r, n WHERE rn <= n")
def accuracy_filter_downsample(spark: SparkSession, d: str) -> DataFrame:
    s = sequences(spark, d, True).withColumn("acc", F.when(F.col("score") > 1.5, 1.0).otherwise(0.0))
    return P.downsample(s, "g", "acc", "len", ["k"], 0.2, 0.8, 15, 2.0).select("k", "g", "passes")


@query(f"WITH bad AS (SELECT uid FROM {ROLL} WHERE uid IS NOT NULL GROUP BY uid HAVING min(global_step) = max(global_step) UNION SELECT uid FROM samples WHERE uid IS NOT NULL AND response_len_tokens < 5) SELECT line_no, uid FROM {ROLL} WHERE uid IS NULL OR uid NOT IN (SELECT uid FROM bad)")
def bad_uid_union(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, ROLL).select("line_no", "uid", "global_step")
    one = r.groupBy("uid").agg((F.min("global_step") == F.max("global_step")).alias("c")).where("c")
    short = table(spark, d, "samples").where((F.col("response_len_tokens") < 5) & ~F.isnan("response_len_tokens"))
    return P.drop_bad_groups(r, "uid", [one, short]).select("line_no", "uid")


@query(f"SELECT line_no, uid FROM {ROLL} r WHERE NOT EXISTS (SELECT 1 FROM samples s WHERE s.line_no = r.line_no AND s.valid = 1)")
def a_minus_b(spark: SparkSession, d: str) -> DataFrame:
    return J.a_minus_b(table(spark, d, ROLL).select("line_no", "uid"), table(spark, d, "samples").where("valid = 1"), "line_no")


@query("SELECT doc_id, CAST(shard AS BIGINT) AS shard FROM documents WHERE shard IN (SELECT CAST(budget_id AS INTEGER) FROM token_budgets)")
def a_and_b(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "token_budgets").select(F.col("budget_id").cast("string").alias("shard"))
    return J.a_and_b(table(spark, d, "documents").select("doc_id", F.col("shard").cast("bigint").alias("shard")), b, "shard")


@query("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def b_minus_a(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return J.b_minus_a(a, table(spark, d, "part").select("p_partkey"), "p_partkey")


@query("SELECT DISTINCT l_suppkey AS id FROM lineitem WHERE l_quantity > 40 EXCEPT SELECT s_suppkey FROM supplier WHERE s_nationkey < 5")
def id_difference(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "lineitem").where("l_quantity > 40").select(F.col("l_suppkey").alias("id")).distinct()
    return a.subtract(table(spark, d, "supplier").where("s_nationkey < 5").select(F.col("s_suppkey").alias("id")))


@query("SELECT DISTINCT l_suppkey AS id FROM lineitem WHERE l_quantity > 40 INTERSECT SELECT s_suppkey FROM supplier WHERE s_nationkey < 5")
def id_intersection(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "lineitem").where("l_quantity > 40").select(F.col("l_suppkey").alias("id")).distinct()
    return a.intersect(table(spark, d, "supplier").where("s_nationkey < 5").select(F.col("s_suppkey").alias("id")))


@query("SELECT extra_info.\"index\" AS idx, split FROM train_prompts t WHERE extra_info.raw_problem IS NULL OR NOT EXISTS (SELECT 1 FROM train_prompts x WHERE lower(x.split) = 'test' AND x.extra_info.raw_problem = t.extra_info.raw_problem)")
def decontaminate_train(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "train_prompts").select(F.col("extra_info.index").alias("idx"), F.col("extra_info.raw_problem").alias("q"), "split")
    return J.decontaminate(t, t.where(F.lower("split") == "test"), "q", "q").select("idx", "split")


@query(f"""WITH m AS (SELECT line_no, arg_max(CAST(kept_flag AS INTEGER), sample_idx * 1000 + coalesce(kept_flag, 0)) AS kept FROM samples WHERE kept_flag IS NOT NULL GROUP BY line_no)
SELECT r.line_no, coalesce(kept, 0) AS kept FROM {ROLL} r LEFT JOIN m ON m.line_no = r.line_no""")
def metric_reattachment(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "samples").where("kept_flag is not null").select("line_no", F.col("kept_flag").cast("int").alias("kept"), (F.col("sample_idx") * 1000 + F.col("kept_flag")).alias("o"))
    return J.attach_metrics(table(spark, d, ROLL).select("line_no"), m, "line_no", "o", ["kept"])


@query(f"WITH {SEQ}, x AS (SELECT k, g, score, len FROM s) SELECT a.g, a.k AS a_k, b.k AS b_k, round(b.score - a.score, 6) + 0.0 AS diff FROM x a JOIN x b ON a.g = b.g AND a.k < b.k")
def within_group_pairs(spark: SparkSession, d: str) -> DataFrame:
    p = J.pairs_within(sequences(spark, d), "g", "k", ["score"])
    return p.select("g", "a_k", "b_k", r6(F.col("b_score") - F.col("a_score")).alias("diff"))


@query(f"WITH {SEQ}, g AS (SELECT a.g, sum(abs(a.len - b.len)) AS w, sum(CASE WHEN (a.score > b.score) = (a.len > b.len) THEN abs(a.len - b.len) ELSE 0 END) AS r FROM s a JOIN s b ON a.g = b.g AND a.k < b.k GROUP BY a.g) SELECT round(avg(CASE WHEN w > 0 THEN r / w ELSE 0.5e0 END), 6) AS concordance FROM g")
def pair_concordance(spark: SparkSession, d: str) -> DataFrame:
    return J.concordance(sequences(spark, d, True), "g", "k", "score", "len").select(r6("concordance").alias("concordance"))


@query(f"WITH {SEQ} SELECT round(avg(ln(1 + exp(-abs(0.05e0 * score))) + greatest(0.05e0 * score, 0e0) - 0.05e0 * score * CASE WHEN len > 3 THEN 1 ELSE 0 END), 6) AS ce_dpo, round(avg(CASE WHEN sign(score - 2e0) = CASE WHEN len > 3 THEN 1 ELSE -1 END THEN 1e0 ELSE 0e0 END), 6) AS abs_accuracy FROM s")
def reward_model_losses(spark: SparkSession, d: str) -> DataFrame:
    s = sequences(spark, d, True)
    acc = F.when(F.col("len") > 3, 1.0).otherwise(0.0)
    return s.agg(r6(F.avg(L.ce_dpo_loss(F.col("score"), acc, 0.05))).alias("ce_dpo"), r6(F.avg((F.signum(F.col("score") - 2.0) == F.signum(acc * 2 - 1)).cast("double"))).alias("abs_accuracy"))


@query(f"WITH {SEQ}, m AS (SELECT max(0.5e0 * score) AS t FROM s) SELECT round((t + ln(sum(exp(0.5e0 * score - t))) - ln(count(*))) / 0.5e0, 6) AS softmean FROM s, m GROUP BY t")
def softmean(spark: SparkSession, d: str) -> DataFrame:
    return A.softmean(sequences(spark, d), "score", 0.5).select(r6("softmean").alias("softmean"))


@query("""WITH a AS (SELECT item_id, row_number() OVER (ORDER BY eval_set, item_id) AS i FROM eval_items), b AS (SELECT vec_id, label, row_number() OVER (ORDER BY label DESC, vec_id) AS i FROM embeddings)
SELECT item_id, vec_id, label FROM a JOIN b USING (i)""")
def positional_join(spark: SparkSession, d: str) -> DataFrame:
    """Row by row, whatever the keys: the n-th item with the n-th vector, as far as both tables go."""
    a, b = table(spark, d, "eval_items").select("item_id", "eval_set"), table(spark, d, "embeddings").select("vec_id", "label").withColumn("down", -F.col("label"))
    return J.positional(a, ["eval_set", "item_id"], b, ["down", "vec_id"]).select("item_id", "vec_id", "label")


@query()
def balance_across_ranks(spark: SparkSession, d: str) -> DataFrame:
    """Every rank of a batch gets as many sequences (up to one, where they do not divide) and about as many tokens; rows come
    out grouped by rank."""
    s = sequences(spark, d, True).withColumn("batch", F.floor((F.col("k") - 1) / 64))
    return S.balanced(s, "batch", "k", "len", 8, equal=True).repartitionByRange("batch", "part").sortWithinPartitions("batch", "part", "k")


@query(f"WITH {SEQ} SELECT a.k, round((SELECT avg(b.score) FROM s b WHERE b.g = a.g AND b.len < a.len), 6) AS contrast FROM s a")
def contrast_set(spark: SparkSession, d: str) -> DataFrame:
    return J.contrast_mean(sequences(spark, d, True), "g", "len", "score").select("k", r6("contrast").alias("contrast"))


@query(f"WITH {SEQ} SELECT k, row_number() OVER (PARTITION BY k // 2 ORDER BY score DESC, k) = 1 AS winner FROM s")
def pair_winner(spark: SparkSession, d: str) -> DataFrame:
    return J.pair_winner(sequences(spark, d), F.floor(F.col("k") / 2), "score", "k").select("k", "winner")


@query("SELECT l_orderkey AS k, x.role, x.completion FROM (SELECT l_orderkey, unnest([{'role': 'chosen', 'completion': CASE WHEN l_returnflag = 'A' THEN l_linestatus ELSE l_returnflag END}, {'role': 'rejected', 'completion': CASE WHEN l_returnflag = 'A' THEN l_returnflag ELSE l_linestatus END}]) AS x FROM lineitem)")
def preference_pairs(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), "l_returnflag", "l_linestatus")
    return J.preference_rows(li, ["k"], "l_returnflag", "l_linestatus", "l_returnflag")


@query("SELECT 1e0 * max(l_quantity) AS max_quantity, 1e0 * min(l_tax) AS min_tax, round(avg(l_discount), 6) AS discount FROM lineitem")
def reduce_metrics_by_name(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select(F.col("l_quantity").cast("double").alias("max_quantity"), F.col("l_tax").alias("min_tax"), F.col("l_discount").alias("discount"))
    m = G.reduce_metrics(li, ["max_quantity", "min_tax", "discount"])
    return m.select("max_quantity", (F.col("min_tax") + 0.0).alias("min_tax"), r6("discount").alias("discount"))


@query(f"""WITH {SEQ} SELECT round(avg(score), 6) AS score_mean, round(max(score), 6) AS score_max, round(min(score), 6) AS score_min, round(avg(len), 6) AS length_mean, 1e0 * max(len) AS length_max, 1e0 * min(len) AS length_min,
round(avg(CASE WHEN len >= 7 THEN 1e0 ELSE 0e0 END), 6) AS clip_ratio, round(avg(CASE WHEN len = 0 THEN 1e0 ELSE 0e0 END), 6) AS aborted_ratio, round(1 - var_samp(score - len / 4e0) / (var_samp(score) + 1e-5), 6) AS explained_variance FROM s""")
def data_metrics(spark: SparkSession, d: str) -> DataFrame:
    s = sequences(spark, d, True).withColumn("len", F.col("len").cast("double"))
    m = s.agg(*G.summary({"score": F.col("score"), "length": F.col("len")}), F.avg((F.col("len") >= 7).cast("double")).alias("clip_ratio"), F.avg((F.col("len") == 0).cast("double")).alias("aborted_ratio"), G.explained_variance(F.col("score"), F.col("len") / 4).alias("explained_variance"))
    return m.select(*[r6(c).alias(c) for c in m.columns])


@query("WITH t AS (SELECT event_type AS stage, sum(value) AS secs FROM events GROUP BY 1), n AS (SELECT count(*) AS tok FROM lineitem) SELECT stage, round(secs, 4) AS secs, round(secs * 1000 / tok, 6) AS ms_per_token, round(tok / (secs * 8), 6) AS throughput FROM t, n")
def timing_throughput(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "events").groupBy(F.col("event_type").alias("stage")).agg(F.sum("value").alias("secs"))
    n = table(spark, d, "lineitem").agg(F.count("*").alias("tok"))
    return t.crossJoin(F.broadcast(n)).select("stage", F.round("secs", 4).alias("secs"), r6(F.col("secs") * 1000 / F.col("tok")).alias("ms_per_token"), r6(F.col("tok") / (F.col("secs") * 8)).alias("throughput"))


_EV = "e AS (SELECT event_id, user_id, event_type, value, strftime(ts, '%Y-%m-%d') AS day FROM events)"


@query(f"WITH {_EV}, v AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS f FROM e GROUP BY 1, 2), b AS (SELECT user_id, event_type, f, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) AS rn FROM v) SELECT b.user_id, round(e.value, 6) AS value FROM b JOIN e ON e.event_id = b.f WHERE rn = 1")
def majority_value(spark: SparkSession, d: str) -> DataFrame:
    return G.majority(table(spark, d, "events"), "user_id", "event_type", "value", "event_id").select("user_id", r6("value").alias("value"))


_VS = "v AS (SELECT data_source, uid, score, repeat_index FROM val_scores WHERE score IS NOT NULL AND NOT isnan(score) AND uid IS NOT NULL)"


@query(f"WITH {_VS}, c AS (SELECT uid, CASE WHEN score > 0 THEN 1 ELSE 0 END AS ok FROM v), g AS (SELECT uid, max(ok) AS a, sum(ok) AS r, count(*) AS n FROM c GROUP BY uid) SELECT round(avg(a), 6) AS pass_at_k, round(sum(r) / sum(n), 6) AS mean_at_k, count(*) AS groups, sum(n)::BIGINT AS rows FROM g")
def pass_at_k(spark: SparkSession, d: str) -> DataFrame:
    return G.pass_at_k(_scores(spark, d).withColumn("ok", (F.col("score") > 0).cast("int")), "uid", "ok").select(r6("pass_at_k").alias("pass_at_k"), r6("mean_at_k").alias("mean_at_k"), "groups", "rows")


def _scores(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "val_scores").select("data_source", "uid", "score", "pred", "repeat_index", "global_step")
    return v.where(F.col("score").isNotNull() & ~F.isnan("score") & F.col("uid").isNotNull())


@query(f"WITH {_VS}, g AS (SELECT uid, min(score) AS lo, max(score) AS hi FROM v GROUP BY uid) SELECT round(avg(CASE WHEN lo < 0.5 AND hi >= 0.5 THEN 1e0 ELSE 0e0 END), 6) AS mixed, round(avg(CASE WHEN lo >= 0.5 THEN 1e0 ELSE 0e0 END), 6) AS all_good, round(avg(CASE WHEN hi < 0.5 THEN 1e0 ELSE 0e0 END), 6) AS all_bad FROM g")
def by_group_mix(spark: SparkSession, d: str) -> DataFrame:
    m = G.group_mix(_scores(spark, d), "uid", "score")
    return m.select(*[r6(c).alias(c) for c in m.columns])


@query(f"WITH {_VS}, g AS (SELECT data_source, uid, avg(score) AS m FROM v GROUP BY 1, 2) SELECT data_source, round(avg(m), 6) + 0.0 AS test_score FROM g GROUP BY 1")
def test_score_by_source(spark: SparkSession, d: str) -> DataFrame:
    g = _scores(spark, d).groupBy("data_source", "uid").agg(F.avg("score").alias("m"))
    return g.groupBy("data_source").agg(r6(F.avg("m")).alias("test_score"))


@query()
def validation_metrics(spark: SparkSession, d: str) -> DataFrame:
    v = _scores(spark, d).withColumn("o", F.col("repeat_index") * 100_000 + F.col("global_step"))
    return G.validation_metrics(v, "data_source", "uid", "score", "pred", "o")


@query("WITH t AS (SELECT o_totalprice / 1e5 AS x, unnest(list_distinct([o_orderstatus, o_orderpriority, 'all'])) AS tag FROM orders) SELECT tag, count(*) AS n, round(avg(x), 6) AS mean FROM t GROUP BY tag")
def tag_rollup(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select((F.col("o_totalprice") / 1e5).alias("x"), F.array("o_orderstatus", "o_orderpriority").alias("tags"))
    return G.by_tag(o, "tags", [F.count("*").alias("n"), r6(F.avg("x")).alias("mean")])


@query(f"WITH {SEQ}, t AS (SELECT l_orderkey, count(*) AS turns, sum(l_quantity) AS ac, sum(l_linenumber) AS ob FROM lineitem GROUP BY 1) SELECT round(sum(ac) / sum(turns), 6) AS ac_tokens_per_turn, round(sum(ob) / sum(turns), 6) AS ob_tokens_per_turn, round(avg(turns), 6) AS turns_per_episode, sum(ac)::DOUBLE AS total_ac, count(*) AS episodes FROM t")
def trajectory_metrics(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("turns"), F.sum("l_quantity").alias("ac"), F.sum("l_linenumber").alias("ob"))
    return t.agg(r6(F.sum("ac") / F.sum("turns")).alias("ac_tokens_per_turn"), r6(F.sum("ob") / F.sum("turns")).alias("ob_tokens_per_turn"), r6(F.avg("turns")).alias("turns_per_episode"), F.sum("ac").cast("double").alias("total_ac"), F.count("*").alias("episodes"))


@query(f"SELECT k AS key, round(avg(TRY_CAST(reward_extra_infos[k] AS DOUBLE)), 6) AS mean FROM (SELECT reward_extra_infos, unnest(map_keys(reward_extra_infos)) AS k FROM {ROLL}) GROUP BY 1")
def dict_mean(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, ROLL).select(F.transform_values("reward_extra_infos", lambda _, v: v.try_cast("double")).alias("m"))
    return G.map_mean(m, "m").select("key", r6("mean").alias("mean"))


@query(f"WITH {_EV} SELECT day, round(median(value), 6) AS median, round(sum(value), 4) AS sum, round(avg(value), 6) AS mean FROM e GROUP BY day")
def per_step_aggregate(spark: SparkSession, d: str) -> DataFrame:
    s = G.per_step(table(spark, d, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("day"), "value"), "day", "value")
    return s.select("day", r6("median").alias("median"), F.round("sum", 4).alias("sum"), r6("mean").alias("mean"))


@query(f"SELECT global_step, round(median(reward_seq_mean), 6) + 0.0 AS median, round(sum(reward_seq_mean), 4) + 0.0 AS sum, round(avg(reward_seq_mean), 6) + 0.0 AS mean FROM {ROLL} WHERE isfinite(reward_seq_mean) GROUP BY 1")
def per_step_reward(spark: SparkSession, d: str) -> DataFrame:
    s = G.per_step(table(spark, d, ROLL), "global_step", "reward_seq_mean")
    return s.select("global_step", r6("median").alias("median"), (F.round("sum", 4) + 0.0).alias("sum"), r6("mean").alias("mean"))


_CLS = "CASE WHEN reward_seq_sum IS NULL OR isnan(reward_seq_sum) THEN 2 WHEN reward_seq_sum > 0 THEN 1 ELSE 0 END"


@query(f"SELECT global_step, {_CLS} AS cls, count(*) AS n FROM {ROLL} GROUP BY 1, 2")
def group_by_step_class(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, ROLL).groupBy("global_step", P.record_class([], F.col("reward_seq_sum")).alias("cls")).agg(F.count("*").alias("n"))


@query(f"SELECT coalesce(data_source, '__MISSING__') AS grp, count(*) AS n FROM {ROLL} GROUP BY 1")
def group_counts(spark: SparkSession, d: str) -> DataFrame:
    return G.group_counts(table(spark, d, ROLL), "data_source")


@query(f"SELECT line_no, data_source FROM {ROLL} WHERE coalesce(data_source, '__MISSING__') IN ('__MISSING__', 'zh_school', 'geo_sketch')")
def group_membership(spark: SparkSession, d: str) -> DataFrame:
    return P.in_groups(table(spark, d, ROLL), "data_source", ["__MISSING__", "zh_school", "geo_sketch"]).select("line_no", "data_source")


@query("""WITH d AS (SELECT doc_id, source, CASE WHEN lang IS NULL THEN 'none' ELSE lower(lang) END AS lang, n_chars, lag(CASE WHEN lang IS NULL THEN 'none' ELSE lower(lang) END) OVER (PARTITION BY source ORDER BY doc_id) AS p FROM documents WHERE source IS NOT NULL),
c AS (SELECT source, lang, sum(n_chars) AS c, sum(CASE WHEN p <> lang THEN 1 ELSE 0 END) AS sw FROM d GROUP BY 1, 2), s AS (SELECT *, c / sum(c) OVER (PARTITION BY source) AS p FROM c)
SELECT source, round(-sum(CASE WHEN p > 0 THEN p * ln(p) ELSE 0 END), 6) + 0.0 AS entropy, count(*) FILTER (WHERE p > 0.1e0) AS major, sum(sw)::BIGINT AS switches FROM s GROUP BY source""")
def lang_entropy(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "documents").where("source is not null").select("doc_id", "source", F.coalesce(F.lower("lang"), F.lit("none")).alias("lang"), "n_chars")
    return G.language_stats(x, "source", "lang", "n_chars", "doc_id").select("source", r6("entropy").alias("entropy"), "major", "switches")


@query("SELECT event_type, [quantile_cont(value, 0.1), quantile_cont(value, 0.5), quantile_cont(value, 0.9), quantile_cont(value, 0.99)]::VARCHAR IS NOT NULL AS ok, round(quantile_cont(value, 0.1), 6) AS p10, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY 1")
def run_length_percentiles(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "events").groupBy("event_type").agg(F.percentile("value", [0.1, 0.5, 0.9, 0.99]).alias("p"))
    return p.select("event_type", F.lit(True).alias("ok"), *[r6(F.col("p")[i]).alias(n) for i, n in enumerate(("p10", "p50", "p90", "p99"))])


_KEY = "(line_no * 2654435761 + 7) % 4294967296"


@query(f"""WITH r AS (SELECT line_no, coalesce(data_source, '__MISSING__') AS g, row_number() OVER (PARTITION BY coalesce(data_source, '__MISSING__') ORDER BY {_KEY}, line_no) AS rn, count(*) OVER (PARTITION BY coalesce(data_source, '__MISSING__')) AS n FROM {ROLL})
SELECT line_no, g FROM r WHERE rn <= least(greatest(floor(n * 0.1e0), 2), 50, n)""")
def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, ROLL).select("line_no", "data_source")
    s = S.stratified(r, "data_source", S.arithmetic_key("line_no", 7), "line_no", 0.1, "floor", 2, 50)
    return s.select("line_no", S.group_name("data_source").alias("g"))


@query("WITH c AS (SELECT coalesce(source, '__MISSING__') AS grp, count(*) AS n FROM documents GROUP BY 1) SELECT grp, n, CAST(least(round_even(n * 0.25e0, 0), n) AS BIGINT) AS k FROM c")
def target_sizes(spark: SparkSession, d: str) -> DataFrame:
    return S.target_sizes(G.group_counts(table(spark, d, "documents"), "source"), "n", 0.25, "round")


@query(f"SELECT line_no FROM {ROLL} ORDER BY {_KEY}, line_no LIMIT 200")
def seeded_sample(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, ROLL).orderBy(S.arithmetic_key("line_no", 7), "line_no").limit(200).select("line_no")


@query(f"WITH r AS (SELECT line_no, uid, row_number() OVER (PARTITION BY uid ORDER BY global_step, line_no) AS rn FROM {ROLL}) SELECT line_no, uid FROM r WHERE rn = 1")
def first_per_uid(spark: SparkSession, d: str) -> DataFrame:
    return S.first_per(table(spark, d, ROLL).select("line_no", "uid", "global_step"), "uid", ["global_step", "line_no"]).select("line_no", "uid")


@query(f"WITH r AS (SELECT line_no, global_step, row_number() OVER (PARTITION BY global_step ORDER BY line_no) AS rn FROM {ROLL}) SELECT line_no, global_step FROM r WHERE rn <= 3")
def per_step_limit(spark: SparkSession, d: str) -> DataFrame:
    return S.limit_per(table(spark, d, ROLL).select("line_no", "global_step"), "global_step", ["line_no"], 3)


@query(f"SELECT uid, min(line_no) AS first_line, CAST(row_number() OVER (ORDER BY min(line_no)) - 1 AS BIGINT) AS pos FROM {ROLL} WHERE uid IS NOT NULL GROUP BY uid")
def first_seen_order(spark: SparkSession, d: str) -> DataFrame:
    from rollweave.operators.batch import with_index

    u = table(spark, d, ROLL).where("uid is not null").groupBy("uid").agg(F.min("line_no").alias("first_line"))
    return with_index(u, ["first_line"], "pos").select("uid", "first_line", "pos")


@query(f"""WITH c AS (SELECT r.line_no, r.global_step, s.ce_ref_seq_mean AS ce, s.entropy_seq_mean AS ent, {_CLS.replace('reward_seq_sum', 'r.reward_seq_sum')} AS cls, r.response_text FROM {ROLL} r JOIN (SELECT DISTINCT ON (line_no) * FROM samples ORDER BY line_no, sample_idx) s ON s.line_no = r.line_no),
f AS (SELECT * FROM c WHERE (ce >= 1.2e0 AND NOT isnan(ce)) OR (ent <= 0.3e0 AND NOT isnan(ent))), u AS (SELECT *, row_number() OVER (PARTITION BY response_text ORDER BY line_no) AS rn FROM f), l AS (SELECT *, row_number() OVER (PARTITION BY global_step ORDER BY line_no) AS rs FROM u WHERE rn = 1)
SELECT line_no, global_step, cls, round(ce::DOUBLE, 5) AS ce FROM l WHERE rs <= 5 AND cls <> 2 ORDER BY ce DESC, line_no LIMIT 500""")
def feature_selector(spark: SparkSession, d: str) -> DataFrame:
    """The feature selection query: join, class, thresholds by OR, first per text, per-step limit, sort, limit."""
    s = S.first_per(table(spark, d, "samples").select("line_no", "sample_idx", F.col("ce_ref_seq_mean").alias("ce"), F.col("entropy_seq_mean").alias("ent")), "line_no", ["sample_idx"])
    r = table(spark, d, ROLL).select("line_no", "global_step", "reward_seq_sum", "response_text").join(s, "line_no")
    c = r.withColumn("cls", P.record_class([], F.col("reward_seq_sum"))).where(P.thresholds(ge=["ce:1.2"], le=["ent:0.3"], how="or"))
    x = S.limit_per(S.first_per(c, "response_text", ["line_no"]), "global_step", ["line_no"], 5).where("cls <> 2")
    return S.sort_limit(x, "ce:desc", ["line_no"], 500).select("line_no", "global_step", "cls", F.round(F.col("ce").cast("double"), 5).alias("ce"))


@query(f"SELECT line_no, dense_rank() OVER (ORDER BY uid) - 1 AS prompt_group_index, row_number() OVER (PARTITION BY uid ORDER BY line_no) - 1 AS repeat_index, count(*) OVER (PARTITION BY uid) AS val_n FROM {ROLL} WHERE uid IS NOT NULL")
def validation_records(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql.window import Window

    from rollweave.operators.batch import with_index

    r = table(spark, d, ROLL).where("uid is not null").select("line_no", "uid")
    groups = with_index(r.select("uid").distinct(), ["uid"], "prompt_group_index").select("uid", "prompt_group_index")
    w = Window.partitionBy("uid")
    return r.join(groups, "uid").select("line_no", "prompt_group_index", (F.row_number().over(w.orderBy("line_no")) - 1).cast("bigint").alias("repeat_index"), F.count("*").over(w).alias("val_n"))


@query(f"SELECT count(*) AS total, count(*) FILTER (WHERE filter_state = 'kept') AS kept, count(*) FILTER (WHERE filter_state <> 'kept') AS dropped, count(*) FILTER (WHERE filter_state = 'kept' AND reward_seq_sum > 0 AND NOT isnan(reward_seq_sum)) AS kept_correct FROM {ROLL}")
def scan_counts(spark: SparkSession, d: str) -> DataFrame:
    from rollweave.sources.jsonl import scan_counts as scan

    kept = F.col("filter_state") == "kept"
    return scan(table(spark, d, ROLL).select("filter_state", "reward_seq_sum"), kept, P.guarded("reward_seq_sum", "gt", 0))


@query(f"SELECT line_no, CASE filter_state WHEN 'kept' THEN 'kept' WHEN 'dropped' THEN 'dropped' ELSE 'other' END AS route FROM {ROLL}")
def split_kept_dropped(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("filter_state")
    return table(spark, d, ROLL).select("line_no", F.when(s == "kept", "kept").when(s == "dropped", "dropped").otherwise("other").alias("route"))


@query()
def token_balanced_partitions(spark: SparkSession, d: str) -> DataFrame:
    return S.balanced(sequences(spark, d, True).withColumn("batch", F.floor(F.col("k") / 64)), "batch", "k", "len", 8)


@query()
def dynamic_micro_batches(spark: SparkSession, d: str) -> DataFrame:
    return S.micro_batches(sequences(spark, d, True).withColumn("batch", F.floor(F.col("k") / 64)), "batch", "k", "len", 40)


@query(f"WITH {SEQ}, p AS (SELECT k % 8 AS part, sum(len) AS s FROM s GROUP BY 1) SELECT min(s)::BIGINT AS min, max(s)::BIGINT AS max, round(avg(s), 6) AS mean FROM p")
def seqlen_unbalance(spark: SparkSession, d: str) -> DataFrame:
    s = sequences(spark, d, True).withColumn("part", F.col("k") % 8)
    return S.imbalance(s, "part", "len").select("min", "max", r6("mean").alias("mean"))


@query()
def weighted_resample(spark: SparkSession, d: str) -> DataFrame:
    """As many draws, with replacement, as the table has rows."""
    s = sequences(spark, d)
    return S.resample(s, "k", S.pf_weights(F.col("score")), s.count(), 42).select("draw", "k")


@query("SELECT CAST(window_start AS TIMESTAMP) AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM (SELECT date_trunc('day', ts) AS window_start, event_type, value FROM events) GROUP BY 1, 2")
def event_windows(spark: SparkSession, d: str) -> DataFrame:
    """Addition: event-time windows, which the reference lacks; the streaming form is in ``streaming.online``."""
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), r6(F.avg("value")).alias("mean")).select(F.col("w.start").alias("start"), "event_type", "n", "mean")
