"""Queries of the batch algebra, sources and array functions.

``supplier`` by key stands for a small batch, ``orders`` for a large one; positions come from the key order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollweave.functions import sequences as Q
from rollweave.operators import batch as B
from rollweave.operators import sampling as S
from rollweave.plans.registry import query
from rollweave.session import cut, table
from rollweave.sources import tables as T

ROLL = "filtered_random4by53"
ORD = "b AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS idx, o_orderkey AS k, o_custkey AS g, o_totalprice AS x FROM orders), n AS (SELECT count(*) AS n FROM b)"


def batch(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("g"), F.col("o_totalprice").alias("x"))
    return B.with_index(o, ["k"])


def _n(df: DataFrame) -> int:
    return df.count()


@query(f"WITH {ORD} SELECT idx, k FROM b")
def batch_select(spark: SparkSession, d: str) -> DataFrame:
    return batch(spark, d).select("idx", "k")


@query(f"WITH {ORD}, p AS (SELECT event_id AS pos, (event_id * 37) % 1000 AS idx FROM events) SELECT p.pos AS idx, k FROM p JOIN b USING (idx)")
def batch_gather(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "events").select(F.col("event_id").alias("pos"), ((F.col("event_id") * 37) % 1000).alias("idx"))
    return B.select_positions(batch(spark, d).select("idx", "k"), p).select("idx", "k")


@query(f"WITH {ORD} SELECT idx, k FROM b WHERE x > 200000")
def batch_mask(spark: SparkSession, d: str) -> DataFrame:
    return B.select_mask(batch(spark, d), F.col("x") > 200000).select("idx", "k")


@query(f"WITH {ORD} SELECT idx, k FROM b WHERE idx >= 5 AND idx < 10000 AND (idx - 5) % 3 = 0")
def batch_slice(spark: SparkSession, d: str) -> DataFrame:
    return B.slice_rows(batch(spark, d), 5, 10000, 3).select("idx", "k")


@query(f"WITH {ORD} SELECT idx, g AS grp FROM b")
def batch_pop_rename(spark: SparkSession, d: str) -> DataFrame:
    rest, popped = B.pop(batch(spark, d), ["g"])
    return B.rename(popped, ["g"], ["grp"])


@query(f"WITH {ORD} SELECT idx, k, g, x * 2 AS y FROM b")
def batch_union_columns(spark: SparkSession, d: str) -> DataFrame:
    b = cut(batch(spark, d), "batch")
    return B.union_columns(b.select("idx", "k", "g"), b.select("idx", "g", (F.col("x") * 2).alias("y"))).select("idx", "k", "g", "y")


@query(f"WITH {ORD} SELECT idx, k FROM b UNION ALL SELECT idx + n, k FROM b, n")
def batch_concat(spark: SparkSession, d: str) -> DataFrame:
    b = cut(batch(spark, d).select("idx", "k"), "batch")
    n = _n(b)
    return B.concat([b, b], [n, n])


@query(f"WITH {ORD} SELECT idx, CAST(floor(idx / ceil(n / 7.0)) AS BIGINT) AS chunk, CAST(idx // 64 AS BIGINT) AS piece, CAST(floor(((idx + 1) * 7 - 1) / n) AS BIGINT) AS part FROM b, n")
def batch_chunk_split(spark: SparkSession, d: str) -> DataFrame:
    b = cut(batch(spark, d).select("idx"), "batch")
    n = _n(b)
    return b.select("idx", B.chunk_id(n, 7).alias("chunk"), B.split_id(64).alias("piece"), B.split_list_id(n, 7).alias("part"))


@query(f"WITH {ORD} SELECT n - 1 - idx AS idx, k FROM b, n")
def batch_reorder(spark: SparkSession, d: str) -> DataFrame:
    b = cut(batch(spark, d).select("idx", "k"), "batch")
    return B.reorder(b, b.select((F.lit(_n(b) - 1) - F.col("idx")).alias("pos"), "idx")).select("idx", "k")


@query(f"WITH {ORD}, r AS (SELECT unnest(range(3)) AS c) SELECT idx * 3 + c AS idx, k FROM b, r")
def batch_repeat_interleave(spark: SparkSession, d: str) -> DataFrame:
    return B.repeat(batch(spark, d).select("idx", "k"), 3, 0, True)


@query(f"WITH {ORD}, r AS (SELECT unnest(range(3)) AS c) SELECT c * n + idx AS idx, k FROM b, r, n")
def batch_repeat_tile(spark: SparkSession, d: str) -> DataFrame:
    b = cut(batch(spark, d).select("idx", "k"), "batch")
    return B.repeat(b, 3, _n(b), False)


@query(f"WITH {ORD} SELECT idx, k, CAST(unnest(range(CAST(idx % 4 AS BIGINT))) AS INTEGER) AS copy FROM b")
def batch_repeat_each(spark: SparkSession, d: str) -> DataFrame:
    return B.repeat_each(batch(spark, d).select("idx", "k", (F.col("idx") % 4).cast("int").alias("c")), "c").select("idx", "k", "copy")


@query("SELECT vec_id * 4 + c AS idx, label, array_to_string(list_transform(list_slice(embedding, c * 16 + 1, c * 16 + 16), lambda x: CAST(CAST(round(x * 1000) AS INTEGER) AS VARCHAR)), ' ') AS piece FROM embeddings, (SELECT unnest(range(4)) AS c)")
def batch_unfold_columns(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("idx"), "label", "embedding")
    u = B.unfold_columns(e, 4, ["embedding"])
    return u.select("idx", "label", F.array_join(F.transform("embedding", lambda x: F.round(x.cast("double") * 1000).cast("int").cast("string")), " ").alias("piece"))


@query(f"WITH {ORD} SELECT idx, k FROM b UNION ALL SELECT n + idx, k FROM b, n WHERE idx < (64 - n % 64) % 64")
def batch_pad_to_divisor(spark: SparkSession, d: str) -> DataFrame:
    b = cut(batch(spark, d).select("idx", "k"), "batch")
    return B.pad_to_divisor(b, _n(b), 64)[0]


@query(f"WITH {ORD} SELECT idx, k FROM b")
def batch_unpad(spark: SparkSession, d: str) -> DataFrame:
    b = cut(batch(spark, d).select("idx", "k"), "batch")
    n = _n(b)
    padded, pad = B.pad_to_divisor(b, n, 64)
    return B.unpad(padded, n + pad, pad)


@query(f"WITH {ORD} SELECT idx, k FROM b UNION ALL SELECT n + c, k FROM b, n, (SELECT unnest(range(5)) AS c) WHERE idx = n - 1")
def batch_padding_last(spark: SparkSession, d: str) -> DataFrame:
    b = cut(batch(spark, d).select("idx", "k"), "batch")
    return B.padding(b, _n(b), 5, True)


@query(f"WITH {ORD} SELECT idx // 8 AS idx, string_agg(k::VARCHAR, ',' ORDER BY idx) AS ks FROM b GROUP BY idx // 8")
def batch_fold(spark: SparkSession, d: str) -> DataFrame:
    f = B.fold(batch(spark, d).select("idx", "k"), 8, ["k"])
    return f.select("idx", F.array_join(F.transform("rows", lambda r: r["k"].cast("string")), ",").alias("ks"))


@query(f"WITH {ORD} SELECT idx, k FROM b")
def batch_unfold(spark: SparkSession, d: str) -> DataFrame:
    return B.unfold(B.fold(batch(spark, d).select("idx", "k"), 8, ["k"]), 8).select("idx", "k")


@query()
def batch_minibatches(spark: SparkSession, d: str) -> DataFrame:
    return B.minibatches(batch(spark, d).select("idx", "k"), 32, 2, 1).select("epoch", "batch", "idx", "k")


@query(f"SELECT line_no, coalesce(gen_cfg.max_new_tokens, -1) AS max_new, coalesce(gen_cfg.temperature, 0e0) AS t FROM {ROLL}")
def nested_fields(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, ROLL).select("line_no", "gen_cfg")
    return r.select("line_no", B.nested(r, "gen_cfg.max_new_tokens", -1).alias("max_new"), B.nested(r, "gen_cfg.temperature", 0.0).alias("t"))


@query(f"SELECT line_no, gen_cfg.top_k AS top_k, CASE WHEN gen_cfg IS NULL THEN NULL ELSE 99 END AS n FROM {ROLL}")
def put_nested_field(spark: SparkSession, d: str) -> DataFrame:
    r = B.put_nested(table(spark, d, ROLL).select("line_no", "gen_cfg"), "gen_cfg.n", F.lit(99))
    return r.select("line_no", "gen_cfg.top_k", "gen_cfg.n")


@query(f'SELECT line_no, gen_cfg.temperature AS "gen_cfg/temperature", gen_cfg.top_k AS "gen_cfg/top_k" FROM {ROLL}')
def flatten_struct(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, ROLL).select("line_no", F.struct(F.col("gen_cfg.temperature"), F.col("gen_cfg.top_k")).alias("gen_cfg"))
    return B.flatten(r)


@query("SELECT o_orderkey AS k, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 32")
def sort_and_limit(spark: SparkSession, d: str) -> DataFrame:
    return S.sort_limit(table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), "o_orderstatus"), "k:asc", [], 32)


@query("SELECT 0 AS source, s_suppkey // 4 AS batch, s_suppkey AS k FROM supplier UNION ALL SELECT 1, n_nationkey // 4, n_nationkey FROM nation")
def interleave_datasets(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "supplier").select(F.col("s_suppkey").cast("bigint").alias("k"))
    b = table(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("k"))
    return S.interleave([a, b], "k", 4).select("source", "batch", "k")


@query("""WITH a AS (SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS k FROM supplier), b AS (SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS k FROM nation), m AS (SELECT least((SELECT count(*) // 3 FROM a), (SELECT count(*) // 2 FROM b)) AS m)
SELECT 0 AS source, k // 3 AS batch, k FROM a, m WHERE k // 3 < m UNION ALL SELECT 1, k // 2, k FROM b, m WHERE k // 2 < m""")
def composite_batches(spark: SparkSession, d: str) -> DataFrame:
    a = B.with_index(table(spark, d, "supplier").select("s_suppkey"), ["s_suppkey"], "k").select("k")
    b = B.with_index(table(spark, d, "nation").select("n_nationkey"), ["n_nationkey"], "k").select("k")
    return S.composite([a, b], "k", [3, 2]).select("source", "batch", "k")


@query("SELECT vec_id, label FROM embeddings UNION ALL SELECT event_id, NULL FROM events")
def concat_with_missing_columns(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", "label").unionByName(table(spark, d, "events").select(F.col("event_id").alias("vec_id")), allowMissingColumns=True)


@query(f"WITH r AS (SELECT line_no, prompt_text, row_number() OVER (PARTITION BY prompt_text ORDER BY line_no) AS rn FROM {ROLL}) SELECT line_no FROM r WHERE rn = 1")
def distinct_prompts(spark: SparkSession, d: str) -> DataFrame:
    return S.first_per(table(spark, d, ROLL).select("line_no", "prompt_text"), "prompt_text", ["line_no"]).select("line_no")


_TOKS = "t AS (SELECT l_orderkey AS seq, list(l_linenumber::BIGINT ORDER BY l_linenumber, l_partkey) AS a FROM lineitem GROUP BY 1)"


def _arrays(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("seq"), F.col("l_linenumber").cast("bigint").alias("x"), "l_partkey")
    s = F.sort_array(F.collect_list(F.struct("x", "l_partkey")))
    return li.groupBy("seq").agg(F.transform(s, lambda z: z["x"]).alias("a"))


def _text(c) -> object:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), " ")


@query(f"WITH {_TOKS} SELECT seq, array_to_string(a || list_resize([0::BIGINT], greatest(8 - len(a), 0), 0), ' ') AS rp, array_to_string(list_slice(a, 1, 3), ' ') AS rt, array_to_string(list_slice(a, greatest(len(a) - 2, 1), len(a)), ' ') AS lt FROM t")
def pad_truncate(spark: SparkSession, d: str) -> DataFrame:
    t = _arrays(spark, d)
    return t.select("seq", _text(Q.pad(F.col("a"), 8, 0)).alias("rp"), _text(Q.truncate(F.col("a"), 3)).alias("rt"), _text(Q.truncate(F.col("a"), 3, "left")).alias("lt"))


@query(f"WITH {_TOKS} SELECT seq, array_to_string(list_transform(a, lambda x, i: CASE WHEN list_position(a, 3) IS NULL OR list_position(a, 3) = 0 OR i <= list_position(a, 3) THEN 1 ELSE 0 END), ' ') AS mask, array_to_string(list_slice(a, 1, len(a) - 1), ' ') AS inp, array_to_string(list_slice(a, 2, len(a)), ' ') AS target FROM t")
def eos_mask_and_shift(spark: SparkSession, d: str) -> DataFrame:
    t = _arrays(spark, d)
    inp, target = Q.shifted(F.col("a"))
    return t.select("seq", _text(Q.response_mask(F.col("a"), 3)).alias("mask"), _text(inp).alias("inp"), _text(target).alias("target"))


@query(f"WITH {_TOKS} SELECT seq, array_to_string(list_transform(a, lambda x, i: CASE WHEN i - 1 >= 1 AND i - 1 < len(a) - 1 THEN 1 ELSE 0 END), ' ') AS m FROM t")
def sft_loss_mask(spark: SparkSession, d: str) -> DataFrame:
    return _arrays(spark, d).select("seq", _text(Q.loss_mask(F.lit(2), F.size("a"))).alias("m"))


@query("SELECT l_orderkey AS conv, string_agg(l_linenumber::VARCHAR, ' ' ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS toks, string_agg(CASE WHEN l_returnflag = 'A' THEN '1' ELSE '0' END, ' ' ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS m FROM lineitem GROUP BY 1")
def chat_loss_mask(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("conv"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("turn"), F.when(F.col("l_returnflag") == "A", "assistant").otherwise("user").alias("role"), F.array("l_linenumber").alias("tokens"))
    m = Q.chat_loss_mask(li, "conv", "turn", "role", "tokens")
    return m.select("conv", _text("tokens").alias("toks"), _text("loss_mask").alias("m"))


@query("SELECT extra_info.\"index\" AS idx, CASE WHEN list_contains(list_transform(prompt, lambda m: m.role), 'system') THEN len(prompt) ELSE len(prompt) + 1 END AS n, CASE WHEN list_contains(list_transform(prompt, lambda m: m.role), 'system') THEN prompt[1].content ELSE 'Be brief.' END AS first FROM train_prompts WHERE prompt IS NOT NULL AND len(prompt) > 0")
def add_system_template(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "train_prompts").where("prompt is not null and size(prompt) > 0")
    p = T.with_system(F.col("prompt"), "Be brief.")
    return t.select(F.col("extra_info.index").alias("idx"), F.size(p).alias("n"), F.element_at(p, 1)["content"].alias("first"))


@query(f"SELECT 'rollouts' AS data_source, prompt_text AS content, 'user' AS role, ground_truth, CAST(line_no AS VARCHAR) AS idx FROM {ROLL} WHERE prompt_text IS NOT NULL AND ground_truth IS NOT NULL AND ground_truth <> 'NaN'")
def convert_to_prompts(spark: SparkSession, d: str) -> DataFrame:
    p = T.to_prompts(table(spark, d, ROLL), "prompt_text", "ground_truth", "line_no", "rollouts")
    return p.select("data_source", F.col("prompt")[0]["content"].alias("content"), F.col("prompt")[0]["role"].alias("role"), "reward_model.ground_truth", F.col("extra_info.index").alias("idx"))


@query("SELECT extra_info.\"index\" AS idx, array_to_string(list_filter([CASE WHEN NOT coalesce(prompt IS NOT NULL AND len(prompt) > 0, false) THEN 'prompt' END, CASE WHEN NOT coalesce(length(trim(extra_info.solution)) > 0, false) THEN 'solution' END, CASE WHEN NOT coalesce(length(extra_info.raw_problem) >= 40, false) THEN 'too_short' END], lambda x: x IS NOT NULL), ',') AS errors FROM train_prompts")
def dataset_validation(spark: SparkSession, d: str) -> DataFrame:
    from rollweave.operators.filters import validation_errors

    rules = {"prompt": F.size("prompt") > 0, "solution": F.length(F.trim("extra_info.solution")) > 0, "too_short": F.length("extra_info.raw_problem") >= 40}
    return table(spark, d, "train_prompts").select(F.col("extra_info.index").alias("idx"), F.array_join(validation_errors(rules), ",").alias("errors"))


@query(f"SELECT line_no, CASE WHEN length(x) = 0 THEN 'EMPTY' ELSE x END AS file FROM (SELECT line_no, left(regexp_replace(coalesce(data_source, '__MISSING__'), '[^0-9A-Za-z._-]', '_', 'g'), 80) AS x FROM {ROLL})")
def sanitised_file_names(spark: SparkSession, d: str) -> DataFrame:
    from rollweave.functions.text import file_name

    return table(spark, d, ROLL).select("line_no", file_name(S.group_name("data_source")).alias("file"))


@query(f"SELECT line_no, prompt_len_tokens FROM {ROLL} WHERE prompt_len_tokens <= 60")
def overlong_prompt_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, ROLL).where("prompt_len_tokens <= 60").select("line_no", "prompt_len_tokens")


@query("SELECT o_orderstatus AS s, CAST(floor(o_totalprice / 1e5) AS BIGINT) AS b, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus, CAST(floor(o_totalprice / 1e5) AS BIGINT)), (o_orderstatus), ())")
def rollup_counts(spark: SparkSession, d: str) -> DataFrame:
    """Addition: grouping sets, which the reference lacks."""
    o = table(spark, d, "orders").select(F.col("o_orderstatus").alias("s"), F.floor(F.col("o_totalprice") / 1e5).alias("b"))
    return o.rollup("s", "b").agg(F.count("*").alias("n"))


@query(f"SELECT data_source, round(avg(reward_seq_sum), 4) AS m FROM {ROLL} WHERE isfinite(reward_seq_sum) GROUP BY 1")
def rollout_reward_means(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, ROLL).where(F.abs("reward_seq_sum") < float("inf"))
    return r.groupBy("data_source").agg((F.round(F.avg("reward_seq_sum"), 4)).alias("m"))


