"""Queries of sources, row maps, layouts, reward managers and reuse."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollweave.functions import bounds as B
from rollweave.functions import managers as M
from rollweave.functions import scoring as S
from rollweave.functions import text as T
from rollweave.operators import advantages as A
from rollweave.operators import aggregates as G
from rollweave.operators import batch as D
from rollweave.operators import filters as P
from rollweave.operators import layout as L
from rollweave.operators import sampling as Sa
from rollweave.plans.group_queries import SEQ, sequences
from rollweave.plans.registry import query, r6
from rollweave.plans.text_queries import _NUMS, ROLL
from rollweave.sources import jsonl
from rollweave.sources import tables as R
from rollweave.session import scratch_dir, table


def _fresh(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/rollweave/{name}-{uuid.uuid4().hex}"


# Sources


@query("SELECT extra_info.index AS idx, data_source, ability, reward_model.ground_truth AS truth, len(prompt) AS n_messages FROM train_prompts")
def prompt_scan(spark: SparkSession, d: str) -> DataFrame:
    p = R.parquet(spark, f"{d}/train_prompts.parquet", ["data_source", "prompt", "ability", "reward_model", "extra_info"])
    return p.select(F.col("extra_info.index").alias("idx"), "data_source", "ability", F.col("reward_model.ground_truth").alias("truth"), F.when(F.col("prompt").isNotNull(), F.size("prompt")).cast("bigint").alias("n_messages"))


@query(f"SELECT line_no, prompt_text AS prompt, response_text AS response FROM {ROLL} WHERE prompt_text IS NOT NULL AND response_text IS NOT NULL")
def supervised_scan(spark: SparkSession, d: str) -> DataFrame:
    r = R.parquet(spark, [f"{d}/{ROLL}.parquet"], ["line_no", "prompt_text", "response_text"]).dropna()
    return R.unify_keys(r, {"prompt_text": "prompt", "response_text": "response"})


@query("SELECT extra_info.index AS idx, unnest(range(len(prompt))) AS pos, unnest(list_transform(prompt, lambda m: m.role)) AS role, unnest(list_transform(prompt, lambda m: m.content)) AS content FROM train_prompts")
def chat_scan(spark: SparkSession, d: str) -> DataFrame:
    p = R.parquet(spark, f"{d}/train_prompts.parquet", ["prompt", "extra_info"])
    return p.select(F.col("extra_info.index").alias("idx"), F.posexplode("prompt").alias("pos", "m")).select("idx", F.col("pos").cast("bigint").alias("pos"), "m.role", "m.content")


@query("SELECT item_id, text AS prompt, answer AS completion_a, eval_set AS completion_b, 'A' AS label FROM eval_items WHERE answer IS NOT NULL AND eval_set IS NOT NULL")
def comparison_rows(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "eval_items")
    made = R.labelled_comparisons(e.withColumn("text", F.struct("item_id", "text")), F.col("text"), F.col("answer"), F.col("eval_set"))
    return made.select(F.col("prompt.item_id").alias("item_id"), F.col("prompt.text").alias("prompt"), "completion_a", "completion_b", "label")


_JSON_COLS = ("line_no", "uid", "response_text", "reward_seq_mean", "global_step")


@query(f"SELECT line_no, uid, response_text, CASE WHEN isnan(reward_seq_mean) THEN NULL ELSE reward_seq_mean END AS reward_seq_mean, global_step FROM {ROLL}")
def jsonl_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Written as JSON lines and read again with a fixed schema; NaN has no place in JSON and is written as null."""
    path = _fresh(spark, "jsonl")
    r = table(spark, d, ROLL).select(*_JSON_COLS).withColumn("reward_seq_mean", F.when(~F.isnan("reward_seq_mean"), F.col("reward_seq_mean")))
    jsonl.write(r, path)
    return jsonl.read(spark, path, "line_no bigint, uid string, response_text string, reward_seq_mean double, global_step int").drop(jsonl.BAD)


@query("SELECT n_nationkey + 1 AS line_no, strlen('N' || n_nationkey || ' ' || n_name) AS length, sha256('N' || n_nationkey || ' ' || n_name) AS sha256 FROM nation")
def line_hashes(spark: SparkSession, d: str) -> DataFrame:
    path = _fresh(spark, "lines")
    table(spark, d, "nation").orderBy("n_nationkey").select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string"), F.lit(" "), "n_name").alias("value")).coalesce(1).write.text(path)
    return jsonl.line_hashes(spark, path).select(F.col("line_no").cast("bigint").alias("line_no"), F.col("length").cast("bigint").alias("length"), "sha256")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey = 6")
def fetch_line(spark: SparkSession, d: str) -> DataFrame:
    path = _fresh(spark, "lines")
    table(spark, d, "nation").orderBy("n_nationkey").select(F.to_json(F.struct("n_nationkey", "n_name")).alias("value")).coalesce(1).write.text(path)
    return jsonl.line(spark, path, 7).select(F.from_json("value", "n_nationkey bigint, n_name string").alias("j")).select("j.n_nationkey", "j.n_name")


@query(f"SELECT CASE WHEN data_source IS NULL THEN '__MISSING__' ELSE regexp_replace(data_source, '[^0-9A-Za-z._-]', '_', 'g') END AS bucket, count(*) AS n FROM {ROLL} GROUP BY 1")
def split_by_field(spark: SparkSession, d: str) -> DataFrame:
    path = _fresh(spark, "groups")
    jsonl.write_by_group(table(spark, d, ROLL).select("line_no", "data_source"), path, "data_source")
    return spark.read.schema("line_no bigint, bucket string").json(path).groupBy("bucket").agg(F.count("*").alias("n"))


# Row maps


@query("""SELECT item_id, 'Solve: ' || text AS prompt, 1::BIGINT AS n_inputs FROM eval_items WHERE length(text) % 5 <> 0 AND length(text) % 7 <> 0""")
def programming_tasks(spark: SparkSession, d: str) -> DataFrame:
    """Some JSON is broken (by the length of the text) and some has no output; both are left out."""
    io = F.concat(F.lit('{"inputs": ["'), F.col("item_id").cast("string"), F.when(F.length("text") % 5 == 0, '"').otherwise('"], "outputs": ['), F.when(F.length("text") % 7 == 0, "]}").otherwise('"1"]}'))
    v = R.verified_io(table(spark, d, "eval_items").withColumn("io", io), "io", "text", "Solve: ")
    return v.select("item_id", F.col("prompt")[0]["content"].alias("prompt"), F.size("inputs").cast("bigint").alias("n_inputs"))


@query("""SELECT 'eval_' || eval_set AS data_source, text || chr(10) || 'Answer:' AS content, 'math' AS ability, answer AS ground_truth, 'rule' AS style, 'test' AS split, item_id::VARCHAR AS idx FROM eval_items
UNION ALL SELECT 'prompts', prompt[1].content || chr(10) || 'Answer:', 'math', reward_model.ground_truth, 'rule', 'test', extra_info.index FROM train_prompts""")
def evaluation_rows(spark: SparkSession, d: str) -> DataFrame:
    e, t = table(spark, d, "eval_items"), table(spark, d, "train_prompts").withColumn("key", F.col("extra_info.index"))
    a = R.evaluation_rows(e, F.concat(F.lit("eval_"), "eval_set"), F.col("text"), F.col("answer"), "item_id", "math", instruction="\nAnswer:")
    b = R.evaluation_rows(t, F.lit("prompts"), F.col("prompt")[0]["content"], F.col("reward_model.ground_truth"), "key", "math", instruction="\nAnswer:")
    u = a.unionByName(b)
    return u.select("data_source", F.col("prompt")[0]["content"].alias("content"), "ability", "reward_model.ground_truth", "reward_model.style", "extra_info.split", F.col("extra_info.index").alias("idx"))


@query("""SELECT item_id AS idx, 'search_' || coalesce(eval_set, 'unknown') AS data_source, 'Use the tool.' AS system, text AS question, answer AS ground_truth, answer AS tool_truth, eval_set AS tool_source FROM eval_items""")
def search_rows(spark: SparkSession, d: str) -> DataFrame:
    s = R.search_rows(table(spark, d, "eval_items"), "eval_set", F.col("text"), F.col("answer"), "item_id", "test", "Use the tool.")
    tool = "extra_info.tools_kwargs.search.create_kwargs"
    return s.select(F.col("extra_info.index").alias("idx"), "data_source", F.col("prompt")[0]["content"].alias("system"), F.col("prompt")[1]["content"].alias("question"), "reward_model.ground_truth", F.col(f"{tool}.ground_truth").alias("tool_truth"), F.col(f"{tool}.data_source").alias("tool_source"))


_TOKENS = "t AS (SELECT l_orderkey AS k, list(l_partkey ORDER BY l_linenumber, l_partkey) AS toks FROM lineitem GROUP BY 1)"


@query(f"WITH {_TOKENS} SELECT k, array_to_string(toks[1:3], ',') AS toks FROM t")
def truncated_prompts(spark: SparkSession, d: str) -> DataFrame:
    c = L.collate(table(spark, d, "lineitem"), "l_orderkey", ["l_linenumber", "l_partkey"], ["l_partkey"])
    return c.select(F.col("l_orderkey").alias("k"), F.array_join(R.truncated_prompt(F.col("l_partkey"), 3).cast("array<string>"), ",").alias("toks"))


# Layout


@query("SELECT l_orderkey AS k, array_to_string(list(l_partkey ORDER BY l_linenumber, l_partkey, l_suppkey), ',') AS parts, array_to_string(list(l_suppkey ORDER BY l_linenumber, l_partkey, l_suppkey), ',') AS supps FROM lineitem GROUP BY 1")
def collated_batches(spark: SparkSession, d: str) -> DataFrame:
    c = L.collate(table(spark, d, "lineitem"), "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey"], ["l_partkey", "l_suppkey"])
    return c.select(F.col("l_orderkey").alias("k"), *[F.array_join(F.col(x).cast("array<string>"), ",").alias(y) for x, y in (("l_partkey", "parts"), ("l_suppkey", "supps"))])


@query("SELECT array_to_string(list(n_nationkey ORDER BY n_nationkey), ',') AS keys, array_to_string(list(n_name ORDER BY n_nationkey), ',') AS names FROM nation")
def columns_of_rows(spark: SparkSession, d: str) -> DataFrame:
    c = L.columns_of(table(spark, d, "nation"), ["n_nationkey"])
    return c.select(F.array_join(F.col("n_nationkey").cast("array<string>"), ",").alias("keys"), F.array_join("n_name", ",").alias("names"))


@query("SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS pos, l_partkey FROM lineitem")
def rows_of_columns(spark: SparkSession, d: str) -> DataFrame:
    c = L.collate(table(spark, d, "lineitem"), "l_orderkey", ["l_linenumber", "l_partkey"], ["l_partkey"])
    return L.rows_of(c.withColumnRenamed("l_orderkey", "k"), "k", ["l_partkey"]).withColumn("pos", F.col("pos").cast("bigint"))


@query("SELECT column_name AS name, CASE WHEN data_type IN ('BIGINT', 'INTEGER', 'DOUBLE') THEN 'tensor' ELSE 'object' END AS kind FROM information_schema.columns WHERE table_name = 'orders'")
def column_kinds(spark: SparkSession, d: str) -> DataFrame:
    kinds = L.column_kinds(table(spark, d, "orders"))
    return L.from_columns(spark, {"name": list(kinds), "kind": list(kinds.values())}, "name string, kind string")


@query("SELECT 'val/' || data_source AS key, global_step AS step, round(avg(score), 6) AS value FROM val_scores WHERE score IS NOT NULL AND NOT isnan(score) AND data_source IS NOT NULL GROUP BY 1, 2 UNION ALL SELECT 'n', global_step, count(*)::DOUBLE FROM val_scores GROUP BY 2")
def appended_metrics(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "val_scores")
    n = v.groupBy(F.lit("n").alias("key"), F.col("global_step").alias("step")).agg(F.count("*").cast("double").alias("value"))
    m = v.where("score is not null and not isnan(score) and data_source is not null").groupBy(F.col("data_source").alias("key"), F.col("global_step").alias("step")).agg(r6(F.avg("score")).alias("value"))
    return L.append_metrics(n, m, "val/")


@query("SELECT n_nationkey AS k, part, n_name || '-' || part AS name FROM nation, (SELECT unnest([0, 1]) AS part)")
def flat_mapped_rows(spark: SparkSession, d: str) -> DataFrame:
    f = lambda r: [{"k": r["n_nationkey"], "part": i, "name": f"{r['n_name']}-{i}"} for i in range(2)]
    return L.map_rows(table(spark, d, "nation").select("n_nationkey", "n_name"), f, "k bigint, part int, name string", flat=True)


@query(f"SELECT line_no, md5(response_text) AS digest, coalesce(length(response_text), -1) AS n FROM samples LEFT JOIN {ROLL} USING (line_no)")
def text_reattachment(spark: SparkSession, d: str) -> DataFrame:
    f = L.reattach(table(spark, d, "samples").select("line_no"), table(spark, d, ROLL), "line_no", ["response_text"])
    return f.select("line_no", F.md5("response_text").alias("digest"), F.coalesce(F.length("response_text"), F.lit(-1)).cast("bigint").alias("n"))


@query(f"""SELECT s.line_no, md5(r.response_text) AS digest, array_to_string(list_filter([CASE WHEN s.ce_ref_seq_mean > 0.6 AND NOT isnan(s.ce_ref_seq_mean) THEN 'ce' END, CASE WHEN s.entropy_seq_mean < 0.3 AND NOT isnan(s.entropy_seq_mean) THEN 'entropy' END], lambda x: x IS NOT NULL), ',') AS hits
FROM samples s LEFT JOIN {ROLL} r ON s.line_no = r.line_no WHERE s.valid = 1""")
def offline_filter(spark: SparkSession, d: str) -> DataFrame:
    """From feature rows to marked records with their texts, in one plan."""
    f = table(spark, d, "samples").where("valid = 1").select("line_no", "ce_ref_seq_mean", "entropy_seq_mean")
    m = P.mark_patterns(f, {"ce": P.guarded("ce_ref_seq_mean", "gt", 0.6), "entropy": P.guarded("entropy_seq_mean", "lt", 0.3)})
    return L.reattach(m, table(spark, d, ROLL), "line_no", ["response_text"]).select("line_no", F.md5("response_text").alias("digest"), F.array_join("hits", ",").alias("hits"))


@query("SELECT l_orderkey AS k, count(*) FILTER (WHERE l_quantity > 10 AND l_partkey % 7 IS DISTINCT FROM l_suppkey % 7) AS n_unequal FROM lineitem GROUP BY 1")
def unequal_tokens(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), (F.col("l_partkey") % 7).alias("a"), (F.col("l_suppkey") % 7).alias("b"), (F.col("l_quantity") > 10).cast("int").alias("m"))
    return t.groupBy("k").agg(L.unequal_tokens("a", "b", "m").alias("n_unequal"))


@query("SELECT l_orderkey AS k, round(CASE WHEN sum(l_discount) <> 0 THEN -sum(-l_extendedprice / 77777e0 * l_discount) / sum(l_discount) END, 6) AS nll FROM lineitem GROUP BY 1")
def mean_nll(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), (-F.col("l_extendedprice") / 77777.0).alias("lp"), F.col("l_discount").alias("w"))
    return t.groupBy("k").agg(r6(L.mean_nll("lp", "w")).alias("nll"))


@query("SELECT n_nationkey AS k, n_name || '!' AS name FROM nation")
def dispatched_parts(spark: SparkSession, d: str) -> DataFrame:
    n = D.with_index(table(spark, d, "nation"), ["n_nationkey"])
    shout = L.dispatch("dp_compute")(lambda p: p.withColumn("n_name", F.concat("n_name", F.lit("!"))))
    return shout(n, 4).select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))


@query("SELECT data_source, count(*) AS n FROM val_scores GROUP BY 1")
def reused_result(spark: SparkSession, d: str) -> DataFrame:
    path, calls = _fresh(spark, "reuse"), []

    def make() -> DataFrame:
        if calls:
            raise RuntimeError("made twice")
        calls.append(1)
        return table(spark, d, "val_scores").groupBy("data_source").agg(F.count("*").alias("n"))

    L.reuse(spark, path, make)
    return L.reuse(spark, path, make)


# Text


@query(f"""WITH x AS (SELECT line_no, response_text AS r, lower(trim(response_text)) AS t FROM {ROLL}),
w AS (SELECT *, regexp_split_to_array(t, '[^\\p{{L}}]+') AS ws FROM x),
c AS (SELECT *, {", ".join(f"len(list_filter(ws, lambda v: v IN ({', '.join(repr(y) for y in words)}))) AS {lang}" for lang, words in T.STOP_WORDS.items())} FROM w)
SELECT line_no, CASE WHEN r IS NULL OR length(t) < 5 THEN NULL {" ".join(f"WHEN len(regexp_extract_all(t, '{s}')) * 10 >= length(t) THEN '{n}'" for n, s in T.SCRIPTS)}
WHEN greatest(en, de, fr, es) = 0 THEN NULL {" ".join(f"WHEN {n} = greatest(en, de, fr, es) THEN '{n}'" for n in T.STOP_WORDS)} END AS lang FROM c""")
def guessed_language(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, ROLL).select("line_no", T.guess_language(F.col("response_text")).alias("lang"))


@query(f"SELECT line_no, len(list_filter(string_split(response_text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13)) <> '')) AS n, true AS in_order FROM {ROLL} WHERE response_text IS NOT NULL AND NOT regexp_matches(response_text, '[\\x0B\\x0C\\x1C-\\x1F\\x{{0085}}\\x{{00A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]')")
def aligned_sentences(spark: SparkSession, d: str) -> DataFrame:
    """Lines with changed white space are found again in their text, each behind the one before. Texts with blanks beyond
    ASCII are left to the tests, as SQL has no word for them."""
    r = table(spark, d, ROLL).select("line_no", "response_text").where("response_text is not null").where(~F.col("response_text").rlike(r"[\x0B\x0C\x1C-\x1F\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"))
    lines = F.filter(F.split("response_text", "\n"), lambda x: ~x.rlike(r"^[ \t\r]*$"))
    a = r.withColumn("_s", F.transform(lines, lambda x: F.regexp_replace(x, r"\s+", " "))).withColumn("a", T.aligned("response_text", "_s"))
    ok = F.forall(F.sequence(F.lit(0), F.greatest(F.size("a") - 1, F.lit(0))), lambda i: (F.size("a") == 0) | (F.get("a", i)["start"] < F.get("a", i)["end"]) & ((i == 0) | (F.get("a", i - 1)["end"] <= F.get("a", i)["start"])))
    return a.select("line_no", F.size("a").cast("bigint").alias("n"), ok.alias("in_order"))


# Scores

_STRICT = "regexp_extract_all(right(coalesce(response_text, ''), 300), '#### (-?[0-9.,]+)', 1)"


@query(f"SELECT line_no, round(s, 6) AS score, round(s + coalesce(least(-(response_len_tokens - 192) / 64e0 * 0.5e0, 0e0), 0e0), 8) + 0.0 AS reward FROM (SELECT line_no, response_len_tokens, CASE WHEN len({_NUMS}) = 0 THEN 0e0 WHEN ground_truth IS NOT NULL AND {_NUMS}[-1] = ground_truth THEN 1e0 ELSE 0.1e0 END AS s FROM {ROLL})")
def dapo_manager(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, ROLL).select("line_no", "response_text", "ground_truth", "response_len_tokens")
    m = M.score_records(r, "dapo", scorer=S.gsm8k_score(F.col("response_text"), F.col("ground_truth"), strict=False, format_score=0.1), length="response_len_tokens", most=256, buffer=64, factor=0.5)
    return m.select("line_no", r6("score").alias("score"), (F.round("reward", 8) + 0.0).alias("reward"))


@query(f"SELECT line_no, length(response_text)::DOUBLE AS score, coalesce(length(response_text), 0)::DOUBLE AS reward FROM {ROLL}")
def batch_manager(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, ROLL).select("line_no", "response_text")
    return M.score_records(r, "batch", cols=["response_text"], scorer=lambda p: p["response_text"].map(len, na_action="ignore")).drop("response_text")


@query(f"SELECT line_no, CASE WHEN response_text IS NULL OR ground_truth IS NULL THEN 0e0 WHEN contains(response_text, ground_truth) THEN 1e0 ELSE 0e0 END AS score FROM {ROLL}")
def prime_manager(spark: SparkSession, d: str) -> DataFrame:
    """Null texts raise in the scorer, which scores 0."""
    r = table(spark, d, ROLL).select("line_no", "response_text", "ground_truth")
    return M.score_records(r, "prime", cols=["response_text", "ground_truth"], scorer=lambda a, b: float(b in a)).select("line_no", "score")


@query(f"SELECT line_no, CASE WHEN lower(trim(data_source)) IN ('step_arith', 'step-arith') THEN CASE WHEN len({_STRICT}) = 0 THEN 0e0 WHEN replace(replace({_STRICT}[-1], ',', ''), '$', '') = ground_truth THEN 1e0 ELSE 0e0 END END AS score FROM {ROLL}")
def naive_manager(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, ROLL).withColumn("source", F.translate(F.lower(F.trim("data_source")), "-", "_"))
    return M.score_records(r, "naive", response="response_text", truth="ground_truth", source="source", by={"step_arith": "gsm8k"}).select("line_no", "score")


# Bounds


@query("SELECT l_orderkey, l_linenumber, true AS same, true AS ordered FROM lineitem")
def token_kl_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Bisection and Newton steps give the same bounds, on both sides of 1."""
    t = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (-F.col("l_extendedprice") / 20000.0).alias("lp"))
    (a, b), (c, e) = (B.token_kl_bounds(F.col("lp"), 0.05, s) for s in ("bisect", "newton"))
    near = lambda x, y: F.abs(x - y) <= 1e-6 * F.greatest(F.lit(1.0), F.abs(x))
    u = t.select("l_orderkey", "l_linenumber", a.alias("a"), b.alias("b"), c.alias("c"), e.alias("e"))
    return u.select("l_orderkey", "l_linenumber", (near(F.col("a"), F.col("c")) & near(F.col("b"), F.col("e"))).alias("same"), ((F.col("a") <= 1) & (F.col("b") >= 1)).alias("ordered"))


@query("SELECT l_orderkey, l_linenumber, true AS lower_on_edge, true AS upper_on_edge FROM lineitem")
def band_kl_edges(spark: SparkSession, d: str) -> DataFrame:
    """The bounds lie on the edge of the trust region, or at the end of the simplex where that is inside it."""
    t = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (-F.col("l_extendedprice") / 20000.0).alias("lp"))
    lo, up = B.token_kl_bounds(F.col("lp"), 0.05)
    p = B.probability(F.col("lp"))
    u = t.select("l_orderkey", "l_linenumber", p.alias("p"), lo.alias("lo"), up.alias("up"))
    on = lambda r: F.abs(B.divergence(B.f_kl, F.col("p"), r) - 0.05) < 1e-5
    top, bottom = B.saturation(F.col("p"), 0.05)
    return u.select("l_orderkey", "l_linenumber", (on(F.col("lo")) | bottom & (F.col("lo") == 0)).alias("lower_on_edge"), (on(F.col("up")) | top & (F.abs(F.col("up") * F.col("p") - 1) < 1e-9)).alias("upper_on_edge"))


# Invariants of what SQL cannot compute


@query("""WITH p AS (SELECT data_source, uid, count(*) AS n, avg(score) AS m, stddev_pop(score) AS s FROM val_scores WHERE score IS NOT NULL AND NOT isnan(score) GROUP BY 1, 2)
SELECT data_source, metric, round(avg(value), 6) + 0.0 AS value FROM (SELECT data_source, 'mean@' || n AS metric, m AS value FROM p UNION ALL SELECT data_source, 'std@' || n, s FROM p WHERE n > 1) GROUP BY 1, 2""")
def prompt_moments(spark: SparkSession, d: str) -> DataFrame:
    return G.prompt_moments(table(spark, d, "val_scores"), "data_source", "uid", "score").select("data_source", "metric", r6("value").alias("value"))


@query("WITH p AS (SELECT data_source, uid, count(*) AS n FROM val_scores WHERE score IS NOT NULL AND NOT isnan(score) GROUP BY 1, 2), k AS (SELECT data_source, n, unnest(list_distinct(list_filter([2, 4, 8, 16, n], lambda x: x <= n))) AS k FROM p WHERE n > 1) SELECT data_source, k, count(*) > 0 AS present, true AS in_order FROM k GROUP BY 1, 2")
def bootstrap_order(spark: SparkSession, d: str) -> DataFrame:
    """Of every source and size of resample: worst <= majority <= best."""
    m = G.validation_metrics(table(spark, d, "val_scores"), "data_source", "uid", "score", "pred", "repeat_index", draws=50)
    x = m.where("metric rlike '^(best|worst|maj)@[0-9]+/mean$'").select("data_source", F.regexp_extract("metric", "@([0-9]+)/", 1).cast("bigint").alias("k"), F.regexp_extract("metric", "^([a-z]+)@", 1).alias("what"), "value")
    p = x.groupBy("data_source", "k").pivot("what", ["best", "maj", "worst"]).agg(F.first("value"))
    return p.select("data_source", "k", F.col("best").isNotNull().alias("present"), ((F.col("worst") <= F.col("maj") + 1e-9) & (F.col("maj") <= F.col("best") + 1e-9)).alias("in_order"))


def _batches(spark: SparkSession, d: str) -> DataFrame:
    return sequences(spark, d, True).withColumn("batch", F.floor((F.col("k") - 1) / 64))


@query(f"WITH {SEQ} SELECT CAST(floor((k - 1) / 64) AS BIGINT) AS batch, count(*) AS n, CAST(sum(len) AS BIGINT) AS total, true AS balanced FROM s GROUP BY 1")
def partition_invariants(spark: SparkSession, d: str) -> DataFrame:
    """Every sequence of a batch is in one part, and the heaviest part exceeds the lightest by no more than the heaviest sequence."""
    b = Sa.balanced(_batches(spark, d), "batch", "k", "len", 4)
    per = b.groupBy("batch", "part").agg(F.sum("len").alias("s"), F.count("*").alias("n"), F.max("len").alias("top"))
    g = per.groupBy("batch").agg(F.sum("n").alias("n"), F.sum("s").cast("bigint").alias("total"), F.max("s").alias("hi"), F.min("s").alias("lo"), F.max("top").alias("top"), F.count("*").alias("parts"))
    return g.select("batch", "n", "total", ((F.col("hi") - F.when(F.col("parts") == 4, F.col("lo")).otherwise(0)) <= F.col("top")).alias("balanced"))


@query(f"WITH {SEQ} SELECT CAST(floor((k - 1) / 64) AS BIGINT) AS batch, count(*) AS n, CAST(sum(len) AS BIGINT) AS total, CAST(ceil(sum(len) / 64e0) AS BIGINT) AS parts FROM s WHERE len > 0 GROUP BY 1")
def micro_batch_invariants(spark: SparkSession, d: str) -> DataFrame:
    b = Sa.micro_batches(_batches(spark, d).where("len > 0"), "batch", "k", "len", 64)
    return b.groupBy("batch").agg(F.count("*").alias("n"), F.sum("len").cast("bigint").alias("total"), F.max(F.col("part") + 1).cast("bigint").alias("parts"))


@query(f"WITH {SEQ} SELECT count(*) AS n, 0::BIGINT AS foreign_rows, true AS heavier_more_often FROM s")
def resample_invariants(spark: SparkSession, d: str) -> DataFrame:
    """As many draws as rows, all of them rows of the table, and rows of above-median weight more often than the others."""
    s = sequences(spark, d).select("k", "score")
    n = s.count()
    r = Sa.resample(s, "k", Sa.pf_weights(F.col("score")), n, seed=3)
    mid = s.agg(F.median("score").alias("mid"))
    own = s.select(F.col("k").alias("own"))
    j = r.join(own, F.col("k") == F.col("own"), "left").crossJoin(F.broadcast(mid))
    return j.agg(F.count("*").alias("n"), F.count_if(F.col("own").isNull()).alias("foreign_rows"), (F.count_if(F.col("score") > F.col("mid")) > F.count_if(F.col("score") <= F.col("mid"))).alias("heavier_more_often"))


@query("SELECT epoch, batch, CASE WHEN batch < n // 256 THEN 256 ELSE n % 256 END AS size, true AS no_row_twice FROM (SELECT count(*) AS n FROM orders), (SELECT unnest([0, 1]) AS epoch), (SELECT unnest(range(0, (SELECT CAST(ceil(count(*) / 256) AS BIGINT) FROM orders))) AS batch)")
def minibatch_invariants(spark: SparkSession, d: str) -> DataFrame:
    m = D.minibatches(D.with_index(table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"]), 256, 2, 7)
    once = m.groupBy("epoch", "o_orderkey").agg(F.min("batch").alias("batch"), F.count("*").alias("c"))
    return once.groupBy("epoch", "batch").agg(F.count("*").alias("size"), (F.max("c") == 1).alias("no_row_twice"))


@query(f"SELECT line_no, len(list_filter(string_split(response_text, chr(10)), lambda x: true)) > 0 AS any_line, true AS covers FROM {ROLL} WHERE response_text <> ''")
def segment_invariants(spark: SparkSession, d: str) -> DataFrame:
    """The sentences of a text put together are the text, and their offsets follow each other without a gap."""
    r = table(spark, d, ROLL).select("line_no", "response_text").where("response_text <> ''")
    s = T.segments(r, "line_no", "response_text")
    g = s.groupBy("line_no").agg(F.sort_array(F.collect_list(F.struct("char_start", "char_end", "text"))).alias("z"))
    joined = F.array_join(F.transform("z", lambda x: x["text"]), "")
    follows = F.forall(F.sequence(F.lit(0), F.size("z") - 1), lambda i: F.get("z", i)["char_start"] == F.when(i == 0, 0).otherwise(F.get("z", i - 1)["char_end"]))
    # Both sides hold all texts; Spark counts a string as 20 bytes and would broadcast the sentences of a compressed table.
    return r.join(g.hint("merge"), "line_no", "left").select("line_no", (F.size("z") > 0).alias("any_line"), ((joined == F.col("response_text")) & follows).alias("covers"))


@query("SELECT l_orderkey AS k, round(avg(l_quantity), 6) AS mean FROM lineitem GROUP BY 1")
def group_statistics(spark: SparkSession, d: str) -> DataFrame:
    w = A.with_group(table(spark, d, "lineitem").select("l_orderkey", "l_quantity"), "l_orderkey", m=F.avg("l_quantity"))
    return w.groupBy(F.col("l_orderkey").alias("k")).agg(r6(F.max("m")).alias("mean"))
