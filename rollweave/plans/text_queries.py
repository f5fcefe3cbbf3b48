"""Queries of text features, scorers and embedding measures over the rollout tables and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollweave.functions import embeddings as E
from rollweave.functions import scoring as S
from rollweave.functions import text as T
from rollweave.operators import filters as P
from rollweave.plans.registry import query, r6
from rollweave.session import table

ROLL = "filtered_random4by53"


# RE2 knows word boundaries for ASCII only; letters and digits of any script are spelled out.
_EDGE = "[^\\p{L}\\p{N}_]"


def _unicode_edges(patterns: tuple[str, ...]) -> str:
    return "|".join(f"(^|{_EDGE}){p[2:-2]}($|{_EDGE})" if p.startswith("\\b") else p for p in patterns)


def _norm(x: str) -> str:
    bare = f"regexp_replace(lower({x}), '[!-/:-@\\[-`{{-~]', '', 'g')"
    for _ in range(2):
        bare = f"regexp_replace({bare}, '(^|{_EDGE})(a|an|the)($|{_EDGE})', '\\1 \\3', 'g')"
    return f"trim(regexp_replace({bare}, '\\s+', ' ', 'g'))"


def responses(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, ROLL).select("line_no", "response_text", "ground_truth")


@query(f"""WITH t AS (SELECT line_no, coalesce(response_text, '') AS s FROM {ROLL}) SELECT line_no, length(s)::DOUBLE AS resp_char_len, strlen(s)::DOUBLE AS resp_byte_len,
round(CASE WHEN length(s) > 0 THEN (length(s) - length(regexp_replace(s, '[^\\x00-\\x7F]', '', 'g'))) / length(s) ELSE 0 END, 6) AS non_ascii_ratio,
round(CASE WHEN length(s) > 0 THEN (length(s) - length(replace(s, chr(65533), ''))) / length(s) ELSE 0 END, 6) AS replacement_char_ratio FROM t""")
def text_lengths(spark: SparkSession, d: str) -> DataFrame:
    m = T.text_metrics(responses(spark, d), "response_text")
    return m.select("line_no", "resp_char_len", "resp_byte_len", r6("non_ascii_ratio").alias("non_ascii_ratio"), r6("replacement_char_ratio").alias("replacement_char_ratio"))


_W = f"w AS (SELECT line_no, list_filter(regexp_split_to_array(coalesce(response_text, ''), '[\\s\\x{{3000}}\\x{{00a0}}\\x{{2028}}\\x{{0085}}]+'), lambda x: x <> '') AS a FROM {ROLL})"


@query(f"""WITH {_W}, u AS (SELECT line_no, unnest(a) AS x FROM w), c AS (SELECT line_no, x, count(*) AS n FROM u GROUP BY 1, 2), s AS (SELECT line_no, count(*) AS d, max(n) AS top, sum(n) AS n FROM c GROUP BY 1)
SELECT w.line_no, round(coalesce(d / n, 0e0), 6) AS unique_word_ratio, round(coalesce(top / n, 0e0), 6) AS top1_word_prop FROM w LEFT JOIN s ON s.line_no = w.line_no""")
def word_stats(spark: SparkSession, d: str) -> DataFrame:
    m = responses(spark, d).withColumn("w", T.words(F.col("response_text")))
    return m.select("line_no", r6(T.unique_share(F.col("w"))).alias("unique_word_ratio"), r6(T.top_share(F.col("w"))).alias("top1_word_prop"))


@query(f"""WITH {_W}, g AS (SELECT line_no, unnest(list_transform(range(1, greatest(len(a) - 1, 1)), lambda i: array_to_string(list_slice(a, i, i + 2), chr(1)))) AS x, len(a) AS n FROM w WHERE len(a) >= 3),
c AS (SELECT line_no, x, count(*) AS k, max(n) AS n FROM g GROUP BY 1, 2), s AS (SELECT line_no, sum(CASE WHEN k > 1 THEN k ELSE 0 END) / (max(n) - 2) AS r FROM c GROUP BY 1)
SELECT w.line_no, round(coalesce(r, 0e0), 6) AS trigram_repeat_ratio FROM w LEFT JOIN s ON s.line_no = w.line_no""")
def trigram_repeat(spark: SparkSession, d: str) -> DataFrame:
    m = responses(spark, d).withColumn("w", T.words(F.col("response_text")))
    return m.select("line_no", r6(T.trigram_repeat(F.col("w"))).alias("trigram_repeat_ratio"))


@query(f"""WITH c AS (SELECT line_no, x, count(*) AS n FROM (SELECT line_no, unnest(string_split(response_text, '')) AS x FROM {ROLL} WHERE response_text <> '') GROUP BY 1, 2), s AS (SELECT line_no, n / sum(n) OVER (PARTITION BY line_no) AS p FROM c), e AS (SELECT line_no, -sum(p * log2(p)) AS h FROM s GROUP BY 1)
SELECT r.line_no, round(coalesce(h, 0e0), 5) + 0.0 AS entropy FROM {ROLL} r LEFT JOIN e ON e.line_no = r.line_no""")
def char_entropy(spark: SparkSession, d: str) -> DataFrame:
    return responses(spark, d).select("line_no", (F.round(T.entropy_bits(T.chars(F.col("response_text"))), 5) + 0.0).alias("entropy"))


@query(f"""WITH w AS (SELECT line_no, CASE WHEN len(a) > 0 THEN a ELSE string_split(t, '') END AS a FROM (SELECT line_no, coalesce(response_text, '') AS t, list_filter(regexp_split_to_array(coalesce(response_text, ''), '[\\s\\x{{3000}}\\x{{00a0}}\\x{{2028}}\\x{{0085}}]+'), lambda x: x <> '') AS a FROM {ROLL})), u AS (SELECT line_no, unnest(a) AS x, generate_subscripts(a, 1) AS i FROM w), g AS (SELECT line_no, x, i - row_number() OVER (PARTITION BY line_no, x ORDER BY i) AS isl FROM u), r AS (SELECT line_no, count(*) AS n FROM g GROUP BY line_no, x, isl), m AS (SELECT line_no, max(n) AS run FROM r GROUP BY 1)
SELECT w.line_no, CASE WHEN t.response_text IS NULL OR t.response_text = '' THEN 0 ELSE coalesce(run, 0) END AS run FROM w JOIN {ROLL} t USING (line_no) LEFT JOIN m ON m.line_no = w.line_no""")
def word_run_length(spark: SparkSession, d: str) -> DataFrame:
    """Longest run of a word; of a character in texts without words, 0 in empty ones."""
    m = responses(spark, d).select("line_no", T.words(F.col("response_text")).alias("w"), T.chars(F.col("response_text")).alias("c"))
    return m.select("line_no", F.when(F.size("w") > 0, T.longest_run(F.col("w"))).otherwise(T.longest_run(F.col("c"))).cast("bigint").alias("run"))


@query()
def full_text_metrics(spark: SparkSession, d: str) -> DataFrame:
    return T.text_metrics(responses(spark, d), "response_text", compress=True).drop("response_text", "ground_truth")


@query(f"SELECT line_no, regexp_matches(coalesce(response_text, ''), '[\\x{{3000}}-\\x{{303F}}\\x{{3400}}-\\x{{4DBF}}\\x{{4E00}}-\\x{{9FFF}}\\x{{F900}}-\\x{{FAFF}}]') AS zh FROM {ROLL}")
def contains_chinese(spark: SparkSession, d: str) -> DataFrame:
    return responses(spark, d).select("line_no", P.has_chinese(F.col("response_text")).alias("zh"))


@query(f"SELECT line_no, CAST(unnest(range(len(regexp_extract_all(coalesce(response_text, ''), '[^\\n]*\\n+|[^\\n]+')))) AS INTEGER) AS section_idx, unnest(regexp_extract_all(coalesce(response_text, ''), '[^\\n]*\\n+|[^\\n]+')) AS section FROM {ROLL}")
def section_split(spark: SparkSession, d: str) -> DataFrame:
    return responses(spark, d).select("line_no", F.posexplode(T.sections(F.col("response_text"))).alias("section_idx", "section"))


# The patterns are constants of the statement, so they are compiled once and not per row.
def _marked(patterns: tuple[str, ...]) -> str:
    return f"CAST(regexp_matches(t, '(?i){_unicode_edges(patterns)}') AS INTEGER)"


@query(f"SELECT line_no, {_marked(T.SELF_REFLECT)} + 2 * {_marked(T.CONTRAST)} + 4 * {_marked(T.CONCLUDE)} AS mask, {_marked(T.WAIT_LIKE)} AS wait_like FROM (SELECT line_no, coalesce(response_text, '') AS t FROM {ROLL})")
def discourse_markers(spark: SparkSession, d: str) -> DataFrame:
    m = T.markers(F.col("response_text"))
    return responses(spark, d).select("line_no", m["mask"].alias("mask"), m["wait_like"].alias("wait_like"))


@query()
def sentence_segments(spark: SparkSession, d: str) -> DataFrame:
    return T.segments(responses(spark, d), "line_no", "response_text")


@query()
def tandem_repetition(spark: SparkSession, d: str) -> DataFrame:
    t = T.tandem_repeats(F.col("response_text"))
    return responses(spark, d).select("line_no", t.alias("t")).select("line_no", "t.blocks", "t.length").withColumn("hit", (F.col("blocks") >= 16) & (F.col("length") >= 30))


@query("""SELECT line_no, array_to_string(list_filter([CASE WHEN ce_ref_seq_mean > 1.2 AND NOT isnan(ce_ref_seq_mean) THEN 'ce' END, CASE WHEN entropy_seq_mean < 0.3 AND NOT isnan(entropy_seq_mean) THEN 'entropy' END], lambda x: x IS NOT NULL), ',') AS hits,
NOT (coalesce(ce_ref_seq_mean > 1.2 AND NOT isnan(ce_ref_seq_mean), false) OR coalesce(entropy_seq_mean < 0.3 AND NOT isnan(entropy_seq_mean), false)) AS keep FROM samples""")
def pattern_mask(spark: SparkSession, d: str) -> DataFrame:
    m = P.mark_patterns(table(spark, d, "samples").select("line_no", "ce_ref_seq_mean", "entropy_seq_mean"), {"ce": P.guarded("ce_ref_seq_mean", "gt", 1.2), "entropy": P.guarded("entropy_seq_mean", "lt", 0.3)})
    return m.select("line_no", F.array_join("hits", ",").alias("hits"), "keep")


_NUMS = "list_filter(regexp_extract_all(right(coalesce(response_text, ''), 300), '(-?[0-9.,]+)'), lambda x: x <> '' AND x <> '.')"


@query(f"SELECT line_no, nullif(array_to_string(regexp_extract_all(right(coalesce(response_text, ''), 300), '#### (-?[0-9.,]+)', 1)[-1:], ''), '') AS strict, {_NUMS}[-1] AS flexible FROM {ROLL}")
def gsm8k_extract(spark: SparkSession, d: str) -> DataFrame:
    r = responses(spark, d)
    return r.select("line_no", S.last_match(F.right("response_text", F.lit(300)), r"#### (-?[0-9.,]+)").alias("strict"), S.gsm8k_answer(F.col("response_text"), strict=False).alias("flexible"))


@query(f"SELECT line_no, CASE WHEN len({_NUMS}) = 0 THEN 0e0 WHEN ground_truth IS NOT NULL AND {_NUMS}[-1] = ground_truth THEN 1e0 ELSE 0.1e0 END AS score FROM {ROLL}")
def gsm8k_flexible_score(spark: SparkSession, d: str) -> DataFrame:
    return responses(spark, d).select("line_no", S.gsm8k_score(F.col("response_text"), F.col("ground_truth"), strict=False, format_score=0.1).alias("score"))


@query(f"SELECT item_id, {_norm('text')} AS norm, {_norm('text')} LIKE '%' || {_norm('answer')} || '%' AS sub_em FROM eval_items")
def qa_normalise_em(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "eval_items")
    return e.select("item_id", S.qa_normal(F.col("text")).alias("norm"), S.contained_match(F.col("text"), F.array("answer")).alias("sub_em"))


@query(f"SELECT line_no, CASE WHEN regexp_matches(coalesce(response_text, ''), '(?i)answer\\s*:\\s*[^\\n]+') THEN regexp_extract_all(response_text, '(?i)answer\\s*:\\s*([^\\n]+)', 1)[-1] END AS answer FROM {ROLL}")
def last_answer_line(spark: SparkSession, d: str) -> DataFrame:
    return responses(spark, d).select("line_no", S.minerva_answer(F.col("response_text")).alias("answer"))


@query()
def math_boxed_score(spark: SparkSession, d: str) -> DataFrame:
    r = F.col("response_text")
    return responses(spark, d).select("line_no", S.boxed(r).alias("boxed"), S.math_score(r, F.col("ground_truth")).alias("math"), S.grade(r, F.col("ground_truth")).alias("grade"), S.dapo_score(r, F.col("ground_truth")).alias("dapo"), S.strict_box_score(r, F.col("ground_truth")).alias("strict_box"))


@query()
def scorer_dispatch(spark: SparkSession, d: str) -> DataFrame:
    """A row for every rollout, sources in any spelling; the score is null where the source has no scorer."""
    r = table(spark, d, ROLL).select("line_no", F.translate(F.lower(F.trim("data_source")), "-", "_").alias("source"), "response_text", "ground_truth")
    by = {"step_arith": "math_dapo", "grade_words": "math", "geo_sketch": "geo3k", "count_bench": "char_count"}
    return r.select("line_no", S.dispatch(F.col("source"), F.col("response_text"), F.col("ground_truth"), by, strict=False).alias("score"))


@query(f"SELECT line_no, round(least(-(response_len_tokens - (256 - 64)) / 64e0 * 0.5e0, 0e0), 6) + 0.0 AS penalty FROM {ROLL}")
def overlong_penalty(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, ROLL).select("line_no", r6(S.overlong_penalty(F.col("response_len_tokens"), 256, 64, 0.5)).alias("penalty"))


@query("""WITH p AS (SELECT label, vec_id, embedding AS e, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS q FROM embeddings),
s AS (SELECT label, sum(acos(greatest(-1, least(1, list_dot_product(e::DOUBLE[], q::DOUBLE[]))))) AS l, arg_min(e, vec_id) AS a, arg_max(e, vec_id) AS z FROM p GROUP BY label)
SELECT label, round(l / (acos(greatest(-1, least(1, list_dot_product(a::DOUBLE[], z::DOUBLE[])))) + 1e-4), 4) AS loopiness FROM s""")
def loopiness(spark: SparkSession, d: str) -> DataFrame:
    return E.loopiness(table(spark, d, "embeddings"), "label", "vec_id", "embedding").select("label", F.round("loopiness", 4).alias("loopiness"))


@query("""WITH g AS (SELECT a.label, a.vec_id, max(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])) AS m FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id GROUP BY 1, 2)
SELECT label, round(avg(CASE WHEN m >= 0.4e0 THEN 1e0 ELSE 0e0 END), 6) AS r_dup FROM g GROUP BY label""")
def dup_ratio(spark: SparkSession, d: str) -> DataFrame:
    m = E.sample_metrics(table(spark, d, "embeddings"), "label", ["vec_id"], "embedding", {"all": None}, most=100_000, dup=0.4)
    return m.select("label", r6("all_r_dup").alias("r_dup"))


@query()
def embedding_metrics(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").withColumn("marked", F.col("vec_id") % 3 == 0)
    m = E.sample_metrics(e, "label", ["vec_id"], "embedding", {"all": None, "marker": "marked"})
    return m.withColumn("rambling", E.rambling_score(F.lit(0.2), F.col("marker_r_dup"), F.col("marker_loopiness"), F.col("marker_plateau_len_max"), F.lit(0.1)))


@query("WITH e AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS isl FROM events), r AS (SELECT user_id, count(*) AS n FROM e GROUP BY user_id, event_type, isl) SELECT user_id, max(n) AS plateau FROM r GROUP BY 1")
def plateau_length(spark: SparkSession, d: str) -> DataFrame:
    return E.plateau(table(spark, d, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id", "event_type")
