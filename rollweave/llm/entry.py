"""Registered queries of the training-data operators, and the SQL to hold them against where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rollweave.llm import langid, leakage, mojibake, packing, pairs, sketch, textstats, truncation
from rollweave.session import cut, table

ROLLOUTS = "filtered_random4by53"


def source_name(c: str = "data_source") -> Column:
    """Data source in one spelling: lower case, without blanks at the ends, _ for -; null and blank stay null."""
    x = F.translate(F.lower(F.trim(F.col(c))), "-", "_")
    return F.when(x != "", x)


def _rollouts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, ROLLOUTS)


def _language_model(spark: SparkSession, d: str) -> langid.LanguageModel:
    return langid.train(spark, table(spark, d, "documents"))


def _pairs(spark: SparkSession, d: str, languages: bool) -> DataFrame:
    limited = truncation.at_limit("response_len_tokens", "gen_cfg.max_new_tokens").alias("limited")
    df = _rollouts(spark, d).select("line_no", "prompt_text", "response_text", source_name().alias("source"), limited)
    model = _language_model(spark, d) if languages else None
    return cut(pairs.pair_features(df, "line_no", "prompt_text", "response_text", ["source", "limited"], model), "pairs")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.defects(_pairs(spark, d, True), "line_no", "source", "limited")


def _text_stats(spark: SparkSession, d: str) -> DataFrame:
    """Statistics of every response, with the pair rules that exclude refusals and copies."""
    df = _rollouts(spark, d).select("line_no", "prompt_text", "response_text")
    return cut(textstats.text_statistics(df, "line_no", "response_text", {"unkind": ("prompt_text", pairs.refusal_or_copy)}), "stats")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    k = textstats.kinds(_text_stats(spark, d))
    return k.where((F.col("kind") != "prose") & ~F.col("unkind")).select("line_no", "kind")


def p2_text_statistics(spark: SparkSession, d: str) -> DataFrame:
    df = _rollouts(spark, d).select("line_no", "response_text")
    return textstats.describe(cut(textstats.text_statistics(df, "line_no", "response_text"), "stats"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    f = truncation.mark_cut(_pairs(spark, d, False), "source", "limited")
    return f.where(F.col("is_cut") & ~F.col("is_refusal")).select("line_no")


def p3_cut_share_by_source(spark: SparkSession, d: str) -> DataFrame:
    f = truncation.mark_cut(_pairs(spark, d, False), "source", "limited")
    is_cut = F.col("is_cut") & ~F.col("is_refusal")
    return f.groupBy("source").agg(F.count("*").alias("n_responses"), F.count_if(is_cut).alias("n_cut"), F.avg(is_cut.cast("double")).alias("cut_share"))


def _languages(spark: SparkSession, d: str) -> DataFrame:
    df = _rollouts(spark, d).select("line_no", "response_text")
    return langid.detect_languages(df, "line_no", "response_text", _language_model(spark, d))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return langid.mislabelled(_languages(spark, d), table(spark, d, "samples"), "line_no", "lang_main")


def p4_languages(spark: SparkSession, d: str) -> DataFrame:
    return _languages(spark, d).select("line_no", "lang", "conf", F.to_json("segments").alias("segments"))


PERCENTILES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)


def _p5_groups() -> dict[str, Column]:
    day = F.to_date(F.coalesce(F.try_to_timestamp("timestamp"), F.col("ingested_at")))
    return {"global_step": F.col("global_step"), "data_source": source_name(), "day": day}


def _p5_metrics() -> dict[str, Column]:
    tokens = F.when(F.col("response_len_tokens") >= 0, F.col("response_len_tokens"))
    return {"reward_seq_mean": F.col("reward_seq_mean"), "reward_seq_sum": F.col("reward_seq_sum"), "response_len_tokens": tokens}


def _p5_rows(spark: SparkSession, d: str) -> DataFrame:
    return _rollouts(spark, d).select("global_step", "data_source", "timestamp", "ingested_at", "reward_seq_mean", "reward_seq_sum", "response_len_tokens")


def p5_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles per step, source and day with their rank-error bound, from one pass."""
    return sketch.percentiles(_p5_rows(spark, d), _p5_groups(), _p5_metrics(), PERCENTILES)


def p5_days_merged(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of the whole table from the merged sketches of its days, held against exact ranks."""
    groups = {"day": _p5_groups()["day"]}
    days = cut(sketch.merge_sketches(sketch.partial_sketches(_p5_rows(spark, d), groups, _p5_metrics())), "days")
    whole = days.withColumns({"dim": F.lit("all"), "grp": F.lit("*"), "salt": F.abs(F.hash("grp")) % 32})
    est = cut(sketch.read_quantiles(sketch.merge_sketches(whole), PERCENTILES), "quantiles")
    r = sketch.rank_check(_p5_rows(spark, d), {"all": F.lit("*")}, _p5_metrics(), est)
    # A percentile is right if its rank lies among the exact ranks of the estimate, widened by the bound.
    ok = (F.col("low") - F.col("rank_error") <= F.col("p")) & (F.col("p") <= F.col("high") + F.col("rank_error"))
    return r.select("metric", "p", "n", "n_missing", ok.alias("within_bound"))


def _packed(spark: SparkSession, d: str) -> DataFrame:
    sizes = packing.token_counts(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text")
    return packing.pack(sizes, table(spark, d, "token_budgets"), "doc_id", "n_tokens", "budget_id", "capacity_tokens")


def p6_pack(spark: SparkSession, d: str) -> DataFrame:
    """Container, position and offset of every document, or piece of one, for each token budget."""
    return _packed(spark, d)


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    """Per budget: containers, tokens, unused share and the least number of containers that any packing needs."""
    caps = table(spark, d, "token_budgets").select("budget_id", "capacity_tokens").distinct()
    used = _packed(spark, d).groupBy("budget_id").agg(F.max("container").alias("last"), F.sum("n_tokens").alias("n_tokens"))
    n = F.col("last") + 1
    room = n * F.col("capacity_tokens")
    return used.join(F.broadcast(caps), "budget_id").select("budget_id", n.alias("n_containers"), "n_tokens", (1 - F.col("n_tokens") / room).alias("unused_share"), F.ceil(F.col("n_tokens") / F.col("capacity_tokens")).alias("least_containers"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_leaks(spark, d).where("leak = 'verbatim'").select("doc_id", "item_id")


def p7_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Documents with the items leaked into them, verbatim or re-parameterised, and the size of the longest passage (words;
    characters for Chinese)."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    return leakage.find_leaks(docs, table(spark, d, "eval_items"), "doc_id", "text", "item_id", "text")


def _repaired(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return mojibake.repair_texts(docs.select("doc_id", "text"), "doc_id", "text", mojibake.train(spark, docs))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _repaired(spark, d).where("garbled").select("doc_id")


def p8_restored(spark: SparkSession, d: str) -> DataFrame:
    """Garbled documents, the chain of wrong decodings and, where nothing was lost, the original text."""
    return _repaired(spark, d).where("garbled").select("doc_id", "chain", "restored")


def p1_null_responses(spark: SparkSession, d: str) -> DataFrame:
    """The defects of lines without a response: all empty, nothing else."""
    lines = _rollouts(spark, d).where("response_text is null").select("line_no")
    return p1_found(spark, d).join(lines, "line_no", "left_semi")


def p3_source_totals(spark: SparkSession, d: str) -> DataFrame:
    """Responses per source, whose counts of cut ones must lie between none and all."""
    s = p3_cut_share_by_source(spark, d)
    return s.select("source", "n_responses", F.col("n_cut").between(0, F.col("n_responses")).alias("within"))


def p6_fill_chars(spark: SparkSession, d: str) -> DataFrame:
    """The packing of texts by characters, whose totals SQL can say; no container may be over full or hold a gap inside."""
    sizes = table(spark, d, "documents").select("doc_id", F.length("text").alias("n"))
    caps = table(spark, d, "token_budgets").select("budget_id", "capacity_tokens").distinct()
    p = packing.pack(sizes, caps, "doc_id", "n", "budget_id", "capacity_tokens").join(caps, "budget_id")
    per = p.groupBy("budget_id", "capacity_tokens", "container").agg(F.sum("n_tokens").alias("s"), F.max(F.col("offset") + F.col("n_tokens")).alias("top"), F.count("*").alias("n"), F.count_if(F.col("n_tokens") == F.col("capacity_tokens")).alias("full"), F.max("position").alias("last"))
    ok = (F.col("s") <= F.col("capacity_tokens")) & (F.col("s") == F.col("top")) & (F.col("last") == F.col("n") - 1)
    g = per.groupBy("budget_id", "capacity_tokens").agg(F.sum("s").alias("n_chars"), F.sum("n").alias("n_pieces"), F.sum("full").alias("full_pieces"), F.every(ok).alias("well_filled"), F.count("*").alias("c"))
    least = F.ceil(F.col("n_chars") / F.col("capacity_tokens"))
    return g.select("budget_id", "n_chars", "n_pieces", "full_pieces", "well_filled", ((F.col("c") >= least) & (F.col("c") <= 1.05 * least + 2)).alias("near_least"))


def p7_whole_items(spark: SparkSession, d: str) -> DataFrame:
    """Of the leaks those whose document holds the item's text letter by letter."""
    docs, items = table(spark, d, "documents").select("doc_id", F.col("text").alias("t")), table(spark, d, "eval_items").select("item_id", F.col("text").alias("x"))
    return p7_found(spark, d).join(docs, "doc_id").join(items, "item_id").where(F.col("t").contains(F.col("x"))).select("doc_id", "item_id")


def p8_replacement_characters(spark: SparkSession, d: str) -> DataFrame:
    """Of the garbled documents those that hold a replacement character, for which nothing may count as restored."""
    docs = table(spark, d, "documents").where(F.col("text").contains("\ufffd")).select("doc_id")
    return p8_restored(spark, d).join(docs, "doc_id", "left_semi").select("doc_id", F.col("restored").isNull().alias("nothing_restored"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p2_found, p2_text_statistics, p3_found, p3_cut_share_by_source, p4_found, p4_languages, p5_percentiles, p5_days_merged, p6_pack, p6_fill, p7_found, p7_leaks, p8_found, p8_restored, p1_null_responses, p3_source_totals, p6_fill_chars, p7_whole_items, p8_replacement_characters)
}

_P5_UNPIVOT = " UNION ALL ".join(
    f"SELECT '{m}' AS metric, CAST({e} AS DOUBLE) AS v FROM {ROLLOUTS}"
    for m, e in (("reward_seq_mean", "reward_seq_mean"), ("reward_seq_sum", "reward_seq_sum"), ("response_len_tokens", "CASE WHEN response_len_tokens >= 0 THEN response_len_tokens END"))
)

SQL: dict[str, str] = {
    "p1_null_responses": f"SELECT line_no, 'empty' AS defect FROM {ROLLOUTS} WHERE response_text IS NULL",
    "p3_source_totals": f"SELECT nullif(replace(lower(trim(data_source)), '-', '_'), '') AS source, count(*) AS n_responses, true AS within FROM {ROLLOUTS} GROUP BY 1",
    "p6_fill_chars": """
        SELECT budget_id, CAST(sum(length(text)) AS BIGINT) AS n_chars, CAST(sum(ceil(length(text) / capacity_tokens)) AS BIGINT) AS n_pieces, CAST(sum(length(text) // capacity_tokens) AS BIGINT) AS full_pieces, true AS well_filled, true AS near_least
        FROM documents, (SELECT DISTINCT budget_id, capacity_tokens FROM token_budgets) WHERE length(text) > 0 GROUP BY budget_id
    """,
    "p7_whole_items": "SELECT DISTINCT doc_id, item_id FROM documents d JOIN eval_items e ON contains(d.text, e.text)",
    "p8_replacement_characters": "SELECT doc_id, true AS nothing_restored FROM documents WHERE contains(text, chr(65533))",
    "p5_days_merged": f"""
        WITH v AS ({_P5_UNPIVOT}),
        c AS (SELECT metric, count(*) FILTER (WHERE v IS NOT NULL AND NOT isnan(v)) AS n, count(*) FILTER (WHERE v IS NULL OR isnan(v)) AS n_missing FROM v GROUP BY metric)
        SELECT metric, CAST(p AS DOUBLE) AS p, n, n_missing, true AS within_bound
        FROM c CROSS JOIN (SELECT unnest([{", ".join(map(str, PERCENTILES))}]) AS p)
    """,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
