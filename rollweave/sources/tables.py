"""Parquet sources of prompts, supervised texts, chats and preference pairs, and the row maps that build them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def parquet(spark: SparkSession, paths: str | Sequence[str], cols: Sequence[str] | None = None) -> DataFrame:
    """One or many files as one table; columns are pruned at the scan."""
    d = spark.read.parquet(*([paths] if isinstance(paths, str) else paths))
    return d.select(*cols) if cols else d


def probe(df: DataFrame) -> tuple[list[tuple[str, str]], int]:
    return df.dtypes, df.count()


def message(role: str, content: Column) -> Column:
    return F.struct(content.alias("content"), F.lit(role).alias("role"))


def to_prompts(df: DataFrame, question: str, answer: str, key: str, source: str, ability: str = "math", solution: str | None = None, split: str = "train", style: str = "rule") -> DataFrame:
    """Prompt rows of the fixed schema; rows without a question or answer are left out."""
    q, a = F.col(question), F.col(answer).cast("string")
    return df.where(q.isNotNull() & a.isNotNull() & (a != "NaN")).select(
        F.lit(source).alias("data_source"),
        F.array(message("user", q)).alias("prompt"),
        F.lit(ability).alias("ability"),
        F.struct(a.alias("ground_truth"), F.lit(style).alias("style")).alias("reward_model"),
        F.struct(F.col(key).cast("string").alias("index"), q.alias("raw_problem"), (F.col(solution) if solution else F.lit(None).cast("string")).alias("solution"), F.lit(source).alias("data_source")).alias("extra_info"),
        F.lit(split).alias("split"),
    )


def with_system(prompt: Column, text: str) -> Column:
    """A system message in front, unless there is one."""
    return F.when(F.exists(prompt, lambda m: m["role"] == "system"), prompt).otherwise(F.concat(F.array(message("system", F.lit(text))), prompt))


def preference_shapes(df: DataFrame, prompt: str, chosen: str, rejected: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three shapes of one source: supervised (both responses), pairs, prompts only."""
    sft = df.select(F.col(prompt).alias("prompt"), F.explode(F.array(chosen, rejected)).alias("response"))
    return sft, df.select(F.col(prompt).alias("prompt"), F.col(chosen).alias("chosen"), F.col(rejected).alias("rejected")), df.select(F.col(prompt).alias("prompt"))


def choices_prompt(question: Column, labels: Column, texts: Column) -> Column:
    """Question with its choices as 'A. text' lines."""
    lines = F.transform(F.arrays_zip(labels.alias("l"), texts.alias("t")), lambda z: F.concat(z["l"], F.lit(". "), z["t"]))
    return F.concat(question, F.lit("\n"), F.array_join(lines, "\n"))


def parse_dialogue(c: Column, first: str = "Human:", second: str = "Assistant:") -> Column:
    """'Human: ... Assistant: ...' text to role and content messages; text before the first marker is dropped."""
    marks = rf"(?s)(?:^|\n\n)\s*({first}|{second})(.*?)(?=\n\n\s*(?:{first}|{second})|$)"
    who = F.regexp_extract_all(c, F.lit(marks), F.lit(1))
    what = F.regexp_extract_all(c, F.lit(marks), F.lit(2))
    return F.transform(F.arrays_zip(who.alias("r"), what.alias("t")), lambda z: F.struct(F.when(z["r"] == first, "user").otherwise("assistant").alias("role"), F.trim(z["t"]).alias("content")))


def arena_comparisons(df: DataFrame, winner: str, a: str, b: str) -> DataFrame:
    """Decided comparisons of two chats of two messages or more that end with the assistant: prompt, both last messages, label A or B."""
    ok = lambda c: (F.size(c) >= 2) & (F.element_at(F.col(c), -1)["role"] == "assistant")
    d = df.where(F.col(winner).isin("model_a", "model_b") & ok(a) & ok(b))
    return d.select(F.element_at(F.col(a), 1)["content"].alias("prompt"), F.element_at(F.col(a), -1)["content"].alias("completion_a"), F.element_at(F.col(b), -1)["content"].alias("completion_b"), F.when(F.col(winner) == "model_a", "A").otherwise("B").alias("label"))


def tool_calls(c: Column, schema: str = "name string, arguments string") -> tuple[Column, Column]:
    """Calls in <tool_call> tags whose JSON parses, and the text without the tags."""
    raw = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(?s)<tool_call>(.*?)</tool_call>"), F.lit(1))
    calls = F.filter(F.transform(raw, lambda x: F.from_json(x, schema)), lambda x: x["name"].isNotNull())
    return calls, F.regexp_replace(c, r"(?s)<tool_call>.*?</tool_call>", "")


def unify_keys(df: DataFrame, rename: dict[str, str], drop: Sequence[str] = ()) -> DataFrame:
    return df.withColumnsRenamed(rename).drop(*drop)


def with_constant(df: DataFrame, key: str, value: object) -> DataFrame:
    return df.withColumn(key, F.lit(value))


def verified_io(df: DataFrame, io: str, question: str, prefix: str = "") -> DataFrame:
    """Programming tasks whose JSON of inputs and outputs parses and holds equally many of both, one or more: ``prompt``,
    ``inputs`` and ``outputs`` are added."""
    d = df.withColumn("_io", F.from_json(io, "inputs array<string>, outputs array<string>"))
    ok = (F.size("_io.inputs") > 0) & (F.size("_io.inputs") == F.size("_io.outputs"))
    return d.where(ok & F.col(question).isNotNull()).withColumns({"prompt": F.array(message("user", F.concat(F.lit(prefix), question))), "inputs": F.col("_io.inputs"), "outputs": F.col("_io.outputs")}).drop("_io")


def evaluation_rows(df: DataFrame, source: Column, question: Column, answer: Column, key: str, ability: str, split: str = "test", instruction: str = "") -> DataFrame:
    """One row shape for evaluation sets of different origin; union the results of several."""
    return df.select(
        source.alias("data_source"),
        F.array(message("user", F.concat(question, F.lit(instruction)))).alias("prompt"),
        F.lit(ability).alias("ability"),
        F.struct(answer.cast("string").alias("ground_truth"), F.lit("rule").alias("style")).alias("reward_model"),
        F.struct(F.lit(split).alias("split"), F.col(key).cast("string").alias("index")).alias("extra_info"),
    )


def search_rows(df: DataFrame, source: str, question: Column, answer: Column, key: str, split: str, system: str) -> DataFrame:
    """Rows of a question-answering task with a search tool: prompt, reward model, and the tool's arguments in extra_info."""
    tool = F.struct(F.struct(F.struct(answer.alias("ground_truth"), question.alias("question"), F.col(source).alias("data_source")).alias("create_kwargs")).alias("search"))
    return df.select(
        F.concat(F.lit("search_"), F.coalesce(source, F.lit("unknown"))).alias("data_source"),
        F.array(message("system", F.lit(system)), message("user", question)).alias("prompt"),
        F.struct(answer.alias("ground_truth"), F.lit("rule").alias("style")).alias("reward_model"),
        F.struct(F.col(key).alias("index"), F.lit(True).alias("need_tools_kwargs"), question.alias("question"), F.lit(split).alias("split"), tool.alias("tools_kwargs")).alias("extra_info"),
    )


def labelled_comparisons(df: DataFrame, prompt: Column, chosen: Column, rejected: Column) -> DataFrame:
    """Chosen and rejected answers as a comparison that A wins; rows without one of them are left out."""
    return df.where(chosen.isNotNull() & rejected.isNotNull()).select(prompt.alias("prompt"), chosen.alias("completion_a"), rejected.alias("completion_b"), F.lit("A").alias("label"))


def truncated_prompt(tokens: Column, most: int | None) -> Column:
    """The first ``most`` tokens of a prompt; all where there is no limit."""
    return tokens if most is None else F.slice(tokens, 1, most)
