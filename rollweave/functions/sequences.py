"""Functions over token arrays, all built in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pad(a: Column, length: int, value: object, left: bool = False) -> Column:
    """Padded to ``length``; longer arrays stay."""
    fill = F.array_repeat(F.lit(value), F.greatest(F.lit(length) - F.size(a), F.lit(0)))
    return F.concat(fill, a) if left else F.concat(a, fill)


def truncate(a: Column, length: int, how: str = "right") -> Column:
    """Cut to ``length`` at the right, left or middle; "error" raises on longer arrays."""
    n = F.size(a)
    if how == "right":
        cut = F.slice(a, 1, length)
    elif how == "left":
        cut = F.slice(a, n - length + 1, F.lit(length))
    elif how == "middle":
        head = length // 2
        cut = F.concat(F.slice(a, 1, head), F.slice(a, n - (length - head) + 1, F.lit(length - head)))
    elif how == "error":
        cut = F.when(n <= length, a).otherwise(F.raise_error(F.lit("array longer than allowed")).cast("array<bigint>"))
    else:
        raise ValueError(f"unknown truncation {how!r}")
    return F.when(n <= length, a).otherwise(cut) if how != "error" else cut


def fit(a: Column, length: int, value: object, left_pad: bool = True, how: str = "right") -> Column:
    return pad(truncate(a, length, how), length, value, left_pad)


def without_pad(ids: Column, attention: Column) -> Column:
    """Elements whose attention is 1."""
    return F.transform(F.filter(F.arrays_zip(ids.alias("i"), attention.alias("m")), lambda z: z["m"] == 1), lambda z: z["i"])


def response_mask(ids: Column, eos: int) -> Column:
    """1 up to and with the first end token, then 0; all 1 without one."""
    at = F.array_position(ids, eos)
    return F.transform(ids, lambda x, i: F.when((at == 0) | (i < at), 1).otherwise(0))


def loss_mask(prompt_len: Column, length: Column) -> Column:
    """0 on the prompt but its last position and on the last token, 1 between."""
    return F.transform(F.sequence(F.lit(0), length - 1), lambda i: F.when((i >= prompt_len - 1) & (i < length - 1), 1).otherwise(0))


def chat_loss_mask(df: DataFrame, conversation: str, turn: str, role: str, tokens: str) -> DataFrame:
    """Tokens of each conversation in turn order with a mask that is 1 on assistant turns only."""
    s = F.sort_array(F.collect_list(F.struct(turn, F.col(tokens).alias("t"), (F.col(role) == "assistant").cast("int").alias("m"))))
    d = df.groupBy(conversation).agg(s.alias("_s"))
    return d.select(conversation, F.flatten(F.transform("_s", lambda x: x["t"])).alias("tokens"), F.flatten(F.transform("_s", lambda x: F.transform(x["t"], lambda _: x["m"]))).alias("loss_mask"))


def shifted(a: Column) -> tuple[Column, Column]:
    """Input without the last and target without the first element."""
    n = F.greatest(F.size(a) - 1, F.lit(0))
    return F.slice(a, F.lit(1), n), F.slice(a, F.lit(2), n)


def preference_ids(prompt: Column, completion: Column, eos: int, length: int, value: int) -> Column:
    """prompt + completion + end token, cut or right-padded to ``length``."""
    return pad(F.slice(F.concat(prompt, completion, F.array(F.lit(eos))), 1, length), length, value)


def merge_turns(df: DataFrame, trajectory: str, turn: str, observation: str, action: str) -> DataFrame:
    """One row per run of turns whose observation extends what came before: tokens and action mask.

    A turn starts a new run where its observation does not begin with all tokens so far. A fold over the ordered turns.
    """
    turns = F.sort_array(F.collect_list(F.struct(turn, F.col(observation).alias("o"), F.col(action).alias("a"))))
    d = df.groupBy(trajectory).agg(turns.alias("_t"))
    kind = "array<struct<tokens:array<bigint>,mask:array<int>>>"
    start = F.array().cast(kind)

    def step(acc: Column, x: Column) -> Column:
        last = F.when(F.size(acc) > 0, F.element_at(acc, -1)).otherwise(F.struct(F.array().cast("array<bigint>").alias("tokens"), F.array().cast("array<int>").alias("mask")))
        n = F.size(last["tokens"])
        extends = (F.size(acc) > 0) & (F.size(x["o"]) >= n) & (F.slice(x["o"], F.lit(1), n) == last["tokens"])
        new = F.when(extends, F.slice(x["o"], n + 1, F.greatest(F.size(x["o"]) - n, F.lit(0)))).otherwise(x["o"])
        tokens = F.concat(new, x["a"]).cast("array<bigint>")
        mask = F.concat(F.transform(new, lambda _: F.lit(0)), F.transform(x["a"], lambda _: F.lit(1)))
        grown = F.struct(F.concat(last["tokens"], tokens).alias("tokens"), F.concat(last["mask"], mask).alias("mask"))
        fresh = F.struct(tokens.alias("tokens"), mask.alias("mask"))
        kept = F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
        return F.when(extends, F.concat(kept, F.array(grown))).otherwise(F.concat(acc, F.array(fresh))).cast(kind)

    return d.select(trajectory, F.posexplode(F.aggregate("_t", start, step)).alias("run", "_r")).select(trajectory, "run", "_r.tokens", "_r.mask")
