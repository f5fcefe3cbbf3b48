"""Text features as Column builders; Arrow UDFs only where no built-in says it (zlib, tandem repeats)."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from rollweave.functions.arrays import scan

#: Discourse markers by kind. German ones have no word boundary, so they match inside words as well.
SELF_REFLECT = (r"\bwait\b", r"\bwait a second\b", r"\bhold on\b", r"\bhang on\b", r"\blet me think\b", r"\bgive me a moment\b", r"\bjust a second\b", "等一下", "等一等", "先等等", "稍等", "moment mal", "einen moment", "подожди", "подождите", "секундочку")
CONTRAST = (r"\bhowever\b", r"\bbut\b", r"\bon the other hand\b", r"\bnevertheless\b", r"\bnonetheless\b", "但是", "然而", "不过", "另一方面", "doch", "aber", "jedoch", "однако")
CONCLUDE = (r"\bso\b", r"\btherefore\b", r"\bthus\b", r"\bhence\b", r"\bin conclusion\b", r"\bas a result\b", "所以", "因此", "综上", "由此可见", "itak", "итак", "значит")
WAIT_LIKE = (r"\bwait\b", r"\bhold on\b", r"\bhang on\b", "等一下", "稍等", "подожди", "подождите")


def has_any(c: Column, patterns: Sequence[str]) -> Column:
    """Unicode-aware, case-insensitive search; null gives false."""
    return F.coalesce(c.rlike("(?iuU)" + "|".join(patterns)), F.lit(False))


def markers(c: Column) -> Column:
    """Struct: mask (1 self-reflection, 2 contrast, 4 conclusion) and the flag of wait-like words."""
    flag = [has_any(c, p).cast("int") for p in (SELF_REFLECT, CONTRAST, CONCLUDE)]
    return F.struct((flag[0] + 2 * flag[1] + 4 * flag[2]).alias("mask"), has_any(c, WAIT_LIKE).cast("int").alias("wait_like"))


def words(c: Column) -> Column:
    """Words between Unicode white space; an empty array for blank texts."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), r"(?U)\s+"), lambda w: w != "")


def chars(c: Column) -> Column:
    return F.filter(F.split(F.coalesce(c, F.lit("")), ""), lambda x: x != "")


def longest_run(a: Column) -> Column:
    """Longest run of equal neighbours; 0 for an empty array. One fold, no explode."""
    start = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(s: Column, x: Column) -> Column:
        run = F.when(s["last"].eqNullSafe(x), s["run"] + 1).otherwise(1)
        return F.struct(x.alias("last"), run.alias("run"), F.greatest(s["best"], run).alias("best"))

    return F.aggregate(a, start, step)["best"]


def _over_counts(a: Column, step: Callable[[Column], Column]) -> Column:
    """Sum over the distinct values of the array of what their counts give: ``step(n)`` is what the n-th occurrence adds.

    One sort and one fold that keeps a number, so linear beside the sort.
    """
    start = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).alias("run"), F.lit(0.0).alias("total"))

    def add(s: Column, x: Column) -> Column:
        run = F.when(s["last"].eqNullSafe(x), s["run"] + 1).otherwise(1)
        return F.struct(x.alias("last"), run.alias("run"), (s["total"] + step(run)).alias("total"))

    return F.aggregate(F.array_sort(a), start, add)["total"]


def top_share(a: Column) -> Column:
    n = F.size(a)
    return F.when(n > 0, longest_run(F.array_sort(a)) / n).otherwise(0.0)


def unique_share(a: Column) -> Column:
    n = F.size(a)
    return F.when(n > 0, F.size(F.array_distinct(a)) / n).otherwise(0.0)


def trigram_repeat(a: Column) -> Column:
    """Share of word trigrams that occur more than once."""
    n = F.size(a)
    tri = F.when(n >= 3, F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.array_join(F.slice(a, i, 3), "\u0001"))).otherwise(F.array().cast("array<string>"))
    rep = _over_counts(tri, lambda k: F.when(k == 1, 0.0).when(k == 2, 2.0).otherwise(1.0))
    return F.when(n >= 3, rep / (n - 2)).otherwise(0.0)


def entropy_bits(a: Column) -> Column:
    """Shannon entropy per element, in bits: log n less the mean of n log n over the counts."""
    n = F.size(a)
    weighted = _over_counts(a, lambda k: F.when(k == 1, 0.0).otherwise(k * F.log2(k) - (k - 1) * F.log2(F.greatest(k - 1, F.lit(1)))))
    return F.when(n > 0, F.greatest(F.log2(n) - weighted / n, F.lit(0.0))).otherwise(0.0)


@F.pandas_udf(Ty.DoubleType())
def compress_ratio(s: pd.Series) -> pd.Series:
    """zlib level 6 size over UTF-8 size; 1 for empty texts, null for null."""
    return s.map(lambda t: None if t is None else len(zlib.compress(b, 6)) / len(b) if (b := t.encode("utf-8", "replace")) else 1.0)


def text_metrics(df: DataFrame, text: str, compress: bool = False) -> DataFrame:
    """Adds the character and word features of a text. Empty and null texts have zeros (ratio 1 for compression).

    Without words the word run falls back to the character run.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    d = df.withColumns({"_w": words(t), "_c": chars(t)})
    n = F.length(t)
    share = lambda x: F.when(n > 0, x / n).otherwise(0.0)
    run = longest_run(F.col("_c"))
    d = d.withColumns({
        "resp_char_len": n.cast("double"),
        "resp_byte_len": F.octet_length(t).cast("double"),
        "non_ascii_ratio": share(n - F.length(F.regexp_replace(t, r"[^\x00-\x7F]", ""))),
        "replacement_char_ratio": share(n - F.length(F.translate(t, "\ufffd", ""))),
        "control_private_unassigned_ratio": share(n - F.length(F.regexp_replace(t, r"\p{C}", ""))),
        "repeat_char_run_max": run.cast("double"),
        "repeat_word_run_max": F.when(F.size("_w") > 0, longest_run(F.col("_w"))).otherwise(run).cast("double"),
        "unique_word_ratio": unique_share(F.col("_w")),
        "top1_word_prop": top_share(F.col("_w")),
        "trigram_repeat_ratio": trigram_repeat(F.col("_w")),
        "char_entropy_bits_per_char": entropy_bits(F.col("_c")),
    })
    if compress:
        d = d.withColumn("compress_ratio", compress_ratio(t))
    return d.drop("_w", "_c")


def sections(c: Column) -> Column:
    """Pieces of a text, each with the line breaks that end it."""
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"[^\n]*\n+|[^\n]+"), F.lit(0))


def sentences(c: Column) -> Column:
    """Sentences of a section: up to and with the terminators and white space that follow; a section without one is one sentence."""
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(?s).+?(?:[.!?]+(?=\s|$)\s*|[。！？]+|$)"), F.lit(0))


def _offsets(pieces: Column) -> Column:
    """Where each piece of a text begins."""
    return scan(pieces, F.lit(0), lambda at, x: at + F.length(x), before=True)


def segments(df: DataFrame, key: str, text: str) -> DataFrame:
    """A row per sentence: section_idx, sent_idx (over the text), section_local_sent_idx, char_start, char_end, text, markers.

    A text is cut once and its offsets are summed up in one fold before it is exploded.
    """
    cut = lambda pieces: F.posexplode(F.arrays_zip(pieces.alias("s"), _offsets(pieces).alias("o")))
    s = df.select(key, sections(F.col(text)).alias("_all")).select(key, cut(F.col("_all")).alias("section_idx", "_z"))
    s = s.select(key, "section_idx", F.col("_z.o").alias("_o"), sentences(F.col("_z.s")).alias("_all"))
    e = s.select(key, "section_idx", "_o", cut(F.col("_all")).alias("section_local_sent_idx", "_z"))
    start, t = F.col("_o") + F.col("_z.o"), F.col("_z.s")
    e = e.select(key, "section_idx", "section_local_sent_idx", start.alias("char_start"), (start + F.length(t)).alias("char_end"), t.alias("text"))
    m = markers(F.col("text"))
    return e.select(key, "section_idx", "section_local_sent_idx", "char_start", "char_end", "text", m["mask"].alias("marker_mask"), m["wait_like"].alias("marker_wait_like"))


@F.pandas_udf(Ty.ArrayType(Ty.StructType([Ty.StructField("start", Ty.IntegerType()), Ty.StructField("end", Ty.IntegerType())])))
def aligned(texts: pd.Series, sentences_: pd.Series) -> pd.Series:
    """Where sentences whose white space was changed stand in their text, each behind the one before; null for one that isn't
    there. Punctuation and closing quotes right behind belong to the sentence."""

    def one(text: str | None, parts) -> list | None:
        if text is None or parts is None:
            return None
        solid = [(c, i) for i, c in enumerate(text) if not c.isspace()]
        flat = "".join(c for c, _ in solid)
        out, at = [], 0
        for p in parts:
            want = "".join(p.split()) if p else ""
            k = flat.find(want, at) if want else -1
            if k < 0:
                out.append(None)
                continue
            at = k + len(want)
            while at < len(flat) and flat[at] in TAIL_MARKS and solid[at][1] == solid[at - 1][1] + 1:
                at += 1
            out.append((solid[k][1], solid[at - 1][1] + 1))
        return out

    return pd.Series([one(t, p) for t, p in zip(texts, sentences_)], dtype=object)


#: Marks that close a sentence when they follow it directly.
TAIL_MARKS = frozenset(".!?。！？…\"'”’»)]")

#: A few function words of languages in Latin letters.
STOP_WORDS = {
    "en": ("the", "and", "of", "is", "to", "in", "that", "so", "we", "it"),
    "de": ("der", "die", "das", "und", "ist", "nicht", "wir", "also", "ein", "mit"),
    "fr": ("le", "les", "des", "et", "est", "une", "donc", "nous", "pour", "dans"),
    "es": ("el", "los", "las", "y", "es", "una", "por", "que", "como", "con"),
}
#: Scripts that name a language, asked in this order.
SCRIPTS = (("ja", r"[\x{3040}-\x{30FF}]"), ("ko", r"[\x{AC00}-\x{D7AF}]"), ("zh", r"[\x{4E00}-\x{9FFF}]"), ("ru", r"[\x{0400}-\x{04FF}]"))


def _count_in(ws: Column, known: Sequence[str]) -> Column:
    return F.size(F.filter(ws, lambda w: w.isin(*known)))


def guess_language(c: Column, least: int = 5) -> Column:
    """Language by script, where a tenth of the characters has it, else by function words; null for texts of fewer than
    ``least`` characters and where no function word occurs. Of equal counts the first language named wins. All on the JVM."""
    t = F.lower(F.trim(c))
    ws = F.split(t, r"[^\p{L}]+")
    counts = [_count_in(ws, s) for s in STOP_WORDS.values()]
    top = F.greatest(*counts)
    latin = F.when(top == 0, F.lit(None).cast("string"))
    for name, n in zip(STOP_WORDS, counts):
        latin = latin.when(n == top, name)
    out = F.when(F.length(t) < least, F.lit(None).cast("string"))
    for name, script in SCRIPTS:
        out = out.when(F.regexp_count(t, F.lit(script)) * 10 >= F.length(t), name)
    return F.when(c.isNotNull(), out.otherwise(latin))


def long_sentence_pieces(c: Column, most: int) -> Column:
    """A sentence longer than ``most`` characters cut after inner punctuation where possible, else at the limit."""
    return F.when(F.length(c) <= most, F.array(c)).otherwise(F.regexp_extract_all(c, F.lit(rf"(?s).{{1,{most - 1}}}[,;:，；：、]\s*|.{{1,{most}}}"), F.lit(0)))


def tandem_blocks(ids: np.ndarray, least: int = 1, most: int = 16) -> tuple[int, int]:
    """(blocks, length) of the tandem repetition with most blocks, a block being ``least`` to ``most`` tokens; (1, 0) without any.

    For each block size the tokens equal to the one a block earlier form runs; a run of r such tokens repeats r // size + 1 blocks.
    """
    best, n = (1, 0), len(ids)
    for k in range(least, min(most, n // 2) + 1):
        edge = np.flatnonzero(np.diff(np.concatenate(([0], (ids[k:] == ids[:-k]).astype(np.int8), [0]))))
        runs = edge[1::2] - edge[::2]
        if len(runs) and (blocks := int(runs.max()) // k + 1) > 1:
            best = max(best, (blocks, blocks * k))
    return best


_TOKEN_RE = re.compile(r"\w+|[^\w\s]")


@F.pandas_udf(Ty.StructType([Ty.StructField("blocks", Ty.IntegerType()), Ty.StructField("length", Ty.IntegerType())]))
def tandem_repeats(s: pd.Series) -> pd.DataFrame:
    """Blocks and token length of the longest tandem repetition of each text; null gives (1, 0)."""
    return pd.DataFrame([tandem_blocks(pd.factorize(np.array(_TOKEN_RE.findall(t), dtype=object))[0]) if t else (1, 0) for t in s], columns=["blocks", "length"])


@F.pandas_udf(Ty.ArrayType(Ty.IntegerType()))
def token_ids(s: pd.Series) -> pd.Series:
    """Numbers of the array's values in order of first appearance, from 0; a null value counts as one. Linear."""
    return s.map(lambda a: None if a is None else pd.factorize(np.asarray(a, dtype=object), use_na_sentinel=False)[0].astype(np.int32))


def neg_finite(c: Column) -> Column:
    """-x for finite numbers, else NaN."""
    ok = c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    return F.when(ok, -c).otherwise(float("nan"))


@F.pandas_udf(Ty.DecimalType(20, 0))
def salt64(s: pd.Series) -> pd.Series:
    """blake2b of eight bytes as an unsigned number."""
    from decimal import Decimal

    return s.map(lambda u: None if u is None else Decimal(int.from_bytes(hashlib.blake2b(u.encode(), digest_size=8).digest(), "big")))


def file_name(c: Column, most: int = 80) -> Column:
    """Characters other than letters, digits, dot, dash and underscore as _, cut to ``most``; EMPTY for nothing."""
    x = F.left(F.regexp_replace(F.coalesce(c, F.lit("")), r"[^0-9A-Za-z._-]", "_"), F.lit(most))
    return F.when(F.length(x) == 0, F.lit("EMPTY")).otherwise(x)


def snapshot_name(path: str) -> str:
    return "snap_" + re.sub(r"[^0-9A-Za-z]+", "_", path)
