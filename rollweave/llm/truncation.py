"""Texts cut off before their end (problem 3): a structural completeness check with a source baseline.

A stack automaton follows quotes, brackets, mark-up and formulas and tells what is open at the end;
table rows and list entries are held against their neighbours; broken multibyte sequences and escapes
are cuts. What ends without a terminator and without structural evidence is decided by the corpus: its
last words are complete if texts of the source (or all texts) close their last sentence with these words.
"""

from __future__ import annotations

import re
from collections import Counter
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollweave.llm import textkit as tk
from rollweave.llm import textstats as ts
from rollweave.session import cut

BROKEN_RE = re.compile(r"(?:�+|\\u[0-9a-fA-F]{0,3}|\\x[0-9a-fA-F]?|&#?\w{0,6}|%[0-9A-Fa-f]?|\\)$")
MARK_RE = re.compile(r"\[(?:cut|truncated|snip|\.\.\.|…)[^\]\n]*\]|<\|?(?:cut|truncated|end_?of_?text|eot)[^>\n]*>|\((?:cut|truncated)\)", re.I)
CLOSED_RE = re.compile(r"[.!?。！？][\"'”’»」』）)*_\]]*$")
OPEN_END_RE = re.compile(r"[,;:，；：、=+×*/^<({\[\-–—“„«\\|&]$")
STACK_RE = re.compile(r"```|\$\$|\$|[()\[\]{}“”„«»]|\\begin\{|\\end\{|<(/?)(table|tr|td|th|ul|ol|div)\b", re.I)
PAIRS = {")": "(", "]": "[", "}": "{", "”": "“", "»": "«"}
VALUE = r"[-+−]?(?:[a-zA-Z]\s*=\s*)?[-+−]?[\d.,/]*\d%?"
LABELS = r"(?:final\s+)?(?:answer|result|solution|antwort|ergebnis|lösung|réponse|résultat|respuesta|resultado|ответ|итог|результат|答案|答|结果|解)"
ANSWER_RE = re.compile(rf"(?:\*\*)?(?:{LABELS}\s*[:：=]?\s*)?(?:\*\*)?(?:=\s*)?(?:{VALUE}|\$\$?[^$]+\$\$?|\\boxed\{{.+\}})(?:\*\*)?[.。]?$", re.I)
LABEL_END_RE = re.compile(rf"(?:\*\*)?{LABELS}\s*[:：=]?$", re.I)
NUMBER_RE = re.compile(r"-?\d+(?:[.,]\d+)*")
TAIL_RE = re.compile(rf"\d+(?:[.,]\d+)*|[{tk.CJK}]|[^\W\d_{tk.CJK}]+|[^\w\s]")
KEY_TOKENS = 3


class Tail(NamedTuple):
    """state: none, complete, cut or open (for the corpus to decide; item where the text is a list); key: last words;
    closing: whether the text ends a sentence properly, so that its key serves as evidence; item_keys: ends of the
    earlier entries of a list."""

    state: str
    key: str | None
    closing: bool
    item_keys: tuple[str, ...]


NO_TAIL = Tail("none", None, False, ())


def tail_key(text: str) -> str:
    """The last words (characters, for Chinese), numbers as #, without the terminator."""
    size = 80
    while True:
        t = TAIL_RE.findall(text[-size:])
        while t and t[-1] in ".!?。！？\"'”’»)*`$":
            t.pop()
        han = bool(t) and bool(tk.CJK_RE.match(t[-1] if not t[-1][0].isdigit() else (t[-2] if len(t) > 1 else "a")))
        most = KEY_TOKENS + han
        # The first word of the stretch may be a part of one.
        if len(t) > most or size >= len(text):
            return " ".join("#" if x[0].isdigit() else x.lower() for x in t[-most:])
        size *= 4


def unmarked(core: str) -> str | None:
    """The text without the mark of a cut at its end; null where there is none."""
    if core.endswith(("…", "...")):
        return core.rstrip(".…").rstrip()
    at = core.rfind({"]": "[", ")": "(", ">": "<"}.get(core[-1], "\0"))
    return core[:at].rstrip() if at >= 0 and MARK_RE.fullmatch(core, at) else None


def open_structures(text: str) -> list[str]:
    """What the stack automaton finds open at the end of the text. Linear: ``depth`` tells without a search what the stack holds."""
    stack: list[str] = []
    depth: Counter[str] = Counter()

    def push(x: str) -> None:
        stack.append(x)
        depth[x] += 1

    def close(x: str) -> None:
        while (y := stack.pop()) != x:
            depth[y] -= 1
        depth[x] -= 1

    for m in STACK_RE.finditer(text):
        x = m[0]
        if x in ("```", "$$", "$"):
            if depth[x]:
                close(x)
            else:
                push(x)
        elif x[0] == "<":
            name = m[2].lower()
            if not m[1]:
                push(name)
            elif depth[name]:
                close(name)
        elif x == "\\begin{":
            push("env")
        elif x == "\\end{":
            if depth["env"]:
                close("env")
        elif x in PAIRS:
            o = PAIRS[x]
            if stack and (stack[-1] == o or o == "“" and stack[-1] == "„"):
                close(stack[-1])
        elif x == "“" and stack and stack[-1] == "„":
            close("„")
        else:
            push(x)
    return stack


def _row_cut(lines: list[str]) -> bool | None:
    """Whether the last line is a table row cut short; None when it is no table row."""
    x = lines[-1]
    if x.count("|") >= 1 and (x[0] == "|" or any(y[0] == "|" for y in lines[-3:-1])) or x[0] == "+" and ts.BORDER_RE.match(x) and len(x) > 4:
        before = next((y for y in reversed(lines[:-1]) if y[0] in "|+"), None)
        if before is None:
            return x[-1] not in "|+"
        if x[0] == "+" or before[0] == "+" and x[0] == "+":
            full = next((y for y in lines if y[0] == "+"), x)
            return len(x) < len(full)
        full = next((y for y in lines if y[0] == "|"), x)
        return x[-1] != "|" or x.count("|") < full.count("|")
    if ts.HTML_RE.search(x):
        return not x.lower().endswith(("</table>", "</tr>", "</tbody>"))
    if ts.latex_row(x) or len(lines) > 1 and ts.latex_row(lines[-2]) and "&" in lines[-2]:
        return not (x.startswith("\\end") or x.endswith("\\\\"))
    if len(lines) >= 3 and (c := ts._cells(lines[-2])) and ts._cells(lines[-3]) == c:
        d, n = c
        have = len(re.split(r"\s{2,}", x)) if d == "  " else x.count(d) + 1
        if have == 1 and not re.fullmatch(r"[\d.]{1,8}|[a-z]{1,12}", x):
            return None
        return have < n or (d != "  " and x.endswith(d))
    return None


def tail(text: str | None) -> Tail:
    """Structural state of a text's end. Null, blank and tag-only texts have none."""
    if not text:
        return NO_TAIL
    core = text.rstrip()
    while m := re.search(r"(?:<\|[^<>|\n]{1,40}\|>|</?(?:think|answer|s)>)$", core):
        core = core[: m.start()].rstrip()
    if not core:
        return NO_TAIL
    bare = unmarked(core)
    marked = bare is not None
    if bare is not None:
        core = bare
        if not core:
            return NO_TAIL
    last = core[core.rfind("\n") + 1 :].strip()
    if (core[-1] == "�" or core[-1] in "\\&%" or "\\" in last[-6:] or "&" in last[-8:]) and BROKEN_RE.search(core) and not core.endswith("\\\\"):
        return Tail("cut", None, False, ())
    lines = [y for y in (x.strip() for x in core.split("\n")) if y]
    listed = [x for x in lines if ts.BULLET_RE.match(x)]
    items = len(listed) >= 2 and len(listed) * 2 >= len(lines) - 1
    unclosed = open_structures(core) if re.search(r"[(\[{“„«$<`\\]", core) else []
    if unclosed:
        return Tail("cut", None, False, ())
    if CLOSED_RE.search(core):
        if marked and not core.endswith(("?", "!", ".", "。")):
            return Tail("cut", None, False, ())
        keys = tuple({tail_key(x) for x in listed[:-1]}) if items else ()
        return Tail("complete", tail_key(last) if not items else None, not items, keys)
    row = _row_cut(lines)
    if row is not None:
        return Tail("cut" if row or marked else "complete", None, False, ())
    if last.count("**") % 2 or last.startswith("$$") and not last.endswith("$$"):
        return Tail("cut", None, False, ())
    if ANSWER_RE.fullmatch(last):
        nums = NUMBER_RE.findall(last)
        if nums and len(lines) > 1 and not marked:
            before = next((x for y in reversed(lines[:-1]) if (x := NUMBER_RE.findall(y))), [])
            if before and before[-1] != nums[-1] and before[-1].startswith(nums[-1]) and CLOSED_RE.search(lines[-2]):
                return Tail("cut", None, False, ())
        return Tail("cut" if marked else "complete", None, False, ())
    if len(lines) > 1 and not marked and ts.KV_RE.match(last.lstrip("-*• ")) and ts.KV_RE.match(lines[-2].lstrip("-*• ")) and NUMBER_RE.search(last):
        return Tail("complete", None, False, ())
    if marked or LABEL_END_RE.fullmatch(last) and len(lines) > 1 or OPEN_END_RE.search(core):
        return Tail("cut", None, False, ())
    if items and ts.BULLET_RE.match(last):
        if sum(1 for x in listed[:-1] if CLOSED_RE.search(x)) * 2 > len(listed) - 1:
            return Tail("cut", None, False, ())
        own = {tail_key(x) for x in listed[:-1]}
        k = tail_key(last)
        return Tail("complete", None, False, tuple(own)) if k in own else Tail("item", k, False, tuple(own))
    parts = [p.strip() for p in (ts.SEP_RE.split(core) if len(lines) == 1 else lines)]
    if len(parts) >= 4 and sum(1 for p in parts[:-1] if ts.NUM_ITEM_RE.match(p) or ts.KV_RE.match(p)) * 4 >= 3 * (len(parts) - 1):
        kv = sum(1 for p in parts[:-1] if ts.KV_RE.match(p)) * 2 > len(parts)
        own = {tail_key(p) for p in parts[:-1]}
        if kv:
            return Tail("complete" if ts.KV_RE.match(parts[-1]) else "cut", None, False, ())
        k = tail_key(parts[-1])
        return Tail("complete", None, False, tuple(own)) if k in own else Tail("item" if ts.NUM_ITEM_RE.match(parts[-1]) else "cut", k, False, tuple(own))
    return Tail("open", tail_key(last), False, ())


TAIL_DDL = "state string, tail_key string, closing boolean, item_keys array<string>"


def closing_keys(tails: DataFrame, source: str, least: int = 2, least_share: float = 0.0005, source_share: float = 0.002) -> DataFrame:
    """(source, kind, tail_key) of keys that close texts (kind open) or list entries (kind item) of a source; under a
    null source those of all sources together.

    A key counts where ``least`` texts and ``least_share`` of those that close properly end with it (``source_share`` within
    a source, whatever its size). So there are at most 1 / least_share keys of a kind over all sources, broadcast by bound;
    those of the single sources grow with the number of sources and are joined by shuffle.
    """
    ends = tails.where("closing and tail_key <> ''").select(F.col(source).alias("src"), F.lit("open").alias("kind"), "tail_key")
    items = tails.where("size(item_keys) > 0").select(F.col(source).alias("src"), F.lit("item").alias("kind"), F.explode("item_keys").alias("tail_key")).where("tail_key <> ''")
    by_source = cut(ends.unionByName(items).groupBy("src", "kind", "tail_key").agg(F.count("*").alias("n")), "ends")
    every = by_source.groupBy("kind", "tail_key").agg(F.sum("n").alias("n")).withColumn("src", F.lit(None).cast("string"))

    def frequent(counts: DataFrame, share: float, by: list[str]) -> DataFrame:
        total = counts.groupBy(*by).agg(F.sum("n").alias("total"))
        kept = counts.where(F.col("n") >= least)
        j = kept.join(F.broadcast(total), by) if by == ["kind"] else kept.join(total, by)
        return j.where(F.col("n") >= F.col("total") * share).select("src", "kind", "tail_key")

    return frequent(by_source.where("src is not null"), source_share, ["src", "kind"]).unionByName(frequent(every, least_share, ["kind"]))


def at_limit(length: str, limit: str) -> Column:
    """Whether the generation stopped at its limit: tokens of the response against the most allowed; false where either is unknown."""
    return F.coalesce(F.col(length) >= F.col(limit), F.lit(False))


def mark_cut(tails: DataFrame, source: str, limited: str | None = None, salts: int = 16) -> DataFrame:
    """Adds ``is_cut`` to the rows of ``tails``: structurally cut, or open with last words that close no text (entry)
    of the source nor of the corpus. A null source is held against the corpus alone.

    ``limited`` may name a boolean column, true for texts whose generation stopped at its limit: their open ends must be
    closing words of their own source, those of the corpus do not suffice.

    Only open ends that the corpus doesn't settle are shuffled to the keys of their source, each key in ``salts`` parts.
    """
    keys = cut(closing_keys(tails.select(source, "closing", "tail_key", "item_keys"), source), "closing")
    own = keys.where("src is not null").select(F.col("src").alias(source), F.col("kind").alias("state"), "tail_key", F.lit(True).alias("closes_here"))
    own = own.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    every = keys.where("src is null").select(F.col("kind").alias("state"), "tail_key", F.lit(True).alias("closes"))
    j = tails.join(F.broadcast(every), ["state", "tail_key"], "left")
    settled = F.col("closes").isNotNull()
    if limited:
        settled &= ~(F.coalesce(F.col(limited), F.lit(False)) & F.col(source).isNotNull())
    asks = F.coalesce(F.col("state").isin("open", "item") & ~settled & F.col(source).isNotNull(), F.lit(False))
    salted = j.where(asks).withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    held = salted.join(own, [source, "state", "tail_key", "_salt"], "left").drop("_salt")
    j = held.unionByName(j.where(~asks).withColumn("closes_here", F.lit(None).cast("boolean")))
    shut = F.coalesce(F.col("closes_here"), settled, F.lit(False))
    return j.withColumn("is_cut", (F.col("state") == "cut") | F.col("state").isin("open", "item") & ~shut).drop("closes_here", "closes")
