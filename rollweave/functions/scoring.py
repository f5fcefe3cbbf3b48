"""Answer scoring: extraction and comparison of final answers.

Regular extraction is built in; nested braces and LaTeX repair run as Arrow UDFs over distinct pairs of a batch.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

NUMBER = r"(-?[0-9.,]+)"


def last_match(c: Column, pattern: str, group: int = 1) -> Column:
    """Group of the last match; null where there is none."""
    all_ = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(pattern), F.lit(group))
    return F.when(F.size(all_) > 0, F.element_at(all_, -1))


def gsm8k_answer(c: Column, strict: bool = True, tail: int = 300) -> Column:
    """The number after the last '####' of the last ``tail`` characters, without commas and dollars; else, if not strict, the last number."""
    end = F.right(c, F.lit(tail))
    if strict:
        return F.translate(last_match(end, r"#### (-?[0-9.,]+)"), ",$", "")
    nums = F.filter(F.regexp_extract_all(F.coalesce(end, F.lit("")), F.lit(NUMBER), F.lit(1)), lambda x: ~x.isin("", "."))
    return F.when(F.size(nums) > 0, F.element_at(nums, -1))


def gsm8k_score(c: Column, truth: Column, strict: bool = True, format_score: float = 0.0, score: float = 1.0) -> Column:
    """0 without an answer, ``score`` for the right one, ``format_score`` for another."""
    a = gsm8k_answer(c, strict)
    return F.when(a.isNull(), 0.0).when(a == truth, score).otherwise(format_score)


def gsm8k_gold(c: Column) -> Column:
    return F.translate(F.regexp_extract(c, r"#### (-?[0-9.,]+)", 1), ",", "")


def qa_normal(c: Column) -> Column:
    """Lower case, no ASCII punctuation, no articles, single blanks."""
    x = F.regexp_replace(F.lower(c), r"[!-/:-@\[-`{-~]", "")
    x = F.regexp_replace(x, r"\b(a|an|the)\b", " ")
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def exact_match(pred: Column, golds: Column) -> Column:
    p = qa_normal(pred)
    return F.coalesce(F.exists(golds, lambda g: qa_normal(g) == p), F.lit(False))


def contained_match(pred: Column, golds: Column) -> Column:
    p = qa_normal(pred)
    return F.coalesce(F.exists(golds, lambda g: p.contains(qa_normal(g))), F.lit(False))


def tagged_answer(c: Column) -> Column:
    """Text of the last <answer> tag, trimmed; null without one."""
    return F.trim(last_match(c, r"(?s)<answer>(.*?)</answer>"))


def tagged_score(c: Column, golds: Column, format_score: float = 0.0, score: float = 1.0, most_tags: int = 10) -> Column:
    """As ``gsm8k_score`` on the tagged answer by exact match; more than ``most_tags`` tags quarter the score."""
    a = tagged_answer(c)
    n = F.greatest(F.regexp_count(c, F.lit("<answer>")), F.regexp_count(c, F.lit("</answer>")))
    return F.when(a.isNull(), 0.0).when(exact_match(a, golds), F.when(n > most_tags, score / 4).otherwise(score)).otherwise(format_score)


def choice_letter(c: Column) -> Column:
    """A to E: after 'Answer:', 'answer is:' or 'answer is', else the last line that is one letter."""
    first = lambda p: F.when(F.coalesce(c, F.lit("")).rlike(p), F.upper(F.regexp_extract(c, p, 1)))
    line = last_match(c, r"(?m)^\s*([A-E])\s*$")
    return F.coalesce(first(r"(?i)answer\s*:\s*([A-E])"), first(r"(?i)answer is\s*:\s*([A-E])"), first(r"(?i)answer is\s+([A-E])\b"), line)


def minerva_answer(c: Column) -> Column:
    """What follows the last 'Answer:' on its line."""
    return last_match(c, r"(?i)Answer\s*:\s*([^\n]+)")


def last_boxed(text: str | None) -> str | None:
    """Content of the last \\boxed{...}, braces matched; null without one or where it never closes."""
    if not text:
        return None
    at = text.rfind("\\boxed{")
    if at < 0:
        return None
    depth = 0
    for i in range(at + 6, len(text)):
        depth += (text[i] == "{") - (text[i] == "}")
        if not depth:
            return text[at + 7 : i]
    return None


@F.pandas_udf(Ty.StringType())
def boxed(s: pd.Series) -> pd.Series:
    return s.map(last_boxed)


#: Words and commands that say nothing about the value of a final answer.
UNIT_WORDS = frozenset(
    "square ways integers dollars mph inches hours km units sue points feet minutes digits cents degrees cm gm pounds meters meals edges students childrentickets multiples m s th".split()
)
SPACING = frozenset((r"\!", r"\,", r"\;", r"\:", "\\ ", "\\\n", r"\left", r"\right"))
ORNAMENTS = frozenset((r"\ldots", r"\dots", r"\$", "$", '"'))
FRACTIONS = frozenset((r"\frac", r"\dfrac", r"\tfrac"))
WRAPPERS = frozenset((r"\text", r"\mbox", r"\textbf", r"\overline", r"\mathrm", r"\boxed"))

LATEX_RE = re.compile(r"\\[a-zA-Z]+|\\(?s:.)|(?s:.)")
Node = str | list


def latex_tree(text: str) -> list[Node]:
    """Commands and single characters, with a list for each braced group. A brace without partner is an ordinary character."""
    open_: list[list[Node]] = [[]]
    for t in LATEX_RE.findall(text):
        if t == "{":
            open_.append([])
        elif t == "}" and len(open_) > 1:
            group = open_.pop()
            open_[-1].append(group)
        else:
            open_[-1].append(t)
    while len(open_) > 1:
        rest = open_.pop()
        open_[-1] += ["{", *rest]
    return open_[0]


def _written(form: _Latex, text: str) -> str:
    """The text in that form; one whose braces nest too deep for an answer stays as it is."""
    try:
        return form.write(latex_tree(text))
    except RecursionError:
        return text


class _Latex:
    """Writes a tree in one form: fractions and roots with braces, no degree signs, dropped commands and, where ``unwrap``, no
    text commands. Where not, a text that begins with a blank is a unit and ends the answer."""

    def __init__(self, dropped: frozenset[str], unwrap: bool):
        self.dropped, self.unwrap = dropped, unwrap

    def argument(self, nodes: list[Node], i: int) -> tuple[str, int]:
        while i < len(nodes) and nodes[i] == " ":
            i += 1
        if i == len(nodes):
            return "", i
        n = nodes[i]
        if isinstance(n, str) and n in FRACTIONS:
            x, j = self.command(nodes, i)
            return x, j
        return (self.write(n) if isinstance(n, list) else n), i + 1

    def command(self, nodes: list[Node], i: int) -> tuple[str, int]:
        n = nodes[i]
        if n in FRACTIONS:
            if i + 1 == len(nodes):
                return r"\frac", i + 1
            up, j = self.argument(nodes, i + 1)
            down, j = self.argument(nodes, j)
            return rf"\frac{{{up}}}{{{down}}}", j
        if n == r"\sqrt":
            if i + 1 < len(nodes) and nodes[i + 1] == "[":
                return n, i + 1
            x, j = self.argument(nodes, i + 1)
            return rf"\sqrt{{{x}}}", j
        if n in WRAPPERS and self.unwrap and i + 1 < len(nodes) and isinstance(nodes[i + 1], list):
            return " " + self.write(nodes[i + 1]) + " ", i + 2
        return n, i + 1

    def write(self, nodes: list[Node]) -> str:
        out, i = [], 0
        while i < len(nodes):
            n = nodes[i]
            after = nodes[i + 1] if i + 1 < len(nodes) else None
            if isinstance(n, list):
                out.append("{" + self.write(n) + "}")
                i += 1
            elif n == "^" and after in (r"\circ", [r"\circ"]):
                i += 2
            elif n in self.dropped:
                i += 1
            elif n == r"\text" and not self.unwrap and isinstance(after, list) and after[:1] == [" "]:
                break
            else:
                x, i = self.command(nodes, i)
                out.append(x)
        return "".join(out)


_ANSWER = _Latex(SPACING | ORNAMENTS, True)
_PLAIN = _Latex(SPACING | {r"\$", r"\%", "%", "\n"}, False)
WORD_RE = re.compile(r"(?<![\\a-zA-Z])[a-zA-Z]+")


@lru_cache(65536)
def final_answer(answer: str) -> str:
    """Normal form of a final answer: the right side of an equation, the formula between dollars, without units, articles,
    text commands, spacing, a closing full stop and commas of thousands."""
    x = answer.rpartition("=")[2]
    formula = re.search(r"(?<!\\)\$([^$]+)(?<!\\)\$", x)
    x = _written(_ANSWER, formula[1] if formula else x)

    def word(m: re.Match) -> str:
        w = m[0].lower()
        if w == "and":
            return ","
        article = w in ("a", "an") and x[m.end() : m.end() + 1].isspace()
        return "" if article or w in UNIT_WORDS and len(x) > len(w) else m[0]

    x = re.sub(r",+", ",", re.sub(r"\s+", "", WORD_RE.sub(word, x)))
    x = x.replace("{,}", ",").strip(".,^")
    bare = x.replace(",", "")
    return bare if re.fullmatch(r"-?\d+(\.\d+)?", bare) and re.fullmatch(r"-?\d{1,3}(,\d{3})+(\.\d+)?", x) else x


@lru_cache(65536)
def latex_normal(s: str) -> str:
    """Normal form of a LaTeX answer: one fraction command with braces, no spacing, units, degrees or percent signs, no short
    left side, whole quotients as fractions, numbers with a digit before the point."""
    x = _written(_PLAIN, s.replace("\\\\", "\\")).strip()
    left, eq, right = x.partition("=")
    if eq and "=" not in right and len(left.strip()) <= 2:
        x = right
    x = re.sub(r"(?<![\d.])\.(?=\d)", "0.", x.replace(" ", ""))
    if x == "0.5":
        return r"\frac{1}{2}"
    quotient = re.fullmatch(r"(-?\d+)/(-?\d+)", x)
    return rf"\frac{{{int(quotient[1])}}}{{{int(quotient[2])}}}" if quotient else x


def _number(s: str) -> float | None:
    t = s.replace(",", "").replace("\\", "").strip()
    m = re.fullmatch(r"(-?)frac\{(-?[\d.]+)\}\{(-?[\d.]+)\}", t)
    try:
        return (-1 if m[1] else 1) * float(m[2]) / float(m[3]) if m else float(t.rstrip("%")) / (100 if t.endswith("%") else 1)
    except (ValueError, ZeroDivisionError):
        return None


def same_answer(a: str | None, b: str | None, tolerance: float = 1e-4) -> bool:
    """Equal in normal form, as numbers within a relative tolerance, or as tuples and intervals part by part."""
    if a is None or b is None:
        return False
    x, y = latex_normal(a.strip()), latex_normal(b.strip())
    if x == y:
        return True
    if len(x) > 2 and len(y) > 2 and x[0] in "([" and y[0] in "([" and x[-1] in ")]" and y[-1] in ")]":
        p, q = x[1:-1].split(","), y[1:-1].split(",")
        return x[0] + x[-1] == y[0] + y[-1] and len(p) == len(q) and len(p) > 1 and all(same_answer(i, j, tolerance) for i, j in zip(p, q))
    u, v = _number(x), _number(y)
    return u is not None and v is not None and abs(u - v) <= tolerance * max(1e-12, abs(v))


def _pairwise(f: Callable[[str | None, str | None], float]):
    @F.pandas_udf(Ty.DoubleType())
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        known: dict[tuple, float] = {}
        out = []
        for x, y in zip(a, b):
            if (x, y) not in known:
                known[x, y] = f(x, y)
            out.append(known[x, y])
        return pd.Series(out)

    return score


math_score = _pairwise(lambda s, g: float((b := last_boxed(s)) is not None and g is not None and latex_normal(b) == latex_normal(g)))
grade = _pairwise(lambda s, g: float(same_answer(last_boxed(s) if s and "\\boxed" in s else s, g)))
char_count_score = _pairwise(lambda s, g: float((b := last_boxed(s)) is not None and b == g))


def _dapo(s: str | None, g: str | None) -> float:
    found = re.findall(r"(?i)Answer\s*:\s*([^\n]+)", (s or "")[-300:])
    return 1.0 if found and g is not None and final_answer(found[-1]) == final_answer(g) else -1.0


dapo_score = _pairwise(_dapo)
strict_box_score = _pairwise(lambda s, g: 1.0 if s and last_boxed(s[-100:]) is not None and last_boxed(s[-100:]) == g else -1.0)


def verified_score(output: Column, truth: Column, timeout_score: float = 0.0) -> Column:
    """1 for the same answer, 0 for another, ``timeout_score`` where there is nothing to compare."""
    return F.when(output.isNull() | truth.isNull(), F.lit(timeout_score)).otherwise(grade(output, truth))


def geo3k_score(c: Column, truth: Column, format_weight: float = 0.1) -> Column:
    """0.9 accuracy of the boxed answer + 0.1 format (a full match of thinking followed by a boxed answer)."""
    fmt = F.coalesce(c, F.lit("")).rlike(r"(?s)^<think>.*</think>.*\\boxed\{.*\}.*$")
    return (1 - format_weight) * grade(c, truth) + format_weight * fmt.cast("double")


def overlong_penalty(length: Column, most: int, buffer: int, factor: float) -> Column:
    """0 up to most - buffer, then falling linearly to -factor and beyond."""
    return F.least(-(length - (most - buffer)) / buffer * factor, F.lit(0.0))


#: Scorers by data source: function of (response, truth).
SCORERS: dict[str, Callable[[Column, Column], Column]] = {
    "gsm8k": gsm8k_score,
    "math": math_score,
    "math_dapo": dapo_score,
    "char_count": char_count_score,
    "geo3k": geo3k_score,
    "commonsense_qa": lambda c, g: F.when(choice_letter(c) == F.upper(F.trim(g)), 1.0).otherwise(0.0),
    "qa": lambda c, g: tagged_score(c, F.array(g)),
}


def dispatch(source: Column, response: Column, truth: Column, by: dict[str, str], strict: bool = True) -> Column:
    """Score by data source; ``by`` names the scorer of each. A source without one raises, or gives null where not ``strict``."""
    out = F.lit(None).cast("double") if not strict else F.raise_error(F.concat(F.lit("no scorer for "), F.coalesce(source, F.lit("null")))).cast("double")
    for name, scorer in by.items():
        out = F.when(source == name, SCORERS[scorer](response, truth)).otherwise(out)
    return out


def on_last_token(score: Column, pos: Column, length: Column) -> Column:
    """The score on the last valid token of a sequence, 0 elsewhere."""
    return F.when(pos == length - 1, score).otherwise(0.0)
