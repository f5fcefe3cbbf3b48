"""Broken prompt and response pairs (problem 1): empty, truncated, refusal, copy, other_language.

Ordered rules per pair; every triggered defect is emitted. Emptiness is decided first and excludes the
others; a copy is neither truncated nor in another language (a copied wrapper says nothing about the response);
junk (see the text statistics) is neither truncated nor in a language.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollweave.llm import langid as li
from rollweave.llm import textkit as tk
from rollweave.llm import textstats as ts
from rollweave.llm import truncation as tr

PLACEHOLDER_RE = re.compile(r"(?<![^\W_])(?:null|none|nil|nan|n/?a|undefined|tbd|todo)+(?![^\W_])|\[no (?:output|response|answer|content)\]|(?<![^\W_])no (?:output|response|answer|content)(?![^\W_])|\[?(?<![^\W_])empty(?![^\W_])\]?|\(?(?<![^\W_])blank(?![^\W_])\)?|&nbsp;|\\boxed\{\s*\}|\$\$?\s*\$\$?", re.I)
HTML_ANY_RE = re.compile(r"</?[a-zA-Z][^<>\n]{0,60}>|&[a-zA-Z]{2,8};|&#\d+;")
#: A label has its colon or ends its line; a row of bare label words is a loop.
EMPTY_LABEL_RE = re.compile(rf"{tr.LABELS}(?:\s*[:：=]|(?=(?:[^\w\n]|_)*$))", re.I | re.M)
ALNUM_RE = re.compile(r"[^\W_]+")
PLAIN_RE = re.compile(r"[^<&`\[\\$]*(?<=[\W_])")
#: Words that are a placeholder or label only together with their neighbours.
PART_WORDS = frozenset("final n a no output response answer content".split())


def is_empty(text: str | None) -> bool:
    """Null, blank, or nothing left beside mark-up, tags, answer labels, placeholders and invisible characters.

    A bare answer, be it one digit, is not empty; nor is a run of 30 symbols or more, which is junk.
    """
    if text is None:
        return True
    # Plain words before any mark-up settle most texts.
    start = PLAIN_RE.match(tk.TAG_RE.sub(" ", tk.INVISIBLE_RE.sub("", text[:400])))
    if start and any(_is_word(m[0]) for m in ALNUM_RE.finditer(start[0])):
        return False
    t = _bare(tk.INVISIBLE_RE.sub("", text))
    return not ALNUM_RE.search(t) and len(t.strip()) < 30


@lru_cache(65_536)
def _is_word(w: str) -> bool:
    """Whether a word can be no part of a placeholder or label."""
    return w.lower() not in PART_WORDS and bool(ALNUM_RE.search(_bare(w)))


def _bare(t: str) -> str:
    """The text without comments, tags, mark-up, entities, placeholders and, where something else is left, answer labels."""
    if "<!--" in t:
        t = _uncommented(t)
    t = tk.TAG_RE.sub(" ", t)
    t = re.sub(r"```\w*", " ", t)
    t = HTML_ANY_RE.sub(" ", t)
    t = PLACEHOLDER_RE.sub(" ", t)
    return EMPTY_LABEL_RE.sub(" ", t) if ALNUM_RE.search(t) else t


def _uncommented(t: str) -> str:
    """The text without ``<!-- -->``; one that isn't closed stays."""
    parts, at = [], 0
    while (a := t.find("<!--", at)) >= 0 and (b := t.find("-->", a + 4)) >= 0:
        parts.append(t[at:a])
        at = b + 3
    return " ".join([*parts, t[at:]])


#: Declining phrases by language; each entry is (what declines, what shows that the text goes on).
REFUSALS = (
    (r"\b(?:i|we|assistant)\b.*\b(?:can(?:no|['’])t|can not|could not|couldn['’]t|wo(?:n['’]t| not)|will not|am unable|am not able|must refrain|have to refrain|refrain from|have to decline|must decline|decline|rather not|not comfortable|not allowed|not permitted|not in a position)\b.*\b(?:help|assist|answer|answering|respond|comply|provide|complete|solve|solving|work|fulfil|request|task|question|exercise|problem|that|solution|discuss|share)\b"
     r"|\bi(?:['’]d| would) rather not\b|\bi (?:have to|must) (?:decline|refrain)\b|\b(?:isn['’]t|is not|not) possible for me\b|\bsomething i can(?:not|['’]t)\b",
     r"\bso i(?: will|['’]ll)?\b|\bbut (?:the|we|one|let)\b|\blet me\b|\btherefore\b|\binstead i\b|\bat a glance\b"),
    (r"(?:kann|darf|muss|möchte|werde|mir)\b.*(?:nicht (?:weiter)?helfen|nicht lösen|nicht beantworten|nicht bearbeiten|nicht bereitstellen|ablehnen|verweigern|nicht möglich|keine (?:lösung|antwort))", r"sofort|deshalb|daher|aber (?:wir|die|das)"),
    (r"(?:ne (?:peux|puis|pourrai|souhaite|suis) (?:pas|malheureusement)|m['’]est impossible|dois (?:décliner|refuser)|préfère ne pas)(?:.*(?:répondre|traiter|aider|résoudre|fournir|demande|exercice|en mesure))?", r"tout de suite|alors j|donc|mais (?:la|le|on|je peux)"),
    (r"(?:no (?:puedo|podré|podría|me es posible|estoy en condiciones)|debo (?:rechazar|declinar|abstenerme)|tengo que (?:rechazar|declinar)|prefiero no|me niego)(?:.*(?:ayudar|resolver|responder|solicitud|ejercicio|proporcionar|contestar|tarea))?", r"de inmediato|por eso|así que|pero (?:la|el|se)"),
    (r"(?:не (?:могу|смогу|вправе|в состоянии|буду)|прид[её]тся отказаться|вынужден\w* отказать|отказываюсь|невозможно)(?:.*(?:помочь|ответить|решить|решать|решение|запрос\w*|задач\w*|отвечать))?", r"поэтому|сразу|но (?:мы|это)"),
    (r"(?:无法|不能|不便|不可以|难以|恕不|不予)(?:为您|为你|给您|给你)?(?:回答|提供|协助|帮助|解答|作答|处理|完成)|拒绝(?:作答|回答)|超出了?我.{0,8}范围|恕难", r"所以|因此|逐个|但是?我们"),
    (r"(?:não (?:posso|poderei|consigo|me é possível)|devo recusar|prefiro não)(?:.*(?:ajudar|resolver|responder|exercício|pedido))?", r"de imediato|por isso|então"),
)
_REFUSALS = [(re.compile(a, re.I), re.compile(b, re.I)) for a, b in REFUSALS]
HINTS = ("n't", "n’t", "cannot", "can not", "could", "will not", "able to", "refrain", "declin", "déclin", "rather not", "possible", "allowed", "nicht", "ablehn", "verweig", "keine", "ne p", "ne s", "imposs", "refuser", "no p", "no me", "no est", "debo", "prefiero", "niego", "rechaz", "не ", "отказ", "невозм", "无法", "不能", "不便", "拒绝", "超出", "恕", "不予", "难以", "não", "recusar")


BOUND_RE = re.compile(r"[。！？\n]|[.!?…]\s")


def is_refusal(text: str) -> bool:
    """Whether the text ends by declining the task: a declining sentence, first person, after which nothing is solved.

    One that only hesitates, apologises or notes a difficulty and goes on is none.
    """
    text = text.rstrip()
    size, done = 150, len(text)
    while done > 0:
        # Sentences from the end on, in stretches that begin with one.
        start = max(0, done - size)
        if start:
            bound = BOUND_RE.search(text, start, done)
            start = bound.end() if bound else 0
        part = text[start:done]
        low = part.lower()
        if not any(map(low.__contains__, HINTS)):
            if any(map(str.isdigit, part)):
                return False
            done, size = start, size * 4
            continue
        sents = [s.strip() for s in tk.SENT_RE.findall(tk.TAG_RE.sub("\n", part))]
        for s in reversed([s for s in sents if any(map(str.isalpha, s))]):
            number = any(map(str.isdigit, s))
            # A sentence that stops over its numbers was about the task.
            if number and not tr.CLOSED_RE.search(s):
                return False
            if any(map(s.lower().__contains__, HINTS)) and any(says.search(s) and not goes_on.search(s) for says, goes_on in _REFUSALS):
                return True
            if number or tr.ANSWER_RE.fullmatch(s):
                return False
        done, size = start, size * 4
    return False


TOKEN_RE = re.compile(rf"\d+|[{tk.CJK}]|[^\W\d_{tk.CJK}]+")
WRAP_RE = re.compile(r"(?:user|human|question|problem|task)?\s*[:：]?\s*(?:please\b|solve\b|think\b|work through\b|keep the\b|answer\b|give\b|show\b|write\b|put\b|close\b|respond\b|you are\b|finish\b|the last line\b|note that your\b|assistant\s*:?$|user\s*:?$|human\s*:?$)", re.I)


@lru_cache(4096)
def statement(prompt: str) -> str:
    """The problem statement of a prompt: what is left without tags, roles and instruction lines of the wrapper."""
    t = tk.TAG_RE.sub("\n", prompt)
    lines = [re.sub(r"^(?:User|Human|Assistant)\s*:\s*", "", x.strip()) for x in t.split("\n")]
    lines = [x for x in lines if x]
    kept = [x for x in lines if not WRAP_RE.match(x)]
    return "\n".join(kept or lines)


def _tokens(text: str) -> list[str]:
    return TOKEN_RE.findall(unicodedata.normalize("NFKC", text).casefold())


@lru_cache(4096)
def _grams(prompt: str) -> tuple[frozenset, list]:
    p = _tokens(tk.TAG_RE.sub(" ", prompt))
    s = _tokens(statement(prompt))
    return frozenset(zip(p, p[1:])), list(zip(s, s[1:], s[2:]))


@lru_cache(4096)
def _folded(prompt: str) -> str:
    return unicodedata.normalize("NFKC", prompt).casefold()


def _ends_alike(text: str, prompt: str) -> bool:
    """Necessary for a copy: two neighbours among the last five words stand in the prompt. Told from the end of the text."""
    end = _tokens(tk.TAG_RE.sub(" ", text[-160:]))
    if len(text) > 160 and len(end) < 10:
        return True
    p = _folded(prompt)
    return any(a in p and b in p for a, b in zip(end[-5:], end[-4:]))


def _begins_alike(text: str, grams: frozenset, lead_in: int) -> bool:
    """Necessary for a copy: words of the prompt after the lead-in. Told from the beginning of a long text."""
    head = _tokens(tk.TAG_RE.sub(" ", text[:300]))[: lead_in + 2] if len(text) > 400 else []
    return len(head) < lead_in + 2 or any(g in grams for g in zip(head, head[1:]))


def is_copy(text: str, prompt: str | None, lead_in: int = 14) -> bool:
    """Whether the text is the prompt or its statement again, once or more, and nothing else.

    Layout, case and punctuation don't matter; up to one word in eight may be altered and at most ``lead_in``
    words may precede. A text that goes on after the statement is no copy; nor is any text of a null prompt.
    """
    if not prompt or not _ends_alike(text, prompt):
        return False
    grams, own = _grams(prompt)
    if len(own) < 2 or not _begins_alike(text, grams, lead_in):
        return False
    r = _tokens(tk.TAG_RE.sub(" ", text))
    n = len(r)
    if n < 4:
        return False
    hit = [False] * n
    for i, g in enumerate(zip(r, r[1:])):
        if g in grams:
            hit[i] = hit[i + 1] = True
    first = next((i for i, h in enumerate(hit) if h), n)
    if first > min(lead_in, n // 2 + 3):
        return False
    missed = hit[first:].count(False)
    if missed * 8 > n - first + 8 or not any(hit[-4:]):
        return False
    have = set(zip(r, r[1:], r[2:]))
    return sum(g in have for g in own) * 10 >= len(own) * 6


def refusal_or_copy(text: str, prompt: str | None) -> bool:
    return is_copy(text, prompt) or is_refusal(text)


PAIR_DDL = f"n_chars int, is_empty boolean, is_copy boolean, is_refusal boolean, junk boolean, lang string, asked string, {tr.TAIL_DDL}"


def pair_features(df: DataFrame, key: str, prompt: str, response: str, keep: Iterable[str] = (), model: li.LanguageModel | None = None) -> DataFrame:
    """One pass over the pairs: the verdict of each rule that a row alone decides, and the state of its end.

    ``lang`` and ``asked`` (languages of response and statement) are null without a ``model``. Extra columns in
    ``keep`` pass through. No shuffle.
    """
    keep = list(keep)
    bc = df.sparkSession.sparkContext.broadcast(model) if model else None
    model_id = uuid.uuid4().hex

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = li.scorer_of(model_id, bc) if bc else None
        asked: dict[str, str | None] = {}
        for pdf in batches:
            texts, prompts = pdf["_r"].tolist(), pdf["_p"].tolist()
            rows = []
            for a in range(0, len(texts), 256):
                part, asks = texts[a : a + 256], prompts[a : a + 256]
                langs: list[li.Detected | None] = [None] * len(part)
                if scorer:
                    langs = li.detect_many(part, scorer, spans=False)
                    if len(asked) > 50_000:
                        asked.clear()
                    new = [p for p in dict.fromkeys(asks) if p and p not in asked]
                    for p, d in zip(new, li.detect_many([statement(p) for p in new], scorer, spans=False) if new else []):
                        asked[p] = d.lang
                for t, p, d in zip(part, asks, langs):
                    if is_empty(t):
                        rows.append((len(t or ""), True, False, False, False, None, None, "none", None, False, []))
                        continue
                    copy = is_copy(t, p)
                    refusal = not copy and is_refusal(t)
                    junk = not copy and (d is None or d.lang is None) and ts.is_junk(t)
                    x = tr.NO_TAIL if copy or junk else tr.tail(t)
                    rows.append((len(t), False, copy, refusal, junk, d.lang if d else None, asked.get(p) if p else None, x.state, x.key, x.closing, list(x.item_keys)))
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in PAIR_DDL.split(", ")])
            for c in (key, *keep):
                out[c] = pdf[c].to_numpy()
            yield out

    types = dict(df.dtypes)
    schema = f"{PAIR_DDL}, " + ", ".join(f"`{c}` {types[c]}" for c in (key, *keep))
    return df.select(key, *keep, F.col(prompt).alias("_p"), F.col(response).alias("_r")).mapInPandas(run, schema)


def defects(features: DataFrame, key: str, source: str, limited: str | None = None) -> DataFrame:
    """A row (key, defect) per defect from ``pair_features``; the corpus decides on open ends (see ``mark_cut``)."""
    f = tr.mark_cut(features, source, limited)
    found = F.array(
        F.when(F.col("is_empty"), F.lit("empty")),
        F.when(F.col("is_cut") & ~F.col("is_refusal"), F.lit("truncated")),
        F.when(F.col("is_refusal"), F.lit("refusal")),
        F.when(F.col("is_copy"), F.lit("copy")),
        F.when((F.col("lang") != F.col("asked")) & ~F.col("is_copy"), F.lit("other_language")),
    )
    return f.select(key, F.explode(F.array_compact(found)).alias("defect"))
