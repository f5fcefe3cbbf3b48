"""Text garbled by a wrong character encoding (problem 8): found, and restored where nothing was lost.

A chain is a sequence of steps "these characters are bytes of encoding X that should have been read as Y".
Every candidate chain of a text is scored by description length: the size of the affected tokens, with their
neighbours, compressed by zstandard with a dictionary of their language, plus the cost of naming the chain.
The shortest description wins; if that is the text as it stands, it is left unchanged.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from functools import cache
from itertools import chain
from typing import NamedTuple
from zlib import crc32

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollweave.llm import textkit as tk
from rollweave.llm.langid import label_code
from rollweave.session import cut

#: Encodings that UTF-8 bytes are wrongly read in.
READ_AS = ("cp1252", "latin-1", "cp1251", "mac_roman", "cp437", "cp850", "cp1250", "koi8-r", "cp866", "mac_cyrillic", "cp1254", "iso8859-15", "iso8859-2", "gb18030", "big5", "shift_jis")
#: (read as, really) for encodings other than UTF-8.
SWAPPED = (
    ("mac_roman", "cp1252"), ("cp1252", "mac_roman"), ("cp437", "cp1252"), ("cp850", "cp1252"), ("cp1252", "cp850"), ("cp1252", "cp437"), ("cp1250", "cp1252"), ("cp1251", "cp1252"),
    ("cp1252", "cp1251"), ("cp1252", "koi8-r"), ("cp1252", "cp866"), ("cp1251", "koi8-r"), ("koi8-r", "cp1251"), ("cp866", "cp1251"), ("cp1251", "cp866"), ("mac_roman", "cp1251"), ("mac_cyrillic", "cp1251"), ("cp437", "cp866"),
    ("cp1252", "gb18030"), ("mac_roman", "gb18030"), ("cp1251", "gb18030"), ("cp1252", "big5"), ("gb18030", "big5"), ("big5", "gb18030"), ("shift_jis", "gb18030"), ("cp1252", "shift_jis"),
)
MULTI = frozenset(("gb18030", "big5", "shift_jis"))
#: Bytes that naming a step costs. Between other encodings every decoding succeeds, so there some word must become known;
#: each word that a step makes known counts as one byte saved.
CHAIN_COST = {"utf-8": 1, "other": 0}
HIGH_CP1252 = "‚„†‡ˆ‰ŠŒŽ‘’“”•–—˜™š›œžŸ€ƒ‹"
TOKEN_RE = re.compile(r"[^ \t\r\n]*[^\x00-\x7f][^ \t\r\n]*")
RUN_RE = re.compile(r"[^\x00-\x7f]+")
#: Four accented letters in a row: no language that the dictionaries are trained for has them.
ACCENTS_RE = re.compile("[\u00c0-\u00ff]{4}")
PAIR_RE = re.compile(r"[^\x00-\x7f]{2}")
#: One word of two alphabets: no step gives that.
TWO_SCRIPTS_RE = re.compile("[A-Za-z\u00c0-\u024f][\u0400-\u04ff]|[\u0400-\u04ff][A-Za-z\u00c0-\u024f]")
#: A Chinese character inside a word of letters, as one accented letter gives it when UTF-8 is read in a multibyte encoding.
IN_WORD_RE = re.compile(f"[A-Za-z][{tk.CJK}]|[{tk.CJK}][A-Za-z]")
#: Beginnings of three-byte sequences whose rest was lost: E2 80, E2 82, E2 84, E2 88, E2 89 read as cp1252 or latin-1.
LOST_RE = re.compile("â[€\x80‚\x82„\x84ˆ\x88‰\x89](?![\x80-\xbf€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ])|Ã[\x80-\x9f]?(?=[\\s,.;?]|$)(?<=[a-z]Ã)|ï¿½")


def to_bytes(s: str, enc: str) -> bytes:
    """Encodes, with bytes that cp1252 and its kin leave undefined kept as C1 controls."""
    try:
        return s.encode(enc)
    except UnicodeEncodeError:
        if enc not in ("cp1252", "cp1251", "cp1250", "cp1254"):
            raise
        return b"".join(bytes([ord(c)]) if "\x80" <= c <= "\x9f" else c.encode(enc) for c in s)


@cache
def _utf8_re(enc: str) -> re.Pattern:
    """Matches maximal runs of what well-formed UTF-8 looks like when read in a single-byte encoding."""

    def cls(a: int, b: int) -> str:
        out = ""
        for x in range(a, b):
            try:
                c = bytes([x]).decode(enc)
            except UnicodeDecodeError:
                c = chr(x)
            out += re.escape(c)
        return f"[{out}]"

    cont = cls(0x80, 0xC0)
    return re.compile(f"(?:{cls(0xC2, 0xE0)}{cont}|{cls(0xE0, 0xF0)}{cont}{cont}|{cls(0xF0, 0xF5)}{cont}{cont}{cont})+")


@cache
def _high_re(enc: str) -> re.Pattern:
    """Runs of what the upper half of a single-byte encoding holds."""
    high = ""
    for x in range(0x80, 0x100):
        try:
            high += re.escape(bytes([x]).decode(enc))
        except UnicodeDecodeError:
            high += chr(x)
    return re.compile(f"[{high}]+")


@cache
def _swap_table(a: str, b: str) -> dict[int, str]:
    """Upper half of a single-byte encoding -> what ``b`` has at the same byte; U+FFFF where it has nothing there."""
    return {ord(c): x.to_bytes().decode(b, "replace").replace("\ufffd", "\uffff") for x in range(0x80, 0x100) if len(c := x.to_bytes().decode(a, "replace").replace("\ufffd", chr(x))) == 1}


#: Share of a language's documents that make a word or character known.
LEAST_SHARE = 0.002
CYRILLIC = "".join(map(chr, range(0x410, 0x450))) + "Ёё"


class Model(NamedTuple):
    """dictionaries: language -> trained zstandard dictionary; usual: language -> characters of ordinary texts; known: of
    any; words: words of ordinary texts."""

    dictionaries: dict[str, bytes]
    usual: dict[str, frozenset[str]]
    known: frozenset[str]
    words: frozenset[str]


@cache
def _garbled_re() -> re.Pattern:
    """Characters that ordinary texts lack, and runs beyond ASCII that are well-formed UTF-8 read in a single-byte encoding."""
    runs = "|".join(_utf8_re(enc).pattern for enc in ("cp1252", "latin-1", "cp1251", "cp437", "cp1250"))
    return re.compile(rf"[\ufffd\x80-\x9f]|{ACCENTS_RE.pattern}|(?<![^\x00-\x7f])(?=[^\x00-\x7f]{{2,39}}(?![^\x00-\x7f]))(?:{runs})(?![^\x00-\x7f])")


def looks_garbled(text: str) -> bool:
    """Cheap test that keeps garbled texts out of the counts."""
    return not text.isascii() and bool(_garbled_re().search(text))


class Counted:
    """Of texts that don't look garbled, by language: documents that hold a character (c) or word (w), documents (d, no value),
    and their lines as pieces for a dictionary."""

    def __init__(self) -> None:
        self.counts: dict[str, dict[str, Counter]] = {}
        self.pieces: dict[str, list[bytes]] = {}

    def add(self, lang: str, text: str | None) -> None:
        if text and not looks_garbled(text):
            c = self.counts.get(lang) or self.counts.setdefault(lang, {k: Counter() for k in "cwd"})
            c["c"].update(set(text))
            c["w"].update(set(tk.lower_words(text)))
            c["d"][""] += 1
            self.pieces.setdefault(lang, []).extend(p.encode("utf-8", "replace") for p in text.split("\n") if len(p) > 8)

    def rows(self) -> Iterator[tuple[str, str, str, int]]:
        return ((kind, lang, v, n) for lang, by in self.counts.items() for kind, values in by.items() for v, n in values.items())


def _condensed(pieces: list[bytes], size: int) -> list[bytes]:
    """Stretches of the pieces that say most about all of them, ``size`` bytes at most; all pieces where they are no longer."""
    import zstandard

    if sum(map(len, pieces)) <= size:
        return pieces
    try:
        content = zstandard.train_dictionary(size, pieces, k=256, d=8).as_bytes()[512:]  # without the tables at its head
    except zstandard.ZstdError:  # too few pieces to choose from
        content = b"".join(pieces)[:size]
    return [x.decode("utf-8", "ignore").encode() for a in range(0, len(content), 256) if len(x := content[a : a + 256]) > 8]


def model_of(counts: Iterable[tuple[str, str, str, int]], pieces: dict[str, list[bytes]], size: int = 16_384, usual_share: float = 0.03, least_share: float = LEAST_SHARE) -> Model:
    """Trains a dictionary per language on its pieces and tells from the counts which characters and words are ordinary.
    Characters are usual in ``usual_share`` of a language's documents (Chinese ones in ``least_share``) and known, as words are,
    in ``least_share`` of those of some language; two documents at least."""
    import zstandard

    by: dict[str, dict[str, dict[str, int]]] = {}
    for kind, lang, v, n in counts:
        by.setdefault(lang, {k: {} for k in "cwd"})[kind][v] = n
    dictionaries, usual, every = {}, {}, {"c": Counter(), "w": Counter()}
    for lang, x in sorted(by.items()):
        docs = x["d"][""]
        for kind, total in every.items():
            total.update({v: n for v, n in x[kind].items() if n >= least_share * docs})
        usual[lang] = frozenset(c for c, n in x["c"].items() if n >= max(2, usual_share * docs) or lang == "zh" and n >= least_share * docs and tk.CJK_RE.match(c))
        parts = pieces.get(lang, [])
        try:
            dictionaries[lang] = zstandard.train_dictionary(size, parts).as_bytes()
        except zstandard.ZstdError:  # too little text: the text itself serves as dictionary
            dictionaries[lang] = b"\n".join(parts)[-size:] or b" " * 16
    known = frozenset(c for c, n in every["c"].items() if n >= 2)
    if sum(c in known for c in CYRILLIC) * 2 > len(CYRILLIC):  # a small corpus may lack a rare letter of an alphabet it uses
        known |= frozenset(CYRILLIC)
        usual["ru"] = usual.get("ru", frozenset()) | frozenset(CYRILLIC.lower())
    usual["*"] = frozenset().union(*usual.values()) if usual else frozenset()
    return Model(dictionaries, usual, known, frozenset(w for w, n in every["w"].items() if n >= 2))


def fit(samples: dict[str, list[str]], size: int = 16_384, usual_share: float = 0.03) -> Model:
    """The model of texts at hand, by language."""
    c = Counted()
    for lang, texts in samples.items():
        for t in texts:
            c.add(lang, t)
    return model_of(c.rows(), c.pieces, size, usual_share)


def train(spark: SparkSession, docs: DataFrame, text: str = "text", label: str = "lang", least_share: float = LEAST_SHARE, condensed: int = 262_144) -> Model:
    """The model of all labelled documents, whatever their length, read once.

    Each partition counts, and condenses its lines of a language to ``condensed`` bytes; those of all partitions are condensed
    again, about 64 at a time and in an order that their content gives, until one set is left. What reaches the driver is bounded: per language these bytes, and at most the
    distinct words and characters of a document divided by ``least_share``.
    """

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c, n = Counted(), 0
        for pdf in batches:
            for lang, t in zip(pdf["l"], pdf["t"]):
                c.add(lang, t)
                n += len(t)
            if n > 50_000_000:
                yield made(c)
                c, n = Counted(), 0
        yield made(c)

    def made(c: Counted) -> pd.DataFrame:
        rows = [(kind, lang, v, n, None) for kind, lang, v, n in c.rows()]
        rows += [("t", lang, None, crc32(b"".join(x)), x) for lang, xs in c.pieces.items() for x in [_condensed(xs, condensed)]]
        return pd.DataFrame(rows, columns=["kind", "lang", "v", "n", "pieces"])

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        one = _condensed([bytes(x) for xs in pdf.sort_values("n")["pieces"] for x in xs], condensed)
        return pd.DataFrame({"lang": [pdf["lang"].iloc[0]], "n": [crc32(b"".join(one))], "pieces": [one]})

    rows = docs.select(label_code(F.col(label)).alias("l"), F.col(text).alias("t")).where("l is not null and t is not null")
    parts = cut(rows.mapInPandas(run, "kind string, lang string, v string, n bigint, pieces array<binary>"), "counted")
    sizes = parts.where("kind = 'd'").groupBy("lang").agg(F.sum("n").alias("docs"))
    counts = parts.where("kind <> 't'").groupBy("kind", "lang", "v").agg(F.sum("n").alias("n"))
    kept = counts.join(F.broadcast(sizes), "lang").where(F.col("n") >= F.col("docs") * least_share).select("kind", "lang", "v", "n").collect()
    texts = parts.where("kind = 't'").select("lang", "n", "pieces")
    while (most := texts.groupBy("lang").count().agg(F.max("count")).first()[0] or 0) > 1:
        groups = F.pmod("n", F.lit(-(-most // 64)))
        texts = cut(texts.groupBy("lang", groups.alias("g")).applyInPandas(merged, "lang string, n bigint, pieces array<binary>"), "pieces")
    return model_of((tuple(r) for r in kept), {r["lang"]: [bytes(x) for x in r["pieces"]] for r in texts.collect()}, least_share=least_share)


#: Token -> where it stands in the text.
Spans = dict[str, list[tuple[int, int]]]


class Repair(NamedTuple):
    """found: something is garbled; restored: the original, or null where something was lost; chain: steps taken."""

    found: bool
    restored: str | None
    chain: str | None


CLEAN = Repair(False, None, None)


class Repairer:
    def __init__(self, model: Model):
        import zstandard

        self.m = model
        self.z = {}
        for lang, d in model.dictionaries.items():
            zd = zstandard.ZstdCompressionDict(d)
            zd.precompute_compress(level=9)
            self.z[lang] = zstandard.ZstdCompressor(dict_data=zd, write_checksum=False, write_content_size=False, write_dict_id=False)

    def cost(self, texts: Sequence[str], langs: Iterable[str]) -> int:
        b = "\n".join(texts).encode("utf-8", "surrogatepass")
        return min((len(self.z[x].compress(b)) for x in langs if x in self.z), default=len(b))

    def candidates(self, tokens: Sequence[str]) -> Iterator[tuple[str, dict[str, str], int]]:
        """(step, token -> token with the step undone, unknown words that become known) for every step that applies to some token."""
        pairs = [t for t in tokens if PAIR_RE.search(t)]
        single = [t for t in tokens if IN_WORD_RE.search(t)]
        for enc in READ_AS:
            asked = dict.fromkeys(pairs + single) if enc in MULTI else pairs
            out = {t: r for t in asked if (r := self._from_utf8(t, enc)) != t}
            if out:
                yield f"utf-8 read as {enc}", out, self._made_known(out)
                twice = {t: r2 for t, r in out.items() if PAIR_RE.search(r) and (r2 := self._from_utf8(r, enc)) != r}
                if twice:
                    yield f"utf-8 read as {enc} < utf-8 read as {enc}", out | twice, self._made_known(out | twice)
        unknown = {t: n for t in tokens if (n := self._unknown(t))}
        if not unknown:
            return
        for a, b in SWAPPED:
            out, better = {}, 0
            for t, n in unknown.items():
                if (new := self._swapped(t, a, b)) and (m := self._unknown(new)) <= n:
                    out[t] = new
                    better += n - m
            if out and better:
                yield f"{b} read as {a}", out, better

    def _made_known(self, out: dict[str, str]) -> int:
        return max(0, sum(self._unknown(t) - self._unknown(new) for t, new in out.items()))

    def _applies(self, token: str, a: str, b: str) -> bool:
        """Whether the step can be undone in the token at all, whatever comes out."""
        if b == "utf-8":
            return any(_wide(run, a, None) for run in RUN_RE.findall(token)) if a in MULTI else bool(_utf8_re(a).search(token))
        run = RUN_RE if a in MULTI else _high_re(a)
        try:
            return run.sub(lambda m: to_bytes(m[0], a).decode(b), token) != token
        except UnicodeError:
            return False

    def _swapped(self, token: str, a: str, b: str) -> str | None:
        """The token with what was read as ``a`` read as ``b``; null where that changes nothing or gives unknown characters."""
        if a in MULTI or b in MULTI:
            run = RUN_RE if a in MULTI else _high_re(a)
            try:
                new = run.sub(lambda m: to_bytes(m[0], a).decode(b), token)
            except UnicodeError:
                return None
        else:
            new = token.translate(_swap_table(a, b))
            if "\uffff" in new and "\uffff" not in token:
                return None
        if new == token or TWO_SCRIPTS_RE.search(new) and not TWO_SCRIPTS_RE.search(token):
            return None
        return new if all(c < "\x80" or c in self.m.known or tk.CJK_RE.match(c) for c in new) else None

    def _known(self, word: str) -> bool:
        """Whether ordinary texts hold the word; of Chinese, its characters."""
        return word in self.m.words or bool(tk.CJK_RE.match(word)) and all(c in self.m.known for c in word)

    def _from_utf8(self, token: str, enc: str) -> str:
        """The token with its well-formed UTF-8, read as ``enc``, decoded where that gives known characters."""
        known = self.m.known
        if enc in MULTI:
            for run in RUN_RE.findall(token):
                if r := _wide(run, enc, known):
                    token = token.replace(run, r)
            return token

        def undo(m: re.Match) -> str:
            try:
                r = to_bytes(m[0], enc).decode("utf-8")
            except UnicodeError:
                return m[0]
            return r if all(c in known or "\x80" <= c <= "ÿ" or tk.CJK_RE.match(c) or c in HIGH_CP1252 for c in r) else m[0]

        return _utf8_re(enc).sub(undo, token)

    def _unknown(self, token: str) -> int:
        """Words of the token that ordinary texts lack, and single letters beside other words; Chinese counts as known where its characters are."""
        ws = tk.lower_words(token)
        return sum(1 for w in ws if (w not in self.m.words or len(ws) > 1 == len(w)) and not (tk.CJK_RE.match(w) and self._known(w)))

    def repair(self, text: str | None) -> Repair:
        """Null and blank texts and texts of usual characters and known words are clean. Nothing counts as restored while a
        step still applies after the last one taken."""
        if not text or text.isascii():
            return CLEAN
        ws = tk.lower_words(text)
        odd = {c for c in set(text) if c > "\x7f"} - self.m.usual.get(tk.quick_language(ws), self.m.usual["*"])
        if not odd and all(w.isascii() or self._known(w) for w in set(ws)):
            return CLEAN
        lost = "�" in odd
        steps: list[str] = []
        now, seen = text, {text}
        while (step := self._step(now)) and step[1] not in seen:
            steps.append(step[0])
            now = step[1]
            seen.add(now)
            lost = lost or step[2]
        if LOST_RE.search(now):
            lost = True
        found = bool(steps) or lost
        return Repair(found, now if steps and not lost else None, " < ".join(steps) or None) if found else CLEAN

    def _step(self, text: str) -> tuple[str, str, bool] | None:
        """The candidate chain that shortens the description most, the text after it, and whether it leaves a stretch that it
        could have changed and that no ordinary text explains; null where none shortens it."""
        lang = tk.quick_language(tk.lower_words(text))
        usual = self.m.usual.get(lang, self.m.usual["*"])
        spans: dict[str, list[tuple[int, int]]] = {}
        for m in TOKEN_RE.finditer(text):
            spans.setdefault(m[0], []).append(m.span())
        tokens = [t for t in spans if any(c > "\x7f" and c not in usual for c in t) or not all(w.isascii() or self._known(w) for w in tk.lower_words(t))]
        if not tokens:
            return None
        best = None
        for step, out, known in self.candidates(tokens):
            if not step.startswith("utf-8") and not _most(spans, out):
                out = self._plainly_better(out, usual)
                if not out:
                    continue
            price = sum(CHAIN_COST["utf-8" if x.startswith("utf-8") else "other"] for x in step.split(" < ")) - known
            gain = self._gain(text, spans, out, lang) - price
            if gain <= 0 and len(out) > 1:  # only some of the tokens may be garbled
                some = {t: r for t, r in out.items() if self._gain(text, spans, {t: r}, lang) > max(price, 0)}
                if some and len(some) < len(out):
                    out, gain = some, self._gain(text, spans, some, lang) - max(price, 0)
            if gain > 0 and (best is None or gain > best[0]):
                best = gain, step, out
        if not best:
            return None
        _, step, out = best
        out, doubtful = self._widened(text, spans, step, out, [t for t in spans if t not in out], lang)
        return step, _replaced(text, spans, out, 0, len(text)), doubtful

    def _widened(self, text: str, spans: Spans, step: str, out: dict[str, str], rest: Sequence[str], lang: str) -> tuple[dict[str, str], bool]:
        """``out`` with the other tokens that the step explains: all that it leaves no worse where it changes a third of
        the words or more, else those that shorten the description too. And whether some of the rest, with characters that are not usual
        in the language of the new text, may be garbled as well."""
        b, _, a = step.split(" < ")[0].partition(" read as ")
        if b == "utf-8":
            could = {t: new for t in rest if a in MULTI and (new := self._from_utf8(t, a)) != t}
            more = could
        else:
            could = {t: new for t in rest if (new := self._swapped(t, a, b))}
            more = {t: new for t, new in could.items() if self._unknown(new) <= self._unknown(t)}
        most = _most(spans, out)
        if not most:
            more = self._plainly_better(more, self.m.usual.get(lang, self.m.usual["*"]))
        wide = out | more
        if more and (most or self._gain(text, spans, wide, lang) >= self._gain(text, spans, out, lang)):
            out = wide
        new = tk.quick_language(tk.lower_words(_replaced(text, spans, out, 0, len(text))))
        usual = self.m.usual.get(new, self.m.usual["*"])
        odd = (t for t in could if t not in out and any(c > "\x7f" and c not in usual for c in t))
        left = (t for t in rest if most and t not in out and self._unknown(t) and self._applies(t, a, b))
        return out, any(True for t in chain(odd, left))

    def _plainly_better(self, out: dict[str, str], usual: frozenset[str]) -> dict[str, str]:
        """The tokens that hold unusual characters or words that the step makes known: a text of which little is garbled may
        hold other unknown words."""
        return {t: new for t, new in out.items() if any(c > "\x7f" and c not in usual for c in t) or self._unknown(new) < self._unknown(t)}

    def _gain(self, text: str, spans: Spans, out: dict[str, str], lang: str, reach: int = 16) -> int:
        """Bytes saved by the step. Only the stretches around the changed tokens are compressed: the rest costs the same before and after."""
        windows: list[list[int]] = []
        for a, b in sorted(s for t in out for s in spans[t]):
            a, b = max(0, a - reach), min(len(text), b + reach)
            if windows and a <= windows[-1][1]:
                windows[-1][1] = b
            else:
                windows.append([a, b])
        if not windows:
            return 0
        old = [text[a:b] for a, b in windows]
        new = _stretches(text, spans, out, windows)
        langs = {lang, tk.quick_language(tk.lower_words(" ".join(new)))}
        return self.cost(old, langs) - self.cost(new, langs)


def _most(spans: Spans, out: dict[str, str]) -> bool:
    """Whether a step changes a third of the words with characters beyond ASCII or more: then all of the text may be garbled."""
    n = sum(len(spans[t]) for t in out)
    return n * 3 > sum(map(len, spans.values()))


def _stretches(text: str, spans: Spans, out: dict[str, str], windows: Sequence[Sequence[int]]) -> list[str]:
    """The windows of the text with the tokens of ``out`` replaced; both in the order of the text, so one pass does."""
    todo = sorted((a, b, r) for t, r in out.items() for a, b in spans[t])
    made, k = [], 0
    for start, end in windows:
        parts, at = [], start
        while k < len(todo) and todo[k][1] <= end:
            a, b, r = todo[k]
            parts += [text[at:a], r]
            at = b
            k += 1
        made.append("".join(parts) + text[at:end])
    return made


def _replaced(text: str, spans: Spans, out: dict[str, str], start: int, end: int) -> str:
    return _stretches(text, spans, out, [(start, end)])[0]


def _wide(run: str, enc: str, known: frozenset[str] | None) -> str | None:
    """Undoes UTF-8 read in a multibyte encoding, where that gives known characters (null: any); a broken last character may be dropped, not more."""
    try:
        b = run.encode(enc)
    except UnicodeError:
        return None
    for cut in range(3 if len(run) > 1 else 1):
        try:
            r = b[: len(b) - cut].decode("utf-8")
        except UnicodeError:
            continue
        return r if r and all(known is None or c in known or tk.CJK_RE.match(c) and len(run) > 1 for c in r) else None
    return None


_repairers: dict[str, Repairer] = {}


def repair_texts(df: DataFrame, key: str, text: str, model: Model) -> DataFrame:
    """key, garbled, restored and chain of each text; one pass, no shuffle. The model is bounded by its sample."""
    bc, model_id = df.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if model_id not in _repairers:
            _repairers.clear()
            _repairers[model_id] = Repairer(bc.value)
        repair = _repairers[model_id].repair
        for pdf in batches:
            out = pd.DataFrame([repair(t) for t in pdf["t"]], columns=["garbled", "restored", "chain"])
            out.insert(0, "k", pdf["k"].to_numpy())
            yield out

    kind = dict(df.dtypes)[key]
    out = df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, f"k {kind}, garbled boolean, restored string, chain string")
    return out.withColumnRenamed("k", key)
