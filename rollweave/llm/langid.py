"""Language of documents and of their segments by segmentation-marginalised unigrams (problem 4).

Each language has a probability for every piece of a fixed public byte-level vocabulary. The score of a
word is the sum over all its segmentations into pieces, by a forward pass; words are separated by white
space and punctuation, which no piece of the word lattice crosses, so a text's log score is the sum over
its words and words can be scored once and kept. Piece probabilities come from labelled documents:
counts of the vocabulary's own segmentation, then expectation-maximisation over all segmentations.
"""

from __future__ import annotations

import base64
import math
import re
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from rollweave.llm import resources
from rollweave.llm import textkit as tk
from rollweave.llm import textstats as ts

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
RESPONSE_LANGS = ("en", "zh", "de", "fr", "es", "ru")
FLOOR = 1e-7
#: Share of the mean of all languages in each language's piece probabilities; bounds what one unknown word can do.
BACKGROUND = 0.2
#: Weight of a language's common words among the words of the fit, as a share of its text.
COMMON_MASS = 0.3
SCALE = math.exp(1.8)

_vocabularies: dict[str, frozenset[bytes]] = {}


def vocabulary(path: str) -> frozenset[bytes]:
    if path not in _vocabularies:
        with open(path, "rb") as f:
            pieces = {base64.b64decode(line.split()[0]) for line in f if line.strip()}
        _vocabularies[path] = frozenset(p for p in pieces if len(p) <= 24) | {bytes([i]) for i in range(256)}
    return _vocabularies[path]


class LanguageModel(NamedTuple):
    """langs; piece -> row of ``table``; row 0 is the floor of pieces unseen in training."""

    langs: tuple[str, ...]
    path: str
    rows: dict[bytes, int]
    table: np.ndarray
    prior: np.ndarray


def _lattice(word: str) -> bytes:
    """The bytes that the pieces of a word cover; words of alphabetic scripts begin with their blank."""
    return ("" if "㐀" <= word[0] <= "鿿" else " ").encode() + word.encode("utf-8", "replace")


def _expected(chunk: bytes, p: dict[bytes, float], voc: frozenset[bytes]) -> list[tuple[bytes, float]]:
    """Expected number of uses of each piece over all segmentations of ``chunk``."""
    n = len(chunk)
    edges = [(i, j, chunk[i:j]) for i in range(n) for j in range(i + 1, min(n, i + 24) + 1) if chunk[i:j] in voc]
    fwd = [1.0] + [0.0] * n
    for i, j, piece in edges:
        fwd[j] += fwd[i] * p.get(piece, FLOOR) * SCALE ** (j - i)
    total = fwd[n]
    if not 1e-250 < total < 1e250:
        return _expected_log(n, edges, p)
    bwd = [0.0] * n + [1.0]
    for i, j, piece in reversed(edges):
        bwd[i] += bwd[j] * p.get(piece, FLOOR) * SCALE ** (j - i)
    return [(piece, fwd[i] * p.get(piece, FLOOR) * SCALE ** (j - i) * bwd[j] / total) for i, j, piece in edges]


def _expected_log(n: int, edges: Sequence[tuple[int, int, bytes]], p: dict[bytes, float]) -> list[tuple[bytes, float]]:
    """The same for words so long that their probability leaves the range of floats."""
    fwd, bwd = [0.0] + [-math.inf] * n, [-math.inf] * n + [0.0]
    cost = [math.log(p.get(piece, FLOOR)) for _, _, piece in edges]
    for (i, j, _), c in zip(edges, cost):
        fwd[j] = float(np.logaddexp(fwd[j], fwd[i] + c))
    for (i, j, _), c in zip(reversed(edges), reversed(cost)):
        bwd[i] = float(np.logaddexp(bwd[i], bwd[j] + c))
    return [(piece, math.exp(fwd[i] + c + bwd[j] - fwd[n])) for (i, j, piece), c in zip(edges, cost)]


def fit(counts: dict[str, Counter[str]], langs: Sequence[str], path: str = VOCABULARY, rounds: int = 1, prior: dict[str, float] | None = None) -> LanguageModel:
    """Fits piece probabilities from word counts by language.

    Each language's common words enter with ``COMMON_MASS``; they are all that a language without any text has.
    """
    path = resources.path(path)
    voc = vocabulary(path)
    probs: list[dict[bytes, float]] = []
    for lang in langs:
        ws = Counter(counts.get(lang, {}))
        common = tk.COMMON.get(lang, tk.COMMON_ZH if lang == "zh" else ())
        mass = max(1.0, COMMON_MASS * sum(ws.values()) / max(1, len(common)))
        for w in common:
            ws[w] += mass
        chunks = [(_lattice(w), n) for w, n in ws.items()]
        p: dict[bytes, float] = {}
        for r in range(rounds + 1):
            c: Counter[bytes] = Counter()
            for chunk, n in chunks:
                if r == 0:
                    i = 0
                    while i < len(chunk):
                        j = min(len(chunk), i + 24)
                        while chunk[i:j] not in voc:
                            j -= 1
                        c[chunk[i:j]] += n
                        for b in chunk[i:j]:
                            c[bytes([b])] += 0.05 * n
                        i = j
                else:
                    for piece, x in _expected(chunk, p, voc):
                        c[piece] += n * x
            total = sum(c.values()) or 1.0
            p = {k: 0.999 * v / total for k, v in c.items() if v / total > FLOOR}
        probs.append(p)
    pieces = sorted(set().union(*probs))
    table = np.full((len(pieces) + 1, len(langs)), FLOOR)
    for k, p in enumerate(probs):
        for i, piece in enumerate(pieces):
            if piece in p:
                table[i + 1, k] = max(FLOOR, p[piece])
    table[1:] = (1 - BACKGROUND) * table[1:] + BACKGROUND * table[1:].mean(axis=1, keepdims=True)
    shares = np.array([(prior or {}).get(lang, 0) + 1.0 for lang in langs])
    return LanguageModel(tuple(langs), path, {p: i + 1 for i, p in enumerate(pieces)}, table, np.log(shares / shares.sum()))


def train(spark: SparkSession, docs: DataFrame, langs: Sequence[str] = RESPONSE_LANGS, text: str = "text", label: str = "lang", key: str = "doc_id", sample_docs: int = 250, path: str = VOCABULARY) -> LanguageModel:
    """Fits the model on at most ``sample_docs`` labelled documents of each language, chosen by hash of the key.

    Only this bounded sample reaches the driver, as word counts. Documents whose label is null or names no language of
    ``langs`` are left out; a language without labelled documents falls back to its common words.
    """
    lang = label_code(F.col(label))
    ranked = docs.select(F.col(key).alias("k"), lang.alias("l")).where(F.col("l").isin(*langs))
    w = Window.partitionBy("l").orderBy(F.xxhash64("k"), "k")
    chosen = ranked.withColumn("r", F.row_number().over(w)).where(F.col("r") <= sample_docs).select("k", "l")
    texts = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).where(F.col("t").isNotNull()).join(F.broadcast(chosen), "k")

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            c: Counter = Counter()
            for lg, t in zip(pdf["l"], pdf["t"]):
                c.update((lg, w) for w in tk.lower_words(t) if len(w) > 1)
            yield pd.DataFrame([(lg, w, n) for (lg, w), n in c.items()], columns=["l", "w", "n"])

    rows = texts.select("l", "t").mapInPandas(run, "l string, w string, n bigint").groupBy("l", "w").agg(F.sum("n").alias("n")).collect()
    counts: dict[str, Counter[str]] = {}
    for r in rows:
        counts.setdefault(r["l"], Counter())[r["w"]] = r["n"]
    prior = {r["l"]: float(r["n"]) for r in ranked.groupBy("l").agg(F.count("*").alias("n")).collect()}
    return fit(counts, langs, path, prior=prior)


def label_code(label: Column) -> Column:
    """Two-letter code of a language label in any known spelling, else null; JVM side."""
    known = F.create_map(*[F.lit(x) for kv in tk.LABELS.items() for x in kv])
    return F.try_element_at(known, F.split(F.lower(F.trim(label)), "[-_]")[0])


ASCII_TOKEN_RE = re.compile(r"[a-z]+(?:'[a-z]+)*|[.!?]+(?=[\s\"')*\]]|$)|\n")
TOKEN_RE = re.compile(tk.WORD_RE.pattern + rf"|[.!?…]+(?=[\s\"'”’»)*\]]|$|[{tk.CJK}])|[。！？]+|\n")
END_RE = re.compile(r"[.!?…。！？]+|\n")


class Scorer:
    """Scores texts with a model; keeps the scores of words it has seen (a bounded memo, not a limit on the input)."""

    MOST = 200_000

    def __init__(self, model: LanguageModel):
        self.langs, self.rows = model.langs, model.rows
        self.voc = vocabulary(model.path)
        self.table, self.prior = model.table, model.prior
        self.longest = max(map(len, model.rows), default=1)
        self.scale = [SCALE**k for k in range(self.longest + 1)]
        self._reset()

    def _reset(self) -> None:
        #: Row 0 stands for the end of a sentence. Columns of ``about``: words, Chinese characters, common words, letters.
        self.ids: dict[str, int] = {}
        self.scores = np.zeros((4096, len(self.langs)))
        self.about = np.zeros((4096, 4), dtype=np.int32)

    def word(self, w: str) -> np.ndarray:
        """Log score of a word in each language, summed over all segmentations of the whole word."""
        get, table, chunk = self.rows.get, self.table, _lattice(w)
        n = len(chunk)
        a = np.zeros((n + 1, len(self.langs)))
        a[0] = 1.0
        out = np.zeros(len(self.langs)) - n * math.log(SCALE)
        for j in range(1, n + 1):
            for i in range(max(0, j - self.longest), j):
                r = get(chunk[i:j])
                if r is not None:
                    a[j] += a[i] * (table[r] * self.scale[j - i])
                elif j - i == 1:
                    a[j] += a[i] * (FLOOR * SCALE)
            if not j % 16:  # keeps long words within the range of floats
                out += np.log(a[j])
                a[max(0, j + 1 - self.longest) : j + 1] /= a[j].copy()
        return out + np.log(a[n])

    def id(self, w: str) -> int:
        i = self.ids.get(w)
        if i is None:
            i = len(self.ids) + 1
            if i == len(self.scores):
                self.scores = np.concatenate((self.scores, np.zeros_like(self.scores)))
                self.about = np.concatenate((self.about, np.zeros_like(self.about)))
            if END_RE.fullmatch(w):
                i = 0
            elif "㐀" <= w[0] <= "鿿":
                self.scores[i] = self.word(w)
                self.about[i] = 0, len(w), sum(c in tk.COMMON_ZH for c in w), len(w)
            else:
                if len(w) > 1:
                    self.scores[i] = self.word(w)
                self.about[i] = len(w) > 1, 0, w in tk.COMMON_BITS, len(w)
            self.ids[w] = i
            if i == 0:
                self.ids[f"\n{len(self.ids)}"] = 0
        return i

    def tokens(self, text: str) -> list[int]:
        """Word numbers of the text without mark-up, a 0 at the end of each sentence."""
        get, out = self.ids.get, []
        low = blank(text).lower()
        for w in (ASCII_TOKEN_RE if low.isascii() else TOKEN_RE).findall(low):
            i = get(w)
            out.append(self.id(w) if i is None else i)
        return out

    def segments(self, text: str) -> tuple[list[tuple[int, int, int, int]], np.ndarray]:
        """(start, end, words, Chinese characters) and log scores of each sentence that has words."""
        if len(self.ids) > self.MOST:
            self._reset()
        where, ids, starts = [], [], []
        clean = blank(text)
        for m in tk.SENT_RE.finditer(clean):
            if m.end() == m.start():
                continue
            ws = [w for w in tk.lower_words(m[0]) if len(w) > 1 or "㐀" <= w <= "鿿"]
            if ws:
                words, han = tk.n_units(ws)
                where.append((m.start(), m.end(), words, han))
                starts.append(len(ids))
                get = self.ids.get
                for w in ws:
                    i = get(w)
                    ids.append(self.id(w) if i is None else i)
        if not ids:
            return [], np.zeros((0, len(self.langs)))
        return where, np.add.reduceat(self.scores[ids], starts, axis=0)


def _blank_match(m) -> str:
    return " " * len(m[0])


def blank(text: str) -> str:
    """The text with mark-up, formulas and tags blanked out, offsets unchanged."""
    if "<" in text or "[" in text:
        text = tk.TAG_RE.sub(_blank_match, text)
    if "\\" in text or "$" in text or "<" in text or "&" in text:
        text = tk.MARKUP_RE.sub(_blank_match, text)
    return text


class Detected(NamedTuple):
    lang: str | None
    conf: float
    langs: tuple[str, ...]
    segments: list[tuple[str, float, int, int]]


NONE = Detected(None, 0.0, (), [])
ENDS = frozenset(".!?。！？…\"”’»)]*`|")


def _conf(v: np.ndarray) -> float:
    return float(1.0 / np.exp(v - v.max()).sum())


def detect_many(texts: Sequence[str | None], scorer: Scorer, least_words: int = 4, least_han: int = 6, margin: float = 7.0, spans: bool = True) -> list[Detected]:
    """Language, confidence and, of mixed texts, segments of each text.

    No language for null and junk texts and where fewer than ``least_words`` words or ``least_han`` Chinese characters
    are left beside mark-up and formulas. A second language counts only by a complete sentence of that many words
    whose score exceeds that of the main language by ``margin`` (natural logarithm). Where ``spans`` is off, no
    segments are made.
    """
    if not texts:
        return []
    if len(scorer.ids) > scorer.MOST:
        scorer._reset()
    ids: list[int] = []
    sizes = []
    for t in texts:
        x = scorer.tokens(t) if t else []
        sizes.append(len(x) + 1)
        ids += x
        ids.append(0)
    a = np.array(ids, dtype=np.int64)
    ends = np.flatnonzero(a == 0)
    starts = np.concatenate(([0], ends[:-1] + 1))
    v = np.add.reduceat(scorer.scores[a], starts, axis=0)
    about = np.add.reduceat(scorer.about[a], starts, axis=0)
    bounds = np.cumsum(sizes)
    first = np.searchsorted(ends, np.concatenate(([0], bounds[:-1])))
    last = np.searchsorted(ends, bounds - 1)
    own = v.argmax(axis=1)
    top = np.sort(v, axis=1)
    lead = top[:, -1] - top[:, -2] if v.shape[1] > 1 else np.full(len(v), 99.0)
    enough = (about[:, 0] >= least_words) | (about[:, 1] >= least_han)
    sure = enough & (lead >= margin)
    size = np.where(lead >= 1.0, about[:, 0] + 0.6 * about[:, 1], 0.0)
    cells = np.zeros((len(texts), v.shape[1]))
    text_of = np.repeat(np.arange(len(texts)), last - first + 1)
    np.add.at(cells, (text_of, own), size)
    total = np.add.reduceat(v, first, axis=0) + scorer.prior
    whole = np.add.reduceat(about, first, axis=0)
    main = np.where(cells.any(axis=1), cells.argmax(axis=1), total.argmax(axis=1))
    # short texts: the prior decides between close scores
    main = np.where(whole[:, 0] + whole[:, 1] < 12, total.argmax(axis=1), main)
    alien = sure & (own != main[text_of])
    mixed = np.zeros(len(texts), dtype=bool)
    mixed[text_of[alien]] = True
    out = []
    for k, t in enumerate(texts):
        w, h, n_common, letters = whole[k]
        if not t or w < least_words and h < least_han or _junk(t, w, h, n_common, letters, ids, bounds[k] - sizes[k], bounds[k] - 1):
            out.append(NONE)
            continue
        m = int(main[k])
        langs = [m]
        if mixed[k]:
            for s in range(first[k], last[k] + 1):
                if alien[s] and own[s] not in langs and v[s][own[s]] - v[s][m] >= margin and (s < last[k] or t.rstrip()[-1] in ENDS):
                    langs.append(int(own[s]))
        conf = _conf(total[k]) if len(langs) == 1 else float(cells[k][m] / max(1e-9, cells[k].sum()))
        segs = _spans(t, scorer, langs, margin) if spans and len(langs) > 1 else []
        out.append(Detected(scorer.langs[m], round(conf, 4), tuple(scorer.langs[i] for i in langs), segs))
    return out


def _junk(t: str, w: int, h: int, common: int, letters: int, ids: list[int], a: int, b: int) -> bool:
    """Junk as in the text statistics; clearly natural texts are told from the word counts at hand."""
    if common * 4 >= w + h and letters * 2 > len(t) - t.count(" ") and len(set(ids[a:b])) * 5 > (b - a) * 2 and not ts.may_loop(t):
        return False
    return ts.is_junk(t)


def _spans(text: str, scorer: Scorer, langs: Sequence[int], margin: float) -> list[tuple[str, float, int, int]]:
    """Neighbouring sentences of one language as segments with offsets; unclear sentences stay with the one before."""
    where, v = scorer.segments(text)
    out: list[list] = []
    at = langs[0]
    for k, (a, b, w, h) in enumerate(where):
        best = max(langs, key=lambda i: v[k][i])
        rest = max((v[k][i] for i in langs if i != best), default=-math.inf)
        if v[k][best] - rest >= margin and (w >= 2 or h >= 2):
            at = best
        if out and out[-1][0] == at:
            out[-1][2], out[-1][3] = b, out[-1][3] + v[k]
        else:
            out.append([at, a, b, v[k]])
    return [(scorer.langs[x[0]], round(_conf(x[3]), 4), x[1], x[2]) for x in out]


_scorers: dict[str, Scorer] = {}


def scorer_of(model_id: str, bc) -> Scorer:
    """One scorer per worker process and model, so word scores outlive a task."""
    if model_id not in _scorers:
        _scorers.clear()
        _scorers[model_id] = Scorer(bc.value)
    return _scorers[model_id]


SEGMENTS = T.ArrayType(T.StructType([T.StructField("lang", T.StringType()), T.StructField("conf", T.DoubleType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def detect_languages(df: DataFrame, key: str, text: str, model: LanguageModel) -> DataFrame:
    """key, lang, conf, langs (one, or all of a mixed text) and segments of each text; lang is null where there is none.

    Junk (more than half of the text in no natural form), null, empty and wordless texts have no language. One row per
    row of the input, repeated rows included; no shuffle. The model is bounded by its vocabulary and may be broadcast.
    """
    bc, model_id = df.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = scorer_of(model_id, bc)
        for pdf in batches:
            rows = []
            texts = pdf["t"].tolist()
            for i in range(0, len(texts), 256):
                for d in detect_many(texts[i : i + 256], s):
                    rows.append((d.lang, d.conf, list(d.langs), [dict(zip(("lang", "conf", "start", "end"), x)) for x in d.segments]))
            out = pd.DataFrame(rows, columns=["lang", "conf", "langs", "segments"])
            out.insert(0, "k", pdf["k"].to_numpy())
            yield out

    kind = dict(df.dtypes)[key]
    schema = T.StructType.fromDDL(f"k {kind}, lang string, conf double, langs array<string>").add("segments", SEGMENTS)
    return df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, schema).withColumnRenamed("k", key)


def mislabelled(detected: DataFrame, labels: DataFrame, key: str, label: str) -> DataFrame:
    """A row (key, lang) per language of each text that is mixed, or whose label is missing, no language or wrong.

    ``labels`` may hold no row, or several, for a key; a text is right when one of its labels names one of its languages.
    """
    named = labels.select(F.col(key).alias("k"), label_code(F.col(label)).alias("l")).where("l is not null").groupBy("k").agg(F.collect_set("l").alias("named"))
    d = detected.where("lang is not null").select(F.col(key).alias("k"), "langs").join(named, "k", "left")
    wrong = F.coalesce(~F.arrays_overlap("langs", "named"), F.lit(True)) | (F.size("langs") > 1)
    return d.where(wrong).select(F.col("k").alias(key), F.explode("langs").alias("lang"))
