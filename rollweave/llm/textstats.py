"""Per-document text statistics and the shape of a text: prose, list, table or junk (problem 2).

``profile`` computes the statistics of one text. ``describe`` turns them, per language, into
percentiles and robust z-scores by means of merged quantile sketches; a text whose list, table or
junk share lies in the upper tail of its language, as the sketches tell it, is of that kind.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollweave.llm import sketch
from rollweave.llm import textkit as tk
from rollweave.session import cut

STATS = ("n_chars", "n_words", "mean_word_len", "symbol_ratio", "digit_ratio", "n_lines", "punct_line_share", "common_share", "distinct_share", "list_share", "table_share", "loop_share", "junk_share")

BULLET_RE = re.compile(
    r"(?:(?:[-*•‣◦▪●–·+→⇒]|[-=]>)\s|\(?\d{1,3}[.):](?!\d)|\(?[a-zA-Z][.)]\s|\(?[ivxIVX]{1,4}[.)]\s|\*\*\d{1,3}\*\*|#\d{1,3}\b|\[\d{1,3}\]|\[[ xX✓]?\]\s|[①-⑳]|[一二三四五六七八九十]{1,3}[、.)]"
    r"|第[一二三四五六七八九十\d]{1,3}[步条项]?[：:、]|(?:Case|Step|Item|Part|Fall|Schritt|Cas|Étape|Caso|Paso|Случай|Шаг|情形|情况|步骤)\s*\d{1,3}\s*[:.)：])"
)
KV_RE = re.compile(r"[^:：=.!?。？！|\n$]{1,32}\s*[:：=]\s*\S[^\n]{0,24}$")
BORDER_RE = re.compile(r"[+|:\-=─━┌┬┐├┼┤└┴┘│\s]{5,}$")
HTML_RE = re.compile(r"</?(?:table|tr|td|th|thead|tbody)\b", re.I)
LATEX_ROW_RE = re.compile(r"\\(?:begin|end)\{(?:tabular|array|matrix|table)|\\hline|\\(?:top|mid|bottom)rule")
NUM_ITEM_RE = re.compile(r"[-+]?\d[\d.,]*\s+\S+(?:\s\S+)?$")
SEP_RE = re.compile(r"[;,，；、•·]\s*")
CYR_RE = re.compile("[\u0400-\u04ff]")
OTHER_RE = re.compile(rf"[^\W\d_\u0041-\u024f\u1e00-\u1eff\u0400-\u04ff{tk.CJK}]")
#: What may hold characters of CJK_RE, CYR_RE or OTHER_RE.
FAR_RE = re.compile("[^\x00-\u024f]+")
SPECIAL_RE = re.compile(r"<\|?/?[a-zA-Z_]{1,20}\|?>|\[[A-Z]{3,5}\]")
HEX_RE = re.compile(r"(?:0x)?[0-9a-fA-F]{4,16}[:\s]\s*(?:[0-9a-fA-F]{2}\s?){4,}")
ENDS = tuple(".!?。！？…:;：；\"”’»)]}$*`>")


WIDE_BLANK_RE = re.compile(r"\s{2,}")
BLANKS = np.array([ord(c) for c in " \t\r\n\u00a0\u3000"], dtype=np.uint32)


def latex_row(line: str) -> bool:
    return line.endswith("\\\\") and "&" in line or bool(LATEX_ROW_RE.match(line))


def _joined(h: np.ndarray, g: np.ndarray, at: int) -> np.ndarray:
    """Hashes of the windows made of one of ``h``, ``at`` characters long, and the one of ``g`` behind it."""
    n = min(len(h), len(g) - at)
    return (h[:n] ^ h[:n] >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) + g[at : at + n] * np.uint64(0x94D049BB133111EB)


def _windows(a: np.ndarray, size: int) -> np.ndarray:
    """A hash of every window of ``size`` (a power of two) characters."""
    h, k = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019), 1
    while k < size:
        h = _joined(h, h, k)
        k *= 2
    return h


def _eights(text: str) -> np.ndarray:
    """A number for every window of eight characters: their bytes, or a hash of these."""
    n = len(text) - 7
    try:
        return np.ndarray((n,), np.uint64, text.encode("latin-1"), 0, (1,))
    except UnicodeEncodeError:
        b = text.encode("utf-16-le", "surrogatepass")
    if len(b) == 2 * len(text):
        return np.ndarray((n,), np.uint64, b, 0, (2,)) * np.uint64(0x9E3779B97F4A7C15) ^ np.ndarray((n,), np.uint64, b, 8, (2,))
    return _windows(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32), 8)


def may_loop(text: str) -> bool:
    """Necessary for loops (of 42 characters or more each) over more than half of the text: a quarter of its windows of
    eight characters recur.

    A run of r characters has r - 7 windows, of which at most r / 3 differ: half of r or more recur.
    """
    n = len(text)
    if n < 96:
        return n >= 12
    h = np.sort(_eights(text))
    return np.count_nonzero(h[1:] == h[:-1]) * 4 >= n


def _long_periods(a: np.ndarray, least: int) -> Iterator[int]:
    """Every period of ``least`` characters or more of a run that holds its unit three times.

    In such a run a window of 1 to 1.5 periods recurs first after one period, so the distances at which windows of sizes
    that grow by half recur give all periods; equal hashes are candidates only.
    """
    half = 1 << (least.bit_length() - 2)
    below = least - 1
    if below >= len(a) * 2 // 5:
        return
    g = _windows(a, half)
    while below < len(a) * 2 // 5:
        h = _joined(g, g, half)  # 2 * half
        for size, w in ((2 * half, h), (3 * half, _joined(h, g, 2 * half))):
            order = np.argsort(w, kind="stable")
            gap = np.diff(order)[w[order[1:]] == w[order[:-1]]]
            yield from np.unique(gap[(gap > below) & (gap <= min(size, len(a) * 2 // 5))]).tolist()
            below = max(below, size)
        g, half = h, 2 * half


def loop_coverage(text: str, short_period: int = 260) -> float:
    """Share of the text inside runs that repeat a unit three times or more, the blanks after the last one not counted.

    Units up to ``short_period`` characters are tried one by one, longer ones as the recurrence of their windows gives them.
    """
    a = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    n, best = len(a), 0
    solid = np.append(np.flatnonzero(~np.isin(a, BLANKS)), n)
    for p in chain(range(1, min(n * 2 // 5, short_period) + 1), _long_periods(a, short_period + 1)):
        eq = a[p:] == a[:-p]
        if np.count_nonzero(eq) * 3 < n:
            continue
        edge = np.flatnonzero(np.diff(np.concatenate(([0], eq.view(np.int8), [0]))))
        runs, end = edge[1::2] - edge[::2], edge[1::2]
        blank = solid[np.searchsorted(solid, end)] - end  # blanks that the unit would go on with
        runs = runs[(runs + np.minimum(blank, p // 2) >= 2 * p) & (runs >= 12)]
        best = max(best, int(runs.sum()) + p * len(runs))
        if best > 0.9 * n:
            break
    return min(1.0, best / n) if n else 0.0


def _cells(line: str) -> tuple[str, int] | None:
    """Delimiter and number of cells of a line that looks like a row of short cells."""
    for d in ("\t", "|", ",", ";"):
        c = line.count(d)
        if c and len(line) <= 24 * (c + 1) and (d in "\t|" or f"{d} " not in line):
            return d, c + 1
    if "  " not in line and "\t" not in line and line.isascii():
        return None
    parts = WIDE_BLANK_RE.split(line)
    if len(parts) > 2 and len(line) <= 30 * len(parts):
        return "  ", len(parts)
    return None


def _natural(piece: str, strict: int = 9, ws: list[str] | None = None) -> float:
    """1 for natural language, 0 for what no language explains, 0.5 where too little is there to tell.

    One common word in ``strict`` words (characters, for Chinese: in 1.5 times that) is asked for. ``ws`` are the words of
    the piece where they are at hand; mark-up does not count among them.
    """
    s = piece
    if "\\" in piece or "<" in piece or "$" in piece or "&" in piece:
        s, ws = tk.MARKUP_RE.sub(" ", piece), None
    if ws is None:
        ws = tk.lower_words(s)
    lens = list(map(len, ws))
    letters = sum(lens)
    if letters == 0 or letters * 4 < len(piece) - piece.count(" "):
        alnum = sum(map(str.isalnum, piece))
        return 0.5 if alnum * 5 >= len(piece.strip()) * (1 if "$" in piece or "\\" in piece else 2) or len(piece) < 12 else 0.0
    han = other = 0
    if not s.isascii():
        far = "".join(FAR_RE.findall(s))
        han, cyr, other = len(tk.CJK_RE.findall(far)), len(CYR_RE.findall(far)), len(OTHER_RE.findall(far))
        lat = letters - han - cyr - other
        if other * 5 > letters or (han * 12 > letters) + (cyr * 12 > letters) + (lat * 12 > letters) + (other * 12 > letters) >= 3:
            return 0.0
    if han * 3 >= letters:
        return 0.5 if han < 6 else 1.0 if sum(map(s.count, tk.COMMON_ZH)) * strict * 3 >= han * 2 else 0.0
    n = len(lens) - lens.count(1)
    if n < 4:
        return 0.0 if letters > 30 * max(1, len(ws)) else 0.5
    return 1.0 if sum(map(tk.COMMON_BITS.__contains__, ws)) * strict >= n else 0.0


def shape(text: str) -> tuple[float, float, float, float]:
    """Shares of the text's characters in list entries, table rows, repeating runs and unexplained stretches."""
    special = SPECIAL_RE.findall(text) if "<" in text or "[" in text else ()
    if len(special) >= 8 and sum(map(len, special)) * 3 > len(text) and not HTML_RE.search(text):
        return 0.0, 0.0, 0.0, 1.0
    lines = [x.strip() for x in (tk.TAG_RE.sub(" ", text) if special else text).split("\n")]
    lines = [x for x in lines if x and not x.startswith("```")]
    total = sum(map(len, lines))
    if not total:
        return 0.0, 0.0, 0.0, 0.0
    in_list = in_table = junk = neutral = 0
    rest: list[str] = []
    shorts: list[str] = []
    rows: list[tuple[str, tuple[str, int]]] = []

    def flush() -> None:
        nonlocal in_table
        if len(rows) >= 3 or len(rows) == 2 and rows[0][1][1] > 2:
            in_table += sum(len(x) for x, _ in rows)
        else:
            for x, _ in rows:
                place(x)
        rows.clear()

    def place(x: str) -> None:
        nonlocal in_list, junk
        if HEX_RE.match(x):
            junk += len(x)
        elif BULLET_RE.match(x):
            in_list += len(x)
        elif KV_RE.match(x) or NUM_ITEM_RE.match(x):
            shorts.append(x)
        else:
            rest.append(x)

    for x in lines:
        if x.count("|") >= 2 and (x[0] == "|" or x[-1] == "|") or HTML_RE.search(x) or latex_row(x) or len(x) >= 5 and BORDER_RE.match(x) and len(set(x) - {" "}) > 1 and x[0] in "+|┌├└│:":
            flush()
            in_table += len(x)
            continue
        cells = _cells(x)
        if cells:
            if rows and rows[-1][1] != cells:
                flush()
            rows.append((x, cells))
            continue
        flush()
        place(x)
    flush()
    if len(shorts) >= 3 or in_list:
        in_list += sum(map(len, shorts))
    else:
        rest += shorts
    for x in rest:
        items = SEP_RE.split(x)
        if len(items) >= 5 and len(x) <= 26 * len(items) and sum(bool(NUM_ITEM_RE.match(i)) or bool(KV_RE.match(i)) for i in items) * 2 > len(items):
            in_list += len(x)
            continue
        if _natural(x, 6) == 1.0:
            continue
        for s in tk.SENT_RE.findall(x):
            if s:
                v = _natural(s)
                if v == 0.0:
                    junk += len(s)
                elif v == 0.5:
                    neutral += len(s)
    base = max(1, total - (neutral if neutral < total / 2 else 0))
    return in_list / base, in_table / base, 0.0, junk / base


def profile(text: str | None) -> tuple:
    """Language by common words, then the statistics of ``STATS``. Null counts as the empty text."""
    t = (text or "").strip()
    n = len(t)
    if not n:
        return ("und", *([0.0] * len(STATS)))
    ws = tk.lower_words(t)
    nw = len(ws)
    lang = tk.quick_language(ws)
    letters = sum(map(len, ws))
    if lang == "zh":
        common = sum(map(t.count, tk.COMMON_ZH)) / max(1, letters)
    else:
        common = sum(map(tk.COMMON_BITS.__contains__, ws)) / max(1, nw)
    digits = sum(map(t.count, "0123456789"))
    symbols = max(0, n - letters - digits - (n - sum(map(len, t.split()))))
    lines = [x for x in t.split("\n") if x and not x.isspace()]
    ended = sum(1 for x in lines if x.rstrip().endswith(ENDS))
    distinct = len(set(ws)) / max(1, nw)
    in_list, in_table, loop, junk = shape(t)
    if in_table < 0.5 and (distinct < 0.4 or (symbols + digits) * 3 > n or may_loop(t)):
        loop = loop_coverage(t)
        if loop > 0.5:
            junk = max(junk, loop)
            in_list = in_list if loop < 0.6 else 0.0
    return (
        lang, float(n), float(nw), letters / max(1, nw), symbols / n, digits / n, float(len(lines)), ended / len(lines), common, distinct,
        min(1.0, in_list), min(1.0, in_table), loop, min(1.0, junk),
    )


def is_junk(text: str, least_chars: int = 30) -> bool:
    """Whether more than half of the text is in no natural form; the junk part of ``profile`` alone."""
    t = text.strip()
    n = len(t)
    if n < least_chars:
        return False
    ws = tk.lower_words(t)
    if _natural(t, 5, ws) == 1.0 and len(set(ws)) * 5 > len(ws) * 2 and (n - sum(map(len, ws)) - t.count(" ")) * 3 < n and not may_loop(t):
        return False
    p = profile(t)
    return p[-1] >= 0.5 and p[-1] >= max(p[-4], p[-3])


STATS_DDL = "lang_guess string, " + ", ".join(f"{s} double" for s in STATS)


def text_statistics(df: DataFrame, key: str, text: str, flags: Mapping[str, tuple[str, Callable[[str, str], bool]]] | None = None) -> DataFrame:
    """A row per row of ``df``: key, language by common words, statistics. Python in Arrow batches, no shuffle.

    ``flags`` adds boolean columns: name -> (other column, test of the text and that column), for telling apart the texts
    whose list, table or junk share may lie in a tail (see ``TAIL_RANGE``); false for all others.
    """
    flags = dict(flags or {})

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [profile(x) for x in pdf["t"]]
            out = pd.DataFrame(rows, columns=["lang_guess", *STATS])
            for i, (name, (_, test)) in enumerate(flags.items()):
                out[name] = [max(r[-1], r[-3], r[-4]) >= TAIL_RANGE[0] and test(t, o) for r, t, o in zip(rows, pdf["t"], pdf[f"o{i}"])]
            out.insert(0, "k", pdf["k"].to_numpy())
            yield out

    kind = dict(df.dtypes)[key]
    extra = [F.col(c).alias(f"o{i}") for i, (c, _) in enumerate(flags.values())]
    ddl = f"k {kind}, {STATS_DDL}" + "".join(f", {name} boolean" for name in flags)
    return df.select(F.col(key).alias("k"), F.col(text).alias("t"), *extra).mapInPandas(run, ddl).withColumnRenamed("k", key)


GRID = tuple(i / 20 for i in range(21))
#: Percentiles by which the beginning of a tail is sought, where it may lie, and how wide the valley before it must be.
FINE_GRID = tuple(i / 400 for i in range(401))
TAIL_RANGE, VALLEY = (0.25, 0.75), 0.1


def baseline_sketches(stats: DataFrame, metrics: Iterable[str] = STATS) -> DataFrame:
    """Merged sketches of each statistic per language and, under '*', over all: at most (languages + 1) * statistics rows."""
    groups = {"lang": F.col("lang_guess"), "all": F.lit("*")}
    return cut(sketch.merge_sketches(sketch.partial_sketches(stats, groups, {m: F.col(m) for m in metrics}, k=256)), "baseline")


def grids(sketches: DataFrame, ps: Sequence[float] = GRID) -> DataFrame:
    """(grp, g): of each language, and of all under '*', the quantile grid of each statistic. As small as the sketches, so it may be broadcast."""
    q = sketch.read_quantiles(sketches, ps).groupBy("grp", "metric").agg(F.sort_array(F.collect_list(F.struct("p", "estimate")))["estimate"].alias("grid"))
    return cut(q.groupBy("grp").agg(F.map_from_entries(F.collect_list(F.struct("metric", "grid"))).alias("g")), "grids")


def tail_start(grid: Column) -> Column:
    """Where the upper tail of a share begins: the middle of the widest valley of its distribution that lies in ``TAIL_RANGE``;
    a half, the greater part of a text, where no valley of width ``VALLEY`` lies there."""
    steps = F.transform(F.sequence(F.lit(1), F.size(grid) - 1), lambda i: F.struct((F.get(grid, i) - F.get(grid, i - 1)).alias("width"), ((F.get(grid, i) + F.get(grid, i - 1)) / 2).alias("middle")))
    valleys = F.filter(steps, lambda x: (x["width"] >= VALLEY) & x["middle"].between(*TAIL_RANGE))
    return F.coalesce(F.array_max(valleys)["middle"], F.lit(0.5))


def _z(x: Column, grid: Column, floor: float) -> Column:
    return (x - grid[10]) / F.greatest((grid[15] - grid[5]) / F.lit(1.349), F.lit(floor))


def _steps_upto(grid: Column, x: Column) -> Column:
    """Number of grid steps not above x, from 0 to 20."""
    return F.greatest(F.size(F.filter(grid, lambda q: q <= x)) - 1, F.lit(0))


def describe(stats: DataFrame, metrics: Iterable[str] = STATS, floor: float = 0.05, sketches: DataFrame | None = None) -> DataFrame:
    """Adds for each metric m: m_z, the robust z-score (median and quartiles of the language; the larger one of
    that and of all texts together), and m_pct, the percentile within the language in steps of 5."""
    metrics = list(metrics)
    base = grids(baseline_sketches(stats, metrics) if sketches is None else sketches)
    own = base.where("grp <> '*'").select(F.col("grp").alias("lang_guess"), F.col("g").alias("own"))
    every = base.where("grp = '*'").select(F.col("g").alias("every"))
    j = stats.join(F.broadcast(own), "lang_guess", "left").join(F.broadcast(every), F.lit(True), "left")
    new = {}
    for m in metrics:
        x, a, b = F.col(m), F.col("own")[m], F.col("every")[m]
        new[f"{m}_z"] = F.greatest(_z(x, a, floor), _z(x, b, floor))
        new[f"{m}_pct"] = _steps_upto(a, x) * 5
    return j.withColumns(new).drop("own", "every")


KINDS = ("list", "table", "junk")


def kinds(stats: DataFrame, least_z: float = 3.0, least_chars: int = 30) -> DataFrame:
    """Adds ``kind``: prose, list, table or junk; the largest of the shares that lie in a tail of their language.

    The sketches decide what a tail is: the share must lie ``least_z`` robust deviations above the median and beyond the
    valley that parts the texts of the language with much of the kind from those with little (``tail_start``). Texts of
    fewer than ``least_chars`` characters are prose.
    """
    shares = [f"{k}_share" for k in KINDS]
    sketches = baseline_sketches(stats, shares)
    d = describe(stats, shares, sketches=sketches)
    tails = grids(sketches, FINE_GRID).where("grp <> '*'").select(F.col("grp").alias("lang_guess"), *(tail_start(F.col("g")[m]).alias(f"{m}_from") for m in shares))
    d = d.join(F.broadcast(tails), "lang_guess", "left")
    tail = {k: F.when((F.col(f"{k}_share_z") >= least_z) & (F.col(f"{k}_share") >= F.coalesce(F.col(f"{k}_share_from"), F.lit(0.5))) & (F.col("n_chars") >= least_chars), F.col(f"{k}_share")).otherwise(0.0) for k in KINDS}
    top = F.greatest(*tail.values())
    kind = F.when(top == 0, "prose").when(tail["table"] == top, "table").when(tail["list"] == top, "list").otherwise("junk")
    return d.withColumn("kind", kind)
