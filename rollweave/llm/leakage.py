"""Held-out evaluation passages inside corpus documents (problem 7), by template canonicalisation.

Texts are reduced to words (Chinese: characters) without case, punctuation, marks and line breaks. In a template window
numbers (and, in the wider windows, names and units) are typed placeholders. The windows of the documents are hash-joined
with those of the items; where windows of an item gather on one line of a document, an alignment tells the length of the
common passage and the values of its slots: the same values make it verbatim, one consistent mapping to other values a
re-parameterised problem.

Items and their windows stay tables. Only a bitmap of their window hashes is broadcast, of at most ``MOST_BITS`` bits
whatever their number; it thins out the documents' windows before the shuffle and decides nothing.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterable, Iterator, Sequence
from difflib import SequenceMatcher
from functools import cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollweave.llm import textkit as tk
from rollweave.session import cut

#: Words of a narrow and of a wide window, and how many of them must be no placeholder; Chinese windows are longer.
NARROW, NARROW_ZH, NARROW_PLAIN = 5, 6, 3
WIDE, WIDE_ZH, WIDE_PLAIN = 8, 10, 5
LEAST, LEAST_ZH = 20, 40
EDIT_SHARE = 8
SHARED_ITEMS = 3
SHARED_GRAM, SHARED_GRAM_ZH = 8, 12
LEAST_SEEDS = 4
DRIFT = 12
BITS_PER_WINDOW, PROBES, LEAST_BITS, MOST_BITS = 64, 3, 1 << 16, 1 << 29
BREAK_RE = re.compile(r"[-\u2010\u00ad](?<=[^\W\d_].)[^\S\n]*\n\s*(?=[^\W\d_])")
NUMBER_BREAK_RE = re.compile(rf"\n(?<=\d\n)(?=\d+[{tk.CJK}])")
OTHER, LETTER, DIGIT, HAN, UNSEEN = 0, 1, 2, 3, 4
U = np.uint64
NUMBER, NAME, UNIT = U(1), U(2), U(3)
BASE = U(0x9E3779B97F4A7C15)
BASE_INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
PROBE_FACTORS = (U(1), U(0xD6E8FEB86659FD93), U(0xA0761D6478BD642F))
CHUNK = 1 << 18


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per character: its class, its folded form, and whether it ends a sentence or line."""
    kind, fold = np.zeros(0x110000, np.uint8), np.arange(0x110000, dtype=np.uint32)
    for x in (*range(0xD800), *range(0xE000, 0x32000)):
        c = chr(x)
        if c.isalnum():
            kind[x] = DIGIT if c.isdecimal() else LETTER
            low = c.casefold() if len(c.casefold()) == 1 else c.lower()
            if len(low) == 1:
                fold[x] = ord(low)
    kind[[x for x in range(0x10000) if tk.INVISIBLE_RE.match(chr(x))]] = UNSEEN
    kind[[x for x in range(0x3400, 0xFB00) if tk.CJK_RE.match(chr(x))]] = HAN
    stop = np.zeros(0x110000, np.uint8)
    stop[[ord(c) for c in ".!?:;\n。！？：；…"]] = 1
    return kind, fold, stop


_powers = [np.ones(1, U), np.ones(1, U)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and BASE ** -i, modulo 2 ** 64."""
    if len(_powers[0]) < n:
        for i, b in enumerate((BASE, BASE_INVERSE)):
            x = np.full(max(n, 1 << 20), b, U)
            x[0] = 1
            _powers[i] = np.cumprod(x, dtype=U)
    return _powers[0][:n], _powers[1][:n]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> U(30)) * U(0xBF58476D1CE4E5B9)
    h = (h ^ h >> U(27)) * U(0x94D049BB133111EB)
    return h ^ h >> U(31)


@cache
def _unsettled() -> np.ndarray:
    """Which characters Unicode normalisation changes or joins with the one before; all others stay as they are."""
    out = np.zeros(0x110000, bool)
    for x in (*range(0x80, 0xD800), *range(0xE000, 0x2FA20)):
        c = chr(x)
        out[x] = unicodedata.category(c)[0] == "M" or 0x1100 <= x < 0x1200 or unicodedata.normalize("NFKC", c) != c
    return out


def normal(text: str) -> str:
    """The text in one Unicode form, without word breaks at line ends and, before Chinese, breaks inside numbers."""
    text = BREAK_RE.sub("", text)
    if text.isascii():
        return text
    odd = np.flatnonzero(_unsettled()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)])
    if len(odd):
        cuts = np.flatnonzero(np.diff(odd) > 1)
        parts, at = [], 0
        for a, b in zip(odd[np.concatenate(([0], cuts + 1))].tolist(), odd[np.concatenate((cuts, [-1]))].tolist()):
            a = max(at, a - 1)
            parts += [text[at:a], unicodedata.normalize("NFKC", text[a : b + 1])]
            at = b + 1
        text = "".join(parts) + text[at:]
    if "ß" in text or "ẞ" in text:
        text = text.replace("ß", "ss").replace("ẞ", "SS")
    return NUMBER_BREAK_RE.sub("", text)


class Words(NamedTuple):
    """Words of several texts: text of each, class, length, hash, and its forms in the templates (numbers as placeholders;
    numbers, names and units as placeholders)."""

    of: np.ndarray
    kind: np.ndarray
    size: np.ndarray
    exact: np.ndarray
    numbers: np.ndarray
    typed: np.ndarray

    def part(self, a: int, b: int) -> Words:
        return Words(*(x[a:b] for x in self))


def words_of(texts: Sequence[str | None]) -> Words:
    """Vectorised over all characters of the texts. A name is a capitalised word inside a sentence, a unit the word behind a number."""
    kinds, fold, stops = _tables()
    joined = normal("\0".join(t.replace("\0", " ") if t and "\0" in t else t or "" for t in texts) + "\0")
    a = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    k = kinds[a]
    seen = k != UNSEEN
    if not seen.all():
        a, k = a[seen], k[seen]
    ends = np.flatnonzero(a == 0)
    edges = np.concatenate(([0], np.flatnonzero((k[1:] != k[:-1]) | (k[1:] == HAN)) + 1, [len(a)]))
    at, end = edges[:-1], edges[1:]
    real = k[at] != OTHER
    at, end = at[real], end[real]
    low = fold[a]
    up, down = _power_tables(len(a) + 1)
    total = np.concatenate((np.zeros(1, U), np.cumsum((low.astype(U) + U(1)) * up[: len(a)], dtype=U)))
    exact = _mix((total[end] - total[at]) * down[at] + (end - at).astype(U)) | U(8)
    kind = k[at]
    of = np.searchsorted(ends, at)
    numbers = np.where(kind == DIGIT, NUMBER, exact)
    typed = numbers
    if len(at):
        ended = np.concatenate(([0], np.cumsum(stops[a])))
        last_end = np.concatenate(([0], end[:-1]))
        first = np.concatenate(([True], of[1:] != of[:-1])) | (ended[at] > ended[last_end])
        name = (kind == LETTER) & (low[at] != a[at]) & ~first
        unit = np.concatenate(([False], kind[:-1] == DIGIT)) & (kind != DIGIT) & (at - last_end <= 1) & ~first
        typed = np.where(unit, UNIT, np.where(name, NAME, numbers))
    return Words(of, kind, end - at, exact, numbers, typed)


def _roll(ids: np.ndarray, w: int) -> np.ndarray:
    """Hash of every window of w numbers."""
    n = len(ids) - w + 1
    h = np.zeros(max(n, 0), dtype=U)
    for k in range(w if n > 0 else 0):
        h = (h + ids[k : k + n]) * BASE
        h ^= h >> U(29)
    return h


def _plain(ids: np.ndarray, w: int) -> np.ndarray:
    """Words of every window that are no placeholder."""
    c = np.concatenate(([0], np.cumsum(ids > U(7))))
    return c[w:] - c[:-w] if len(ids) >= w else np.zeros(0, int)


def windows(x: Words) -> tuple[np.ndarray, ...]:
    """(position, words, wide, hash, slots) of the template windows of the texts; none crosses from a text to the next.

    A narrow window with few words beside its numbers keeps their values; wide ones are made where they hold a placeholder.
    ``slots`` is a hash of the window with the values of its slots.
    """
    out = []
    for wide, sizes in ((False, (NARROW, NARROW_ZH)), (True, (WIDE, WIDE_ZH))):
        for han, w in zip((False, True), sizes):
            n = len(x.of) - w + 1
            if n <= 0 or han and not (x.kind == HAN).any():
                continue
            ids = x.typed if wide else x.numbers
            h, plain = _roll(ids, w), _plain(ids, w)
            if wide:
                ok = (plain >= WIDE_PLAIN) & (plain < w)
            else:
                ok = np.ones(n, bool)
                values = _roll(x.exact, w)
                h = np.where(plain >= NARROW_PLAIN, h, values)
            ok &= (x.of[:n] == x.of[w - 1 :]) & ((x.kind[:n] == HAN) == han)
            at = np.flatnonzero(ok)
            slots = np.zeros(len(at), np.int32) if wide else (values[at] >> U(32)).astype(np.uint32).view(np.int32)
            out.append((at, np.full(len(at), w), np.full(len(at), wide), _mix(h[at] + U(2 * w + wide)), slots))
    if not out:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0, bool), np.zeros(0, U), np.zeros(0, np.int32)
    return tuple(np.concatenate(c) for c in zip(*out))


def _is_zh(x: Words) -> bool:
    return int((x.kind == HAN).sum()) * 2 > len(x.kind)


def whole(item: np.ndarray, doc: np.ndarray, at: int) -> bool:
    """Whether the document holds the item word for word from ``at`` on."""
    return at >= 0 and np.array_equal(item, doc[at : at + len(item)])


def passage(item: Sequence[int], weight: np.ndarray, doc: Sequence[int]) -> tuple[int, list[tuple[int, int]]]:
    """Weight of the longest passage of ``item`` that stands in ``doc`` with at most one word in eight altered, added or
    dropped; and its pairs of equal positions."""
    n = len(item)
    cost, hit = np.zeros(n + 1), np.zeros(n, dtype=bool)
    pairs: list[tuple[int, int]] = []
    for tag, i1, i2, j1, j2 in SequenceMatcher(None, item, doc, autojunk=False).get_opcodes():
        if tag == "equal":
            hit[i1:i2] = True
            pairs += zip(range(i1, i2), range(j1, j2))
        elif tag == "insert":
            cost[i1] += j2 - j1
        else:
            cost[i1:i2] += 1
            cost[i1] += max(0, (j2 - j1) - (i2 - i1))
    edits = np.concatenate(([0], np.cumsum(cost[:n])))
    got = np.concatenate(([0], np.cumsum(weight)))
    best, where = 0, (0, 0)
    for i in np.flatnonzero(hit).tolist():
        # An insertion before the first word of a passage lies outside it.
        ok = (edits[i + 1 :] - edits[i] - cost[i]) * EDIT_SHARE <= np.arange(1, n - i + 1) + 3
        size = np.where(ok, got[i + 1 :] - got[i], 0)
        j = int(size.argmax())
        if size[j] > best:
            best, where = int(size[j]), (i, i + 1 + j)
    return best, [p for p in pairs if where[0] <= p[0] < where[1]]


def _lines(seeds: Sequence[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """(least, greatest) distance between the positions of document and item, of each line with enough seeds."""
    group: list[tuple[int, int]] = []
    for k, pos in [*sorted(seeds, key=lambda x: (x[0] - x[1], x[0])), (None, None)]:
        if group and (k is None or (k - pos) - (group[-1][0] - group[-1][1]) > DRIFT):
            if len({p for _, p in group}) >= LEAST_SEEDS:
                yield group[0][0] - group[0][1], group[-1][0] - group[-1][1]
            group = []
        if k is not None:
            group.append((k, pos))


def may_pass(item: np.ndarray, weight: np.ndarray, doc: np.ndarray, lo: int, hi: int, least: int) -> bool:
    """Necessary for a passage on the line: enough words of the item stand near it in the document, with few others between."""
    n = len(item)
    at = np.arange(n)[:, None] + np.arange(lo - DRIFT, hi + DRIFT + 1)[None, :]
    inside = (at >= 0) & (at < len(doc))
    hit = ((doc[np.where(inside, at, 0)] == item[:, None]) & inside).any(axis=1)
    if weight.max(initial=0) <= 1 and hit.sum() * EDIT_SHARE < least * (EDIT_SHARE - 1) - 3:
        return False
    missed, got = np.concatenate(([0], np.cumsum(~hit))), np.concatenate(([0], np.cumsum(weight)))
    # The longest end of a passage from i on is where 8 * missed - length is at most that at i, plus 3.
    over = EDIT_SHARE * missed - np.arange(n + 1)
    ok = (over[None, :] - over[:, None] <= 3) & (got[None, :] - got[:, None] >= least)
    return bool(ok.any())


def consistent(item: Words, doc: Words, pairs: Sequence[tuple[int, int]]) -> bool:
    """Whether every value in a slot of the item stands for one value in the document."""
    to: dict[int, int] = {}
    return all(to.setdefault(int(item.exact[i]), int(doc.exact[j])) == int(doc.exact[j]) for i, j in pairs if item.typed[i] <= U(7))


def classify(item: Words, shared: np.ndarray, doc: Words, narrow: Sequence[tuple[int, int]], wide: Sequence[tuple[int, int]]) -> tuple[str, int] | None:
    """(verbatim or reparameterised, size of the passage) of an item in a document with seeds (document, item position); else null.

    Verbatim is a passage whose slots hold the item's values, of at least ``LEAST`` words (``LEAST_ZH`` characters) with one
    in eight altered. Re-parameterised is one of that length in the template with slots mapped to other values, each to one.
    """
    zh = _is_zh(item)
    least = LEAST_ZH if zh else LEAST
    weight = (item.size if zh else np.ones(len(item.size), int)) * ~shared
    n = len(item.exact)
    for name, seeds in (("verbatim", narrow), ("reparameterised", wide)):
        best = 0
        ids = (item.exact, doc.exact) if name == "verbatim" else (item.typed, doc.typed)
        for lo, hi in _lines(seeds):
            if name == "verbatim" and whole(*ids, lo):
                best = max(best, int(weight.sum()))
                continue
            if not may_pass(ids[0], weight, ids[1], lo, hi, least):
                continue
            d = doc.part(max(0, lo - DRIFT), max(0, hi + n + DRIFT))
            if name == "verbatim":
                best = max(best, passage(item.exact.tolist(), weight, d.exact.tolist())[0])
            else:
                size, pairs = passage(item.typed.tolist(), weight, d.typed.tolist())
                if size >= least and consistent(item, d, pairs):
                    best = max(best, size)
        if best >= least:
            return name, best
    return None


def _chunks(texts: Sequence[str | None], most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` characters together; a longer text is alone."""
    a = size = 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if i > a and size + n > most:
            yield a, i
            a, size = i, 0
        size += n
    if a < len(texts):
        yield a, len(texts)


def item_tables(items: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(u, item key, text, shared positions) and (hash, u, pos, wide, slots) of the items. ``u`` tells the items apart.

    Wording shared by three or more items counts neither for windows that lie in it nor towards a passage.
    """
    it = items.select(F.col(key).alias("i"), F.col(text).alias("t")).where(F.col("t").isNotNull()).distinct().withColumn("u", F.xxhash64("i", "t"))
    it = cut(it, "items")

    def grams(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for u, t in zip(pdf["u"], pdf["t"]):
                x = words_of([t])
                h = _roll(x.exact, SHARED_GRAM_ZH if _is_zh(x) else SHARED_GRAM)
                yield pd.DataFrame({"u": np.full(len(h), u), "pos": np.arange(len(h), dtype=np.int32), "g": h.astype(np.int64)})

    g = cut(it.select("u", "t").mapInPandas(grams, "u bigint, pos int, g bigint"), "grams")
    common = g.groupBy("g").agg(F.count_distinct("u").alias("n")).where(F.col("n") >= SHARED_ITEMS).select("g")
    at = g.join(common, "g", "left_semi").groupBy("u").agg(F.collect_set("pos").alias("shared"))
    it = cut(it.join(at, "u", "left"), "items")

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for u, t, shared in zip(pdf["u"], pdf["t"], pdf["shared"]):
                x = words_of([t])
                at, w, wide, h, slots = windows(x)
                inside = np.concatenate(([0], np.cumsum(shared_mask(x, shared))))
                own = inside[at + w] - inside[at] < w
                yield pd.DataFrame({"hash": h[own].astype(np.int64), "u": u, "pos": at[own].astype(np.int32), "wide": wide[own], "slots": slots[own]})

    return it, cut(it.mapInPandas(run, "hash bigint, u bigint, pos int, wide boolean, slots int"), "windows")


def shared_mask(x: Words, starts: Sequence[int] | None) -> np.ndarray:
    mask = np.zeros(len(x.of), bool)
    g = SHARED_GRAM_ZH if _is_zh(x) else SHARED_GRAM
    for s in starts if starts is not None else ():
        mask[s : s + g] = True
    return mask


def bitmap(hashes: DataFrame) -> np.ndarray:
    """Bits set at ``PROBES`` places of every hash; of ``BITS_PER_WINDOW`` bits a hash and ``MOST_BITS`` at most."""
    n = hashes.count()
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << max(1, n * BITS_PER_WINDOW - 1).bit_length()))

    def places(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            p = np.unique(np.concatenate([_place(pdf["hash"].to_numpy().view(U), f, bits) for f in PROBE_FACTORS]))
            yield pd.DataFrame({"c": p >> 16, "b": p & 0xFFFF})

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.zeros(LEAST_BITS, bool)
        x[pdf["b"]] = True
        return pd.DataFrame({"c": pdf["c"].iloc[:1], "x": [np.packbits(x, bitorder="little").tobytes()]})

    out = np.zeros(bits // 8, np.uint8)
    step = LEAST_BITS // 8
    for r in hashes.mapInPandas(places, "c bigint, b bigint").distinct().groupBy("c").applyInPandas(pack, "c bigint, x binary").toLocalIterator():
        out[r["c"] * step : (r["c"] + 1) * step] = np.frombuffer(bytes(r["x"]), np.uint8)
    return out


def _place(h: np.ndarray, factor: np.uint64, bits: int) -> np.ndarray:
    return (h * factor >> U(65 - bits.bit_length())).astype(np.int64)


def may_hold(h: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    """Whether the hashes may be among those of the bitmap."""
    bits = len(bitmap) * 8
    at = np.arange(len(h))
    for f in PROBE_FACTORS:
        p = _place(h[at], f, bits)
        at = at[bitmap[p >> 3] >> (p & 7).astype(np.uint8) & 1 > 0]
    out = np.zeros(len(h), bool)
    out[at] = True
    return out


def find_leaks(docs: DataFrame, items: DataFrame, doc_key: str, doc_text: str, item_key: str, item_text: str, salts: int = 8) -> DataFrame:
    """(doc key, item key, leak, passage_size): documents that hold a passage of an item, verbatim or re-parameterised.

    Documents are read once; only those with ``LEAST_SEEDS`` windows that the bitmap of the items lets through are written
    and joined, by window hash, each hash in ``salts`` parts. Repeated documents are found under each key; null and empty
    texts on either side match nothing; an empty table gives no rows.
    """
    its, wins = item_tables(items, item_key, item_text)
    bc = docs.sparkSession.sparkContext.broadcast(bitmap(wins.select("hash").distinct()))
    doc_type, item_type = dict(docs.dtypes)[doc_key], dict(items.dtypes)[item_key]

    def thin(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = bc.value
        for pdf in batches:
            keys, texts = pdf["k"].tolist(), pdf["t"].tolist()
            for a, b in _chunks(texts):
                x = words_of(texts[a:b])
                at, _, _, h, slots = windows(x)
                at, h, slots = (v[ok] for ok in (may_hold(h, held),) for v in (at, h, slots))
                of = x.of[at]
                order = np.argsort(of, kind="stable")
                at, h, slots, of = at[order], h[order].astype(np.int64), slots[order], of[order]
                first = np.searchsorted(x.of, np.arange(b - a))
                cuts = np.searchsorted(of, np.arange(b - a + 1))
                rows = [i for i in range(b - a) if cuts[i + 1] - cuts[i] >= LEAST_SEEDS]
                if not rows:
                    continue
                yield pd.DataFrame(
                    {
                        "k": pd.Series([keys[a + i] for i in rows], dtype=pdf["k"].dtype),
                        "t": [texts[a + i] for i in rows],
                        "pos": [at[cuts[i] : cuts[i + 1]] - first[i] for i in rows],
                        "hash": [h[cuts[i] : cuts[i + 1]] for i in rows],
                        "slots": [slots[cuts[i] : cuts[i + 1]] for i in rows],
                    }
                )

    seen = docs.select(F.col(doc_key).alias("k"), F.col(doc_text).alias("t")).mapInPandas(thin, f"k {doc_type}, t string, pos array<int>, hash array<bigint>, slots array<int>")
    seen = cut(seen.withColumn("r", F.monotonically_increasing_id()), "thinned")
    hits = seen.select("r", F.explode(F.arrays_zip("pos", "hash", "slots")).alias("h")).select("r", F.col("h.pos").alias("d"), F.col("h.hash").alias("hash"), F.col("h.slots").alias("values"), F.pmod("r", F.lit(salts)).alias("salt"))
    side = wins.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
    # Slot consistency: of a narrow template the slots must hold the item's values; wide ones are held against each other below.
    agree = hits.join(side, ["hash", "salt"]).where(F.col("wide") | (F.col("values") == F.col("slots")))
    seeds = agree.groupBy("r", "u").agg(F.collect_list(F.struct("d", F.col("pos").alias("p"), "wide")).alias("seeds"), F.count_if("wide").alias("n_wide"), F.count_if(~F.col("wide")).alias("n_narrow"))
    seeds = seeds.where((F.col("n_wide") >= LEAST_SEEDS) | (F.col("n_narrow") >= LEAST_SEEDS)).select("r", "u", "seeds")
    pairs = seeds.join(seen.select("r", "k", "t"), "r").join(its.withColumnRenamed("t", "item"), "u")
    # The check costs more than its bytes tell.
    parts = max(2 * docs.sparkSession.sparkContext.defaultParallelism, seen.count() // 20_000)
    pairs = pairs.repartition(parts, "r", "u")

    def check(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            texts: dict[int, Words] = {}
            parsed: dict[int, tuple[Words, np.ndarray]] = {}
            for r, u, k, i, t, item, shared, found in zip(*(pdf[c] for c in ("r", "u", "k", "i", "t", "item", "shared", "seeds"))):
                by = defaultdict(list)
                for s in found:
                    by[s["wide"]].append((s["d"], s["p"]))
                if not any(True for x in by.values() for _ in _lines(x)):
                    continue
                if r not in texts:
                    if len(texts) > 64:
                        texts.clear()
                    texts[r] = words_of([t])
                if u not in parsed:
                    x = words_of([item])
                    parsed[u] = x, shared_mask(x, shared)
                got = classify(*parsed[u], texts[r], by[False], by[True])
                if got:
                    out.append((k, i, *got))
            if not out:
                continue
            yield pd.DataFrame(out, columns=["d", "i", "leak", "passage_size"])

    return pairs.mapInPandas(check, f"d {doc_type}, i {item_type}, leak string, passage_size int").withColumnsRenamed({"d": doc_key, "i": item_key}).distinct()
