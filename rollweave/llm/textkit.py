"""Plain-text primitives shared by the text operators: words, sentences, scripts, common words."""

from __future__ import annotations

import re
from collections import Counter

LANGS = ("en", "zh", "de", "fr", "es", "ru", "pt")

CJK = "\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff"
CJK_RE = re.compile(f"[{CJK}]")
WORD_RE = re.compile(rf"[{CJK}]+|[^\W\d_{CJK}]+(?:['’][^\W\d_{CJK}]+)*")
INVISIBLE_RE = re.compile("[\u00ad\u034f\u061c\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufe00-\ufe0f\ufeff\u3164]")
TAG_RE = re.compile(r"<\|[^<>|\n]{1,40}\|>|</?(?:think|answer|solution|user|assistant|system|s|pad|unk)>|\[/?(?:task|INST|inst)\]", re.I)
#: LaTeX commands, mark-up tags and entities: never words of a language.
MARKUP_RE = re.compile(r"\\(?:begin|end)\{[^{}\n]*\}(?:\{[^{}\n]*\})?|\\[a-zA-Z]+|</?[a-zA-Z][^<>\n]{0,80}>|&[a-zA-Z]{2,8};|\$\$?[^$\n]{1,200}\$\$?")
SENT_RE = re.compile(rf"[^.!?。！？…\n]*(?:[.!?…]+(?=[\s\"'”’»)*\]]|$|[{CJK}])[\"'”’»)*\]]*|[。！？]+[”’」』）]*|[.!?…]+|\n|$)")

#: Frequent function words by language, the base of the common-word share.
COMMON = {
    "en": "the of and a to in is that it for on with as was be by this are at from or an have has not but which one all so we can there if more when would other than then its also into only some could these two may first what any each must no how them our out up they their he she his her you your i me my will do does did after before because about between over both same most such let left now here once where while who whose every until since still unless nothing therefore hence".split(),
    "de": "der die das und in zu den mit von ist des auf für im dem nicht ein eine einen einer als auch es an werden aus er hat dass sie nach wird bei um am sind noch wie über so zum war haben nur oder aber vor zur bis mehr durch man sein wurde wenn wir ich also damit ergibt alle beide zwischen keine dann daher jeweils jeder jede dieser diese wäre gleich kann muss".split(),
    "fr": "le la les de des et un une est à du en dans que qui pour par sur au aux ce il elle ne pas plus se sont avec comme mais ou cette ces son sa ses je nous vous on donc être a ont été si tout tous toute leur entre deux chaque chacun après avant même sans quel quelle y déjà alors ainsi".split(),
    "es": "el la los las de y en que un una es a del por con no se para al lo como más pero su sus si ya o este esta esto son fue ha muy también hay cada entre cuando todo sin sobre ser tiene dos ambos me mi yo así ese esa eso porque después donde cuál cuántos cuántas queda quedan solo".split(),
    "ru": "и в не на что с по это как а к из у за от о для но он она они мы я же так его их был была было бы или при если то до все только ещё уже чем этот эта эти каждый каждой каждая обе так так поэтому следовательно когда который также можно нет две два равно равна ли со во".split(),
    "pt": "o a os as de e em que um uma é do da dos das por com não se para ao no na como mais mas seu sua já ou este esta isso são foi tem muito também há cada entre quando todo sem sobre ser dois ambos me eu assim esse essa porque depois onde qual quantos quantas restam só".split(),
}
#: Frequent Chinese characters.
COMMON_ZH = frozenset("的是了在和有我不这为所以因此个到与中上下对于等后把被将从就也都而可要会能其它他们你以及或如果那么且之者此")

LATIN_LANGS = tuple(x for x in LANGS if x != "zh")
_BIT = {lang: 1 << i for i, lang in enumerate(LATIN_LANGS)}
COMMON_BITS: dict[str, int] = {}
for _lang, _words in COMMON.items():
    for _w in _words:
        COMMON_BITS[_w] = COMMON_BITS.get(_w, 0) | _BIT[_lang]

_NAMES = {
    "en": "en eng english anglais englisch inglés",
    "zh": "zh zho chi cmn chinese mandarin 中文 汉语 chinois chinesisch cn",
    "de": "de deu ger german deutsch allemand alemán",
    "fr": "fr fra fre french français französisch francés",
    "es": "es spa spanish español castellano espagnol spanisch",
    "ru": "ru rus russian русский russe russisch",
    "pt": "pt por portuguese português",
}
LABELS = {name: lang for lang, names in _NAMES.items() for name in names.split()}


def norm_label(label: object) -> str | None:
    """Two-letter code of a language label in any spelling (code, locale, three letters, name), else None."""
    if not isinstance(label, str):
        return None
    return LABELS.get(re.split(r"[-_]", label.strip().lower())[0])


def words(text: str) -> list[str]:
    return WORD_RE.findall(text)


_ASCII_WORD_RE = re.compile(r"[a-z]+(?:'[a-z]+)*")


def lower_words(text: str) -> list[str]:
    """Words of the lower-cased text; Chinese as runs between other characters."""
    return _ASCII_WORD_RE.findall(text.lower()) if text.isascii() else WORD_RE.findall(text.lower())


def n_units(ws: list[str]) -> tuple[int, int]:
    """Number of words of two letters or more in alphabetic scripts, and of Chinese characters."""
    han = sum(len(w) for w in ws if CJK_RE.match(w))
    return sum(1 for w in ws if len(w) > 1 and not CJK_RE.match(w)), han


def sentences(text: str) -> list[tuple[int, int]]:
    """Offsets of the non-blank sentences; a sentence ends with its terminator or at a line break."""
    out = []
    for m in SENT_RE.finditer(text):
        if m.end() > m.start() and not m[0].isspace():
            out.append((m.start(), m.end()))
    return out


CYR_RE = re.compile("[\u0400-\u04ff]")
_MASK_HITS: dict[int, tuple[int, ...]] = {m: tuple(m >> i & 1 for i in range(len(LATIN_LANGS))) for m in set(COMMON_BITS.values())}


def quick_language(ws: list[str]) -> str:
    """Language of lower-case words by script and common words alone: cheap, for grouping statistics."""
    joined = "".join(ws)
    if not joined.isascii():
        han, cyr = len(CJK_RE.findall(joined)), len(CYR_RE.findall(joined))
        if han and han * 4 >= len(joined):
            return "zh"
        if cyr * 2 > len(joined):
            return "ru"
    hits = [0] * len(LATIN_LANGS)
    for m, n in Counter([COMMON_BITS[w] for w in ws if w in COMMON_BITS]).items():
        for i, b in enumerate(_MASK_HITS[m]):
            if b:
                hits[i] += n
    best = max(range(len(hits)), key=hits.__getitem__)
    return LATIN_LANGS[best] if hits[best] else "und"
