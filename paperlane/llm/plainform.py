"""One plain form for text that looks the same but has different characters.

The mapping is precomputed from the Unicode tables of the interpreter and compiled into a trie over code points:
single characters (full-width, half-width and other compatibility forms, invisible characters, spaces) and
clusters (a letter and the marks coded apart from it in any order that means the same, half-width kana with its voicing
mark).  Conflicts are checked when it is built: no source may have two images, and no image may contain a source.

The transducer goes over a text once.  At each place it takes the trie's longest source; each image letter joins the letter before
it where both have a composed form, so a mark finds its letter across what was invisible between them.  At the end of
a word that mixes Latin with Greek or Cyrillic letters, the word is written in one script: in Latin if all its other letters look
like Latin ones, else in the other script if all its Latin letters look like that one's, else in Latin with the rest romanised.
Sources have at most a few characters, so the time is linear in the text.

Defined results: NULL stays NULL and empty stays empty; tab and line ends, ideographs (compatibility ideographs
included) and ordinary kana are never changed; a letter with a mark for which no composed letter exists is
plain; the plain form of any text is in plain form.
"""

from __future__ import annotations

import functools
import re
import sys
import unicodedata
from collections.abc import Iterator
from itertools import permutations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Greek and Cyrillic letters that look like Latin ones, and the Latin letters.
GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαικνορτυχϲϳ"
GREEK_AS_LATIN = "ABEZHIKMNOPTYXaikvoptuxcj"
CYRILLIC = "АВЕЅІЈКМНОРСТУХасеіјорѕухһԛԝѵЁёЇї"
CYRILLIC_AS_LATIN = "ABESIJKMHOPCTYXaceijopsyxhqwvËëÏï"
# Latin letters for the names of Greek and Cyrillic letters; other letters are written by their name.
ROMAN = dict(x.split(":") for x in (
    "alpha:a beta:b gamma:g delta:d epsilon:e zeta:z eta:i theta:th iota:i kappa:k lamda:l mu:u nu:n xi:x omicron:o pi:p rho:r sigma:s tau:t upsilon:y phi:f chi:ch psi:ps omega:o "
    "a:a be:b ve:v ghe:g de:d ie:e io:e zhe:zh ze:z i:i ka:k el:l em:m en:n o:o pe:p er:r es:s te:t u:u ef:f ha:h tse:ts che:ch sha:sh shcha:shch sign:j yeru:y e:e yu:yu ya:ya yi:i je:j lje:lj nje:nj dje:dj gje:g kje:k dzhe:dz"
).split())

#: Invisible characters that are not of category Cf.
_UNSEEN = {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0x180B, 0x180E), *range(0xFE00, 0xFE10)}
_IDEOGRAPHS = ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))
_LETTER = {"latin": "A-Za-zªºÀ-ÖØ-öø-ʯḀ-ỿⱠ-Ɀ", "greek": "Ͱ-ͳͶͷΆΈ-Ͽἀ-ῼ", "cyrillic": "Ѐ-ҁҊ-ԯ"}
_MARK = "̀-ͯ"
WORD = re.compile(f"[{''.join(_LETTER.values())}{_MARK}]+")
_LATIN, _GREEK, _CYRILLIC = (re.compile(f"[{x}]") for x in _LETTER.values())
_OTHER = re.compile(f"[{_LETTER['greek']}{_LETTER['cyrillic']}]")
#: Texts without any other character are in plain form; for the scan, so that most rows never reach Python.
#: Greek and Cyrillic are left out, as words may mix them with Latin.
SURELY_PLAIN = r"^[\t\n\r -~¡-§©«¬®°±¶·»¿-ÿĀ-ıĴ-ľŁ-ňŊ-ž‐‒-―‘-‟†-•‰‹›₠-₧€、-〃〇-〒〓々ぁ-ゖゝゞァ-ヾ一-鿿]*$"

_SURELY = re.compile(SURELY_PLAIN)


class MappingConflict(ValueError):
    """Two images for one source, or an image that contains a source."""


def _is_ideograph(code: int) -> bool:
    return any(a <= code <= b for a, b in _IDEOGRAPHS)


@functools.lru_cache(maxsize=1)
def mapping() -> dict[str, str]:
    """Source (a character or a cluster) -> image."""
    out: dict[str, str] = {}

    def put(source: str, image: str) -> None:
        if out.setdefault(source, image) != image:
            raise MappingConflict(f"{source!r}: {out[source]!r} and {image!r}")

    composed: list[tuple[str, str]] = []
    for code in range(0x80, sys.maxunicode + 1):
        c = chr(code)
        kind = unicodedata.category(c)
        if kind in ("Cn", "Cs", "Co") or _is_ideograph(code):
            continue
        if kind == "Cf" or code in _UNSEEN:
            put(c, "")
        elif kind == "Zs":
            put(c, " ")
        elif (image := unicodedata.normalize("NFKC", c)) != c:
            put(c, "".join(x for x in image if unicodedata.category(x) != "Cf"))
        if len(apart := unicodedata.normalize("NFD", c)) > 1 and unicodedata.normalize("NFC", apart) == c:
            composed.append((apart, c))
    for apart, c in composed:
        image = out.get(c, c)  # what is composed may itself be a compatibility form
        put(apart, image)
        for marks in permutations(apart[1:]):  # marks that don't meet may stand in any order
            if unicodedata.normalize("NFD", other := apart[0] + "".join(marks)) != apart:
                continue
            put(other, image)
            for k in range(2, len(other)):  # a letter composed in part
                if (part := unicodedata.normalize("NFC", other[:k]) + other[k:]) != c:
                    put(part, image)
    for code in range(0xFF66, 0xFF9E):  # half-width kana with a voicing mark
        for mark in ("ﾞ", "ﾟ", "゙", "゚"):
            if len(image := unicodedata.normalize("NFKC", chr(code) + mark)) == 1:
                put(chr(code) + mark, image)
    for source, image in out.items():
        if any(x in out for x in image) or image in out:
            raise MappingConflict(f"{source!r} -> {image!r} is not final")
    return out


@functools.lru_cache(maxsize=1)
def look_alikes() -> dict[str, dict[str, str]]:
    """Script -> letter of another script -> the letter of this script that looks like it, with the same marks."""
    out: dict[str, dict[str, str]] = {"latin": {}, "greek": {}, "cyrillic": {}}
    bases = {"greek": dict(zip(GREEK, GREEK_AS_LATIN, strict=True)), "cyrillic": dict(zip(CYRILLIC, CYRILLIC_AS_LATIN, strict=True))}
    for script, known in bases.items():
        for code in (*range(0x370, 0x530), *range(0x1F00, 0x2000)):
            apart = unicodedata.normalize("NFD", chr(code))
            if chr(code) not in mapping() and (base := known.get(chr(code), known.get(apart[0]))):
                image = base if chr(code) in known else unicodedata.normalize("NFC", base + apart[1:])
                out["latin"][chr(code)] = image
        out[script] = {image: letter for letter, image in out["latin"].items() if _OTHER.match(letter) and (_GREEK if script == "greek" else _CYRILLIC).match(letter) and len(image) == 1}
    if conflict := [x for x in out["latin"].values() if any(_OTHER.match(c) for c in x)]:
        raise MappingConflict(f"look-alikes that are no Latin letters: {conflict}")
    return out


@functools.lru_cache(maxsize=4096)
def romanised(letter: str) -> str:
    """Latin letters for a Greek or Cyrillic letter that looks like none."""
    name = unicodedata.name(letter, "x").split(" WITH ")[0].split(" ")[-1].lower()
    image = ROMAN.get(name, re.sub("[^a-z]", "", name) or "x")
    return image.capitalize() if letter.isupper() else image


@functools.lru_cache(maxsize=1)
def _compiled() -> tuple[dict, dict[str, str], re.Pattern[str], re.Pattern[str]]:
    """(trie, pairs that join, stretches in which something may change, what a stretch without is)."""
    table = mapping()
    trie: dict = {}
    for source, image in table.items():
        node = trie
        for c in source:
            node = node.setdefault(c, {})
        node[""] = image
    pairs = {s: image for s, image in table.items() if len(s) == 2}
    klass = lambda xs: "".join(f"\\U{ord(x):08x}" for x in sorted(xs))
    changing = klass({s for s in table if len(s) == 1} | {x for s in table for x in s[1:]}) + _LETTER["greek"] + _LETTER["cyrillic"]
    inside = changing + klass({s[0] for s in table}) + _LETTER["latin"] + _MARK
    return trie, pairs, re.compile(f"[{inside}]+"), re.compile(f"[{changing}]")


Span = tuple[int, int]


def _push(out: list[str], spans: list[Span], image: str, span: Span, pairs: dict[str, str]) -> None:
    """Append an image, letter by letter; a letter or mark joins the one before it that it has a composed form with."""
    for c in image:
        at = len(out) - 1
        if own := unicodedata.combining(c):  # marks of lower classes may stand between a mark and its letter
            while at >= max(0, len(out) - 4) and 0 < unicodedata.combining(out[at]) < own:
                at -= 1
        if at >= 0 and (joined := pairs.get(out[at] + c)) is not None:
            spans[at : at + 1] = [(spans[at][0], span[1])] * len(joined)
            out[at : at + 1] = joined
        else:
            out.append(c)
            spans.append(span)


def _transduced(text: str) -> tuple[list[str], list[Span]]:
    """The letters of a stretch's plain form, and the part of the stretch that each comes from."""
    trie, pairs, _, _ = _compiled()
    out: list[str] = []
    spans: list[Span] = []
    at, n = 0, len(text)
    while at < n:
        node, end, image, stop = trie, at, text[at], at + 1
        while end < n and (node := node.get(text[end])) is not None:
            end += 1
            if "" in node:
                image, stop = node[""], end
        _push(out, spans, image, (at, stop), pairs)
        at = stop
    done = "".join(out)
    if not (_OTHER.search(done) and _LATIN.search(done)):
        return out, spans
    whole: list[str] = []
    places: list[Span] = []
    at = 0
    for word in WORD.finditer(done):
        if not is_mixed(word.group()):
            continue
        whole += out[at : word.start()]
        places += spans[at : word.start()]
        letters: list[str] = []
        where: list[Span] = []
        for k, image in enumerate(_one_script(word.group()), word.start()):
            _push(letters, where, image, spans[k], pairs)
        whole += letters
        places += where
        at = word.end()
    return whole + out[at:], places + spans[at:]


def _stretch(match: re.Match[str]) -> str:
    text = match.group()
    return "".join(_transduced(text)[0]) if _compiled()[3].search(text) else text


def is_mixed(word: str) -> bool:
    return bool(_LATIN.search(word)) and bool(_OTHER.search(word))


def _one_script(word: str) -> Iterator[str]:
    """The images of a mixed word's letters in one script."""
    alike = look_alikes()
    latin = alike["latin"]
    script = None if _GREEK.search(word) and _CYRILLIC.search(word) else "greek" if _GREEK.search(word) else "cyrillic"
    if script and not all(c in latin for c in word if _OTHER.match(c)) and all(c in alike[script] for c in word if _LATIN.match(c)):
        return (alike[script].get(c, c) for c in word)
    return (latin.get(c) or (romanised(c) if _OTHER.match(c) else c) for c in word)


def plain(text: str | None) -> str | None:
    """The plain form of a text."""
    if text is None or text.isascii() or _SURELY.match(text):
        return text
    return _compiled()[2].sub(_stretch, text)


def traced(text: str) -> tuple[str, list[Span]]:
    """The plain form of a text, and the part of the text that each of its characters comes from."""
    if text.isascii() or _SURELY.match(text):
        return text, [(i, i + 1) for i in range(len(text))]
    out: list[str] = []
    spans: list[Span] = []
    at = 0
    for m in _compiled()[2].finditer(text):
        letters, where = _transduced(m.group())
        out += [text[at : m.start()], *letters]
        spans += [(i, i + 1) for i in range(at, m.start())]
        spans += [(m.start() + a, m.start() + b) for a, b in where]
        at = m.end()
    return "".join(out) + text[at:], spans + [(i, i + 1) for i in range(at, len(text))]


def is_plain(text: str | None) -> bool:
    """Whether a text is in plain form; NULL is."""
    return text is None or text.isascii() or bool(_SURELY.match(text)) or all(_stretch(m) == m.group() for m in _compiled()[2].finditer(text))


@F.pandas_udf(T.StringType())
def plain_form(texts: pd.Series) -> pd.Series:
    """Column function: the plain form."""
    return texts.map(plain, na_action="ignore")


def in_form(text: Column) -> Column:
    """Column function: the plain form; texts that surely are plain aren't sent to Python."""
    sure = text.rlike(SURELY_PLAIN)
    return F.when(text.isNull() | sure, text).otherwise(plain_form(F.when(~sure, text)))


def in_plain_form(text: Column) -> Column:
    """Column function: whether a text is in plain form (NULL: NULL)."""

    @F.pandas_udf(T.BooleanType())
    def check(texts: pd.Series) -> pd.Series:
        return texts.map(is_plain, na_action="ignore")

    return F.when(text.rlike(SURELY_PLAIN), F.lit(True)).otherwise(check(text))


def not_plain(values: DataFrame, text: str, carry: list[str]) -> DataFrame:
    """The rows of ``values`` whose ``text`` is not in plain form; columns ``carry``.

    The scan drops texts made of surely plain characters, so Python sees the others only.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.loc[~batch["__text"].map(is_plain).astype(bool), carry]

    doubtful = values.filter(F.col(text).isNotNull() & ~F.col(text).rlike(SURELY_PLAIN)).select(*carry, F.col(text).alias("__text"))
    return doubtful.mapInPandas(run, doubtful.select(*carry).schema)
