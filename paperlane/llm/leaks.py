"""Evaluation passages in training text, found by q-gram lemma filtering.

Texts are reduced to their letters and digits (case, width, spacing, punctuation and quote marks gone).  A hit is
a q-gram that a document shares with an item; its diagonal is the place in the document less the place in the item.
Hits are counted in diagonal bands of width ``2 w`` that overlap by half, so that a region drifting by up to ``w``
lies in one band.  A region as long as the shortest counted passage (``span`` characters) with at most ``edits``
edits shares at least ``span + 1 - q - edits * q`` q-grams (the q-gram lemma); bands with fewer hits are
dropped.  Retained bands are verified by a banded alignment: the runs of equal characters on the band's diagonals are chained, each
chain paying for the characters it replaces, inserts or deletes, and a region is kept if one of at most ``edits`` edits covers
``span`` characters.  As a passage counts only if it is the same, the longest run of a kept region is then measured in
the item's words, or in letters and digits for languages without spaces.

The corpus is read once, whatever the number of items.  Items of at most ``block_chars`` characters together go to the
tasks, and documents are never shuffled.  More items stay a table of q-grams: a bitmap of ``filter_bits`` bits, of fixed size, tells
the scan which q-grams of a document some item may have; only these are shuffled, joined, and counted in bands, and the texts
of retained pairs are joined for the alignment.  Both ways give the same rows.

Defined results: NULL, empty and blank documents and items match nothing; repeated texts are reported for each
of their ids; texts of any length are examined whole.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperlane.sources import checkpoints

#: Languages whose passages are measured in letters and digits.
UNSPACED = ("ja", "zh", "ko", "th")
_WORD = re.compile(r"[^\W_]+")
_MULT = np.uint64(0x9E3779B97F4A7C15)


def reduced(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the letters and digits of a text, and where its words start in them.

    Words are bounded by white space; letters on both sides of an apostrophe or a hyphen are one word.
    """
    norm = unicodedata.normalize("NFKC", text).casefold()
    out: list[str] = []
    starts: list[int] = []
    n = 0
    for chunk in norm.split():
        kept = "".join(_WORD.findall(chunk))
        if kept:
            starts.append(n)
            out.append(kept)
            n += len(kept)
    return np.frombuffer("".join(out).encode("utf-32-le"), dtype=np.uint32), np.array(starts, dtype=np.int64)


def letters(text: str) -> np.ndarray:
    """The code points of :func:`reduced`, without the words' places, in one pass."""
    kept = "".join(_WORD.findall(unicodedata.normalize("NFKC", text).casefold()))
    return np.frombuffer(kept.encode("utf-32-le"), dtype=np.uint32)


def grams(codes: np.ndarray, q: int) -> np.ndarray:
    """64-bit hashes of the q-grams at each place."""
    n = len(codes) - q + 1
    if n < 1:
        return np.zeros(0, np.uint64)

    def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        h = left * _MULT ^ right
        return h ^ (h >> np.uint64(29))

    with np.errstate(over="ignore"):
        piece = codes.astype(np.uint64) * _MULT
        piece ^= piece >> np.uint64(31)
        size, at, out = 1, 0, None
        while size <= q:  # hashes of runs of 1, 2, 4, ... letters; those whose sizes add up to q are joined
            if q & size:
                part = piece[at : at + n]
                out = part.copy() if out is None else joined(out, part)
                at += size
            if (size * 2) > q:
                break
            piece = joined(piece[:-size], piece[size:])
            size *= 2
    return out


def passage(text: str | None, lang: str | None, q: int, words: int, chars: int, edits: int) -> tuple[np.ndarray, np.ndarray, bool, int, int] | None:
    """(codes, word starts, unspaced, span, least hits) of an item; None if it has no passage that counts."""
    codes, starts = reduced(text or "")
    unspaced = (lang or "").lower().split("-")[0] in UNSPACED
    span = chars
    if not unspaced:
        if len(starts) < words:
            return None
        ends = np.append(starts[words:], len(codes)) if len(starts) > words else np.array([len(codes)])
        span = int((ends - starts[: len(ends)]).min())
    if len(codes) < span or span < q:
        return None
    return codes, starts, unspaced, span, max(1, span + 1 - q - edits * q)


class _Items:
    """Sorted q-grams of a block of items."""

    def __init__(self, rows: list[tuple[int, str, str]], q: int, words: int, chars: int, edits: int) -> None:
        self.ids, self.passages = [], []
        hashes, owner, place = [], [], []
        for item_id, text, lang in rows:
            if (known := passage(text, lang, q, words, chars, edits)) is None:
                continue
            h = grams(known[0], q)
            hashes.append(h)
            owner.append(np.full(len(h), len(self.ids)))
            place.append(np.arange(len(h)))
            self.ids.append(item_id)
            self.passages.append(known)
        h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        order = np.argsort(h, kind="stable")
        self.hash = h[order]
        self.owner = (np.concatenate(owner) if owner else np.zeros(0, int))[order].astype(np.int64)
        self.place = (np.concatenate(place) if place else np.zeros(0, int))[order].astype(np.int64)
        self.needs = np.array([x[4] for x in self.passages], dtype=np.int64)


def runs_of(doc: np.ndarray, item: np.ndarray, low: int, high: int, least: int = 3) -> list[tuple[int, int, int]]:
    """(start in item, length, diagonal) of the runs of equal characters on the band's diagonals, ``least`` long or more."""
    found = []
    for d in range(low, high + 1):
        a, b = max(0, d), min(len(doc), len(item) + d)
        if b <= a:
            continue
        same = np.concatenate(([0], (doc[a:b] == item[a - d : b - d]).astype(np.int8), [0]))
        edge = np.flatnonzero(np.diff(same))
        starts, lengths = edge[::2], edge[1::2] - edge[::2]
        long = lengths >= least
        found.extend((int(s + a - d), int(n), d) for s, n in zip(starts[long], lengths[long], strict=True))
    return sorted(found)


def aligned(runs: list[tuple[int, int, int]], edits: int, span: int) -> bool:
    """Whether a chain of runs with at most ``edits`` edits between them covers ``span`` characters of the item, edits counted."""
    best: list[list[int]] = []  # characters covered up to the end of each run, by edits
    for i, (start, length, diagonal) in enumerate(runs):
        if length >= span:
            return True
        own = [length] * (edits + 1)
        for j in range(i - 1, -1, -1):
            s, n, d = runs[j]
            gap = start - (s + n)
            if gap > edits:  # runs are sorted by their start, but a longer one may start earlier
                continue
            # a run that overlaps the one before it gives up its first characters
            lost = max(0, -gap, -(gap + diagonal - d))
            cost = max(gap + lost, gap + lost + diagonal - d)
            if lost < length and cost <= edits:
                for e in range(cost, edits + 1):
                    own[e] = max(own[e], best[j][e - cost] + length - lost + min(gap + lost, cost))
        if max(own) >= span:
            return True
        best.append(own)
    return False


def _whole_words(starts: np.ndarray, n: int, at: int, length: int) -> int:
    """Number of the item's words that lie wholly in [at, at + length)."""
    ends = np.append(starts[1:], n)
    return int(((starts >= at) & (ends <= at + length)).sum())


def _verified(codes: np.ndarray, item: tuple[np.ndarray, np.ndarray, bool, int, int], band: int, width: int, words: int, chars: int, edits: int) -> bool:
    """Whether a document shares a passage with an item in a band."""
    own, starts, unspaced, span, _ = item
    runs = runs_of(codes, own, band * width, band * width + 2 * width - 1)
    if not aligned(runs, edits, span):
        return False
    if unspaced:
        return any(n >= chars for _, n, _ in runs)
    return any(n >= span and _whole_words(starts, len(own), s, n) >= words for s, n, _ in runs)


def _bands(diagonal: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bands of each diagonal: [w k, w k + 2 w) for k = floor(d / w) and the one before."""
    k = np.floor_divide(diagonal, width)
    return k, k - 1


def _search(codes: np.ndarray, items: _Items, q: int, width: int, words: int, chars: int, edits: int) -> list[int]:
    h = grams(codes, q)
    if not len(h) or not len(items.hash):
        return []
    left = np.searchsorted(items.hash, h, "left")
    hit = np.flatnonzero(items.hash[np.minimum(left, len(items.hash) - 1)] == h)
    if len(hit) < items.needs.min():
        return []
    left = left[hit]
    n = np.searchsorted(items.hash, h[hit], "right") - left
    at = np.repeat(hit, n)
    which = np.repeat(left - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
    owner, diagonal = items.owner[which], at - items.place[which]
    bands = np.concatenate([np.stack((owner, k), 1) for k in _bands(diagonal, width)])
    keys, counts = np.unique(bands, axis=0, return_counts=True)
    kept = keys[counts >= items.needs[keys[:, 0]]]
    return [items.ids[o] for o in np.unique(kept[:, 0]) if any(_verified(codes, items.passages[o], int(band), width, words, chars, edits) for _, band in kept[kept[:, 0] == o])]


def leaked(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", item_lang: str = "lang",
           words: int = 12, chars: int = 30, q: int = 10, edits: int = 1, width: int = 4, block_chars: int = 4_000_000, filter_bits: int = 1 << 27) -> DataFrame:
    """(doc_id, item_id) of each document that shares ``words`` consecutive words (``chars`` letters and digits) with an item."""
    rows = items.select(F.col(item_id).alias("i"), F.col(item_text).alias("t"), F.col(item_lang).alias("l")).filter("t is not null and i is not null")
    schema = T.StructType([T.StructField("doc_id", documents.schema[doc_id].dataType), T.StructField("item_id", items.schema[item_id].dataType)])
    picked = documents.select(F.col(doc_id).alias("doc_id"), F.col(doc_text).alias("text")).filter(F.col("text").isNotNull())
    if (rows.agg(F.sum(F.length("t") + 1)).first()[0] or 0) > block_chars:
        return _joined(picked, rows, schema, q, words, chars, edits, width, filter_bits)
    block = [tuple(r) for r in rows.collect()]  # at most block_chars characters

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = _Items(block, q, words, chars, edits)
        for batch in batches:
            pairs = [(d, i) for d, t in zip(batch["doc_id"], batch["text"], strict=True) for i in _search(letters(t), index, q, width, words, chars, edits)]
            yield pd.DataFrame(pairs, columns=["doc_id", "item_id"]).astype({"doc_id": batch["doc_id"].dtype} if pairs else {})

    return picked.mapInPandas(run, schema).distinct()


def _joined(picked: DataFrame, rows: DataFrame, schema: T.StructType, q: int, words: int, chars: int, edits: int, width: int, filter_bits: int) -> DataFrame:
    """The same for items that stay a table: q-grams joined, hits counted in bands, retained pairs aligned."""
    key, item_type = schema["doc_id"].dataType.simpleString(), schema["item_id"].dataType.simpleString()

    def item_grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = []
            for i, t, lang in zip(batch["i"], batch["t"], batch["l"], strict=True):
                if (known := passage(t, lang, q, words, chars, edits)) is not None:
                    h = grams(known[0], q)
                    parts.append(pd.DataFrame({"h": h.view(np.int64), "item_id": i, "place": np.arange(len(h)), "need": known[4]}))
            yield pd.concat(parts) if parts else pd.DataFrame({"h": [], "item_id": [], "place": [], "need": []}).astype("int64")

    posted = checkpoints.cut(rows.mapInPandas(item_grams, f"h long, item_id {item_type}, place long, need int"))
    bit = f"pmod(h, {filter_bits}L)"
    marked = posted.selectExpr(f"{bit} div 64 as at", f"shiftleft(1L, cast({bit} % 64 as int)) as bits").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow().to_pandas()  # at most filter_bits / 64 rows
    bitmap = np.zeros(filter_bits // 64 + 1, np.int64)
    bitmap[marked["at"].to_numpy(np.int64)] = marked["bits"].to_numpy(np.int64)
    least = posted.agg(F.min("need")).first()[0] or 1

    def doc_grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = bitmap.view(np.uint64)
        for batch in batches:
            parts = []
            for d, t in zip(batch["doc_id"], batch["text"], strict=True):
                h = grams(letters(t), q)
                b = np.mod(h.view(np.int64), filter_bits).astype(np.uint64)
                at = np.flatnonzero(bits[(b >> np.uint64(6)).astype(np.int64)] >> (b & np.uint64(63)) & np.uint64(1))
                if len(at) >= least:
                    parts.append(pd.DataFrame({"h": h[at].view(np.int64), "doc_id": d, "at": at}))
            yield pd.concat(parts) if parts else pd.DataFrame({"h": [], "doc_id": [], "at": []}).astype("int64")

    hits = picked.mapInPandas(doc_grams, f"h long, doc_id {key}, at long").join(posted, "h")
    k = F.floor((F.col("at") - F.col("place")) / width).cast("long")
    counted = hits.select("doc_id", "item_id", "need", F.explode(F.array(k, k - 1)).alias("band")).groupBy("doc_id", "item_id", "band").agg(F.count("*").alias("n"), F.first("need").alias("need"))
    kept = checkpoints.cut(counted.filter("n >= need").groupBy("doc_id", "item_id").agg(F.collect_set("band").alias("bands")))  # diagonals of one document
    texts = kept.join(picked.join(kept.select("doc_id").distinct(), "doc_id", "left_semi"), "doc_id").join(rows.withColumnRenamed("i", "item_id"), "item_id")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ok = []
            for text, t, lang, bands in zip(batch["text"], batch["t"], batch["l"], batch["bands"], strict=True):
                item, codes = passage(t, lang, q, words, chars, edits), letters(text)
                ok.append(any(_verified(codes, item, int(band), width, words, chars, edits) for band in bands))
            yield batch.loc[ok, ["doc_id", "item_id"]]

    return texts.mapInPandas(verify, schema).distinct()
