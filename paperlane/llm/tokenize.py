"""Encoding a corpus with a byte-level BPE vocabulary inside the JVM.

The vocabulary's ranks are one literal in the plan: an array of small maps, bucketed by CRC-32 of the piece, as
Spark scans a map's keys one by one.  A word's bytes are hex pairs; ``aggregate`` folds the lowest-ranked
neighbouring pair into one piece until no pair has a rank.  Decoding looks ids up in an array of binary pieces and
concatenates them.

The fold is costly for a JVM, so it runs once for each distinct frequent word: the ``frequent`` words that occur
most often in the corpus (counted over every document) become a second literal, word -> ids.  Its size is bounded
by that parameter whatever the corpus; all other words are folded where they stand, so no text is shuffled and
no word is dropped.

Defined results: NULL and empty text give an empty list; blank text is encoded as it is; repeated rows each get
their ids; special tokens' strings are ordinary text.
"""

from __future__ import annotations

import base64
import functools
import heapq
import json
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKENIZERS = "/opt/tokenizers"
#: The published word pattern of this vocabulary, with White_Space written out for Java.
_SPACE = r"\t-\r \u0085   -     　"
WORDS = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
BUCKETS = 16384


@functools.lru_cache(maxsize=4)
def load_ranks(path: str) -> dict[bytes, int]:
    """Piece -> id of a rank file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(piece): int(rank) for piece, rank in (line.split() for line in lines if line.strip())}


def _bucketed(entries: dict[str, object], kind: str, buckets: int) -> Column:
    """A literal array of maps; an entry is in the map at its key's CRC-32 modulo ``buckets``."""
    parts: list[dict[str, object]] = [{} for _ in range(buckets)]
    for key, value in entries.items():
        parts[zlib.crc32(key.encode()) % buckets][key] = value
    return F.from_json(F.lit(json.dumps(parts, ensure_ascii=False, separators=(",", ":"))), f"array<map<string,{kind}>>")


def _lookup(table: Column, key: Column, buckets: int) -> Column:
    return F.try_element_at(F.get(table, F.crc32(key.cast("binary")) % buckets), key)


def _rank(ranks: Column, piece: Column) -> Column:
    """Rank of a hex-coded piece, or a number above all ranks."""
    return F.coalesce(_lookup(ranks, piece, BUCKETS), F.lit(2**31 - 1))


def fold(word: Column, ranks: Column) -> Column:
    """Ids of one word by merging, lowest rank first and leftmost among equals."""
    none = F.lit(2**31 - 1)
    code = F.hex(F.encode(word, "UTF-8"))
    size = (F.length(code) / 2).cast("int")
    single = F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.substring(code, i * 2 + 1, F.lit(2)))
    start = F.transform(
        F.array(single),
        lambda pieces: F.struct(
            pieces.alias("pieces"),
            F.when(F.size(pieces) > 1, F.transform(F.sequence(F.lit(1), F.size(pieces) - 1), lambda i: _rank(ranks, F.concat(F.get(pieces, i - 1), F.get(pieces, i)))))
            .otherwise(F.array().cast("array<int>")).alias("ranks"),
        ),
    )[0]

    def merge(state: Column, _: Column) -> Column:
        pieces, gaps = state["pieces"], state["ranks"]
        least = F.array_min(gaps)
        at = F.array_position(gaps, least).cast("int")  # 1-based position of the left piece

        def joined(i: Column) -> Column:
            piece = F.concat(F.get(pieces, i - 1), F.get(pieces, i))
            left = F.when(i > 1, F.array(_rank(ranks, F.concat(F.get(pieces, i - 2), piece)))).otherwise(F.array().cast("array<int>"))
            right = F.when(i + 1 < F.size(pieces), F.array(_rank(ranks, F.concat(piece, F.get(pieces, i + 1))))).otherwise(F.array().cast("array<int>"))
            return F.struct(
                F.concat(F.slice(pieces, 1, i - 1), F.array(piece), F.slice(pieces, i + 2, F.size(pieces))).alias("pieces"),
                F.concat(F.slice(gaps, 1, F.greatest(i - 2, F.lit(0))), left, right, F.slice(gaps, i + 2, F.size(gaps) + 1)).alias("ranks"),
            )

        return F.when(F.coalesce(least, none) == none, state).otherwise(F.transform(F.array(at), joined)[0])

    done = F.aggregate(F.sequence(F.lit(1), F.greatest(size - 1, F.lit(1))), start, merge)
    return F.transform(done["pieces"], lambda p: _rank(ranks, p))


def merged(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word by the same merges, the next one taken from a heap."""
    n = len(word)
    start, end, nxt, before = list(range(n)), list(range(1, n + 1)), [*range(1, n), -1], list(range(-1, n - 1))
    alive = [True] * n

    def pair(i: int) -> int | None:
        return ranks.get(word[start[i] : end[nxt[i]]]) if nxt[i] >= 0 else None

    heap = [(r, i, end[nxt[i]]) for i in range(n) if (r := pair(i)) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or nxt[i] < 0 or end[nxt[i]] != stop or start[nxt[i]] != end[i]:  # one of the two was merged since
            continue
        j = nxt[i]
        end[i], nxt[i], alive[j] = end[j], nxt[j], False
        if nxt[i] >= 0:
            before[nxt[i]] = i
        for k in (before[i], i):
            if k >= 0 and (r := pair(k)) is not None:
                heapq.heappush(heap, (r, k, end[nxt[k]]))
    return [ranks[word[start[i] : end[i]]] for i in range(n) if alive[i]]


def words(text: Column) -> Column:
    """The pieces of text that merges never cross."""
    return F.regexp_extract_all(text, F.lit(WORDS), F.lit(0))


def encode(documents: DataFrame, text: str, out: str, vocabulary: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken", frequent: int = 20_000, longest: int = 256) -> DataFrame:
    """``documents`` with the ids of ``text`` in ``out``.

    ``frequent`` bounds the words whose ids are found once and looked up, ``longest`` the bytes of words that are folded; they change speed only,
    not results.
    """
    by_bytes = load_ranks(vocabulary)

    @F.pandas_udf("array<array<int>>")
    def long_ids(found: pd.Series) -> pd.Series:
        return pd.Series([None if ws is None else [merged(w.encode(), by_bytes) for w in ws] for ws in found])

    ranks = _bucketed({piece.hex().upper(): rank for piece, rank in load_ranks(vocabulary).items()}, "int", BUCKETS)
    counted = documents.select(F.explode(words(F.col(text))).alias("word")).groupBy("word").count()
    top = counted.filter((F.col("count") > 1) & (F.length("word") <= 200)).orderBy(F.desc("count"), "word").limit(frequent).select("word", fold(F.col("word"), ranks).alias("ids"))
    known_ids = {row["word"]: list(row["ids"]) for row in top.collect()}  # at most `frequent` words of at most 200 characters
    known = _bucketed(known_ids, "array<int>", BUCKETS)
    long = F.array_distinct(F.filter(words(F.col(text)), lambda w: F.octet_length(w) > longest))
    # no text without a run of so many bytes has a long word: most rows send nothing to Python
    some = F.when(F.octet_length(text) > longest, F.when(F.size(long) > 0, long))
    held = documents.withColumn("__long", some).withColumn("__ids", long_ids(F.col("__long")))
    of_long = lambda w: F.get(F.col("__ids"), F.array_position("__long", w).cast("int") - 1)
    ids = F.flatten(F.transform(words(F.col(text)), lambda w: F.coalesce(_lookup(known, w, BUCKETS), F.when(F.octet_length(w) > longest, of_long(w)).otherwise(fold(w, ranks)))))
    return held.withColumn(out, F.coalesce(ids, F.array().cast("array<int>"))).drop("__long", "__ids")


def decode(ids: Column, vocabulary: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken") -> Column:
    """Bytes of a list of ids: the ids' binary pieces, concatenated. Unknown ids add nothing."""
    pieces: list[str] = []
    for piece, rank in sorted(load_ranks(vocabulary).items(), key=lambda x: x[1]):
        pieces.extend([""] * (rank - len(pieces)))
        pieces.append(piece.hex())
    table = F.from_json(F.lit(json.dumps(pieces)), "array<string>")
    return F.unhex(F.array_join(F.transform(ids, lambda i: F.coalesce(F.get(table, i), F.lit(""))), ""))
