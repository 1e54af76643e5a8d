"""Values decoded with a wrong character encoding: found, and restored where their bytes are still there.

Twins: values are joined on their text stripped of non-ASCII characters (of the words that have any, so that "Größe 4" is a twin of
"GrÃ¶ÃŸe 7"; and on the other words, as some wrong readings leave ASCII bytes inside a word).  The runs between the common characters pair up, and each pair of runs is
aligned: the characters of the garbled run are the bytes of the clean run, read by another encoding.  Which encodings, out of
all that the interpreter has, make the two equal is what the pair shows.  The transformations (true encoding, wrong
encoding) that explain most twins are learned, one after the other, until what is left has fewer than ``support`` twins.

Learned transformations are undone in the remaining values, and so is a learned true encoding read by a learned wrong one that
no twin shows together, which needs a greater gain.  Of the readings of a value the one whose neighbouring characters are
most common in the whole column is its text.  A value is garbled if undoing a transformation makes it clearly more
plausible, or if it has characters that only wrong decoding leaves behind (replacement characters, C1 controls,
private use).

Sizes: neighbours are counted over all rows in ``BUCKETS`` hash buckets, a table of fixed size however large the corpus
is; that is all that is sent to the executors besides the learned transformations.  No twins are left out.  A stripped text
with at most ``twins`` different values pairs them all; where it has more, a run meets the runs at its place that are written with the
bytes that it was read from (of lost places, with a few of the bytes around them), and only values that differ in such runs are paired: the same
twins without all pairs.  Twins only teach the transformations and runs; every value is judged.

Defined results: NULL, empty and ASCII values are never garbled; lost bytes leave ``restored`` NULL unless at most
half of the value's characters are lost and twins that aren't garbled show all of its runs; repeated values are judged alike.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from encodings.aliases import aliases

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperlane.sources import checkpoints

_LEFT_BEHIND = re.compile("[\\ufffd\\x80-\\x9f\\ue000-\\uf8ff]")
NOT_ASCII = r"[^\x00-\x7F]"
_RUN = re.compile(f"{NOT_ASCII}+")
#: Buckets of the counts of neighbouring characters.
BUCKETS = 1 << 20
LOST = "�"


@functools.lru_cache(maxsize=1)
def encodings() -> tuple[str, ...]:
    """The interpreter's text encodings that leave ASCII as it is, the common ones of a group of near-equal ones first."""
    ascii_text = "".join(map(chr, range(32, 127)))
    found = []
    for name in sorted(set(aliases.values())):
        try:
            if codecs.lookup(name)._is_text_encoding and ascii_text.encode(name) == ascii_text.encode("ascii") and name not in ("ascii", "utf_7", "hz") and not name.startswith("iso2022"):
                found.append(name)
        except (LookupError, UnicodeError):
            continue
    # of encodings that explain the same twins, those that lists are exported in
    first = [n for n in ("utf_8", "latin_1", *(n for n in found if re.fullmatch(r"cp\d+", n)), "mac_roman", "euc_jp", "koi8_r") if n in found]
    return (*first, *(n for n in found if n not in first))


def _bytes(text: str, codec: str) -> bytes | None:
    """The bytes that were read as ``text``, lost ones as none; None if the encoding can't have made it."""
    try:
        return text.replace(LOST, "").encode(codec)
    except UnicodeEncodeError:
        pass
    out = bytearray()
    for c in text:
        if c == LOST:
            continue
        try:
            out += c.encode(codec)
        except UnicodeEncodeError:
            if 0x80 <= ord(c) <= 0x9F and codec.startswith("cp125"):  # places that the code page leaves open
                out.append(ord(c))
            else:
                return None
    return bytes(out)


def garble(text: str, true: str, wrong: str, errors: str = "replace") -> str | None:
    """``text`` as it looks after its bytes in ``true`` were read as ``wrong``; ``keep`` reads open places of a code page as controls."""
    for _ in range(2 if true.endswith("*2") else 1):
        try:
            data = text.encode(true.removesuffix("*2"))
        except UnicodeEncodeError:
            return None
        if errors == "keep" and wrong.startswith("cp125"):
            text = "".join(chr(b) if (c := bytes([b]).decode(wrong, "replace")) == LOST else c for b in data)
        else:
            text = data.decode(wrong, "replace" if errors == "keep" else errors)
    return text


def undo(text: str, true: str, wrong: str) -> tuple[str, int] | None:
    """(text before garbling, number of lost places), or None if the transformation can't have made it."""
    lost = 0
    for _ in range(2 if true.endswith("*2") else 1):
        data = _bytes(text, wrong)
        if data is None:
            return None
        lost += text.count(LOST)
        text = data.decode(true.removesuffix("*2"), "replace")
    return text, lost + text.count(LOST)


def aligned(garbled: str, clean: str) -> list[tuple[str, str]] | None:
    """The differing runs of twins, paired between the ASCII characters (or else the ASCII words) that they have in common."""
    if _RUN.sub("", garbled) == _RUN.sub("", clean):
        a, b = (re.split(r"[\x00-\x7F]", t) for t in (garbled, clean))
    else:
        a, b = garbled.split(" "), clean.split(" ")
        if len(a) != len(b) or any(x != y for x, y in zip(a, b, strict=True) if x.isascii() or y.isascii()):
            return None
    return [(x, y) for x, y in zip(a, b, strict=True) if x != y]


def _meets(pieces: list[bytes], whole: bytes) -> bool:
    """Whether the pieces between lost places are parts of ``whole``, in order and from end to end."""
    if len(pieces) == 1:
        return pieces[0] == whole
    at = len(pieces[0])
    if not whole.startswith(pieces[0]):
        return False
    for piece in pieces[1:-1]:
        if (found := whole.find(piece, at)) < 0:
            return False
        at = found + len(piece)
    return whole.endswith(pieces[-1]) and len(whole) - len(pieces[-1]) >= at


@functools.lru_cache(maxsize=2048)
def _written(clean: str) -> dict[bytes, list[str]]:
    """Bytes of a text -> the encodings that write it so."""
    out: dict[bytes, list[str]] = {}
    for name in encodings():
        try:
            out.setdefault(clean.encode(name), []).append(name)
        except UnicodeEncodeError:
            continue
    return out


@functools.lru_cache(maxsize=2048)
def _read(garbled: str) -> list[tuple[str, list[bytes]]]:
    """(encoding, bytes between lost places) of the encodings that may have read a text."""
    out = []
    for name in encodings():
        pieces = [_bytes(p, name) for p in garbled.split(LOST)]
        if any(pieces) and not any(p is None for p in pieces):
            out.append((name, pieces))
    return out


def explained(garbled: str, clean: str) -> set[str]:
    """The transformations ``true>wrong`` whose bytes of ``clean`` are what was read as ``garbled``."""
    wholes, out = _written(clean), set()
    for wrong, pieces in _read(garbled):
        if len(pieces) > 1:
            out.update(f"{true}>{wrong}" for whole, names in wholes.items() if _meets(pieces, whole) for true in names if true != wrong)
            continue
        out.update(f"{true}>{wrong}" for true in wholes.get(pieces[0], ()) if true != wrong)
        try:  # garbled twice: only UTF-8 shows that the first reading was one
            again = _bytes(pieces[0].decode("utf-8"), wrong)
        except UnicodeDecodeError:
            continue
        if again and again != pieces[0] and wrong != "utf_8" and "utf_8" in wholes.get(again, ()):
            out.add(f"utf_8*2>{wrong}")
    return out


def _neighbours(text: str) -> list[str]:
    """Pairs of neighbouring characters of which one isn't ASCII; digits and ASCII letters are classes."""
    marked = "".join("0" if c.isdigit() and c.isascii() else "a" if c.isascii() and c.isalpha() and c.islower() else "A" if c.isascii() and c.isalpha() else c for c in f"\x02{text}\x03")
    return [marked[i : i + 2] for i in range(len(marked) - 1) if not marked[i : i + 2].isascii()]


def _bucket(pair: str) -> int:
    return (ord(pair[0]) * 0x9E3779B1 + ord(pair[1]) * 0x85EBCA77 >> 4) % BUCKETS


class Judge:
    """Plausibility of values by the counts of neighbouring characters, and the learned transformations."""

    def __init__(self, counts: np.ndarray, learned: list[str], gain: float = 1.0, unseen_gain: float = 1.5) -> None:
        self.log = np.log(0.3 + counts).astype(np.float32)
        ways = [tuple(w.split(">")) for w in learned]
        # what was written in one learned encoding may have been read by any learned reader
        true = dict.fromkeys(x for t, _ in ways for x in ((t, "utf_8*2") if t == "utf_8" else (t,)))
        mixed = [(t, w) for t in true for w in dict.fromkeys(w for _, w in ways) if t.removesuffix("*2") != w and (t, w) not in ways]
        self.ways = [(t, w, gain) for t, w in ways] + [(t, w, unseen_gain) for t, w in mixed]

    def score(self, text: str) -> float:
        """Mean log count of the neighbours."""
        pairs = _neighbours(text)
        return sum(float(self.log[_bucket(p)]) for p in pairs) / len(pairs) if pairs else 0.0

    def judge(self, text: str | None) -> tuple[bool, str | None, str | None]:
        """(garbled, restored, transformation) of a value; ``restored`` may have lost places."""
        if text is None or text.isascii():
            return False, None, None
        own = self.score(text)
        best: tuple[float, str, str] | None = None
        for true, wrong, gain in self.ways:
            if wrong == "utf_8" and LOST not in text:  # other bytes hardly ever are valid UTF-8
                continue
            if (back := undo(text, true, wrong)) is None:
                continue
            restored, lost = back
            kept = restored.replace(LOST, "")
            places = sum(not c.isascii() for c in restored)
            if restored == text or lost * 2 > places + 1 or kept.isascii() or _LEFT_BEHIND.search(kept):
                continue
            # strict UTF-8 in several sequences is hardly ever chance
            need = 0.3 if true.startswith("utf_8") and not lost and places > 1 else gain
            value = self.score(kept) - 0.3 * lost
            if value > own + need and (best is None or value > best[0]):
                best = (value, restored, f"{true}>{wrong}")
        if best:
            return True, best[1], best[2]
        return bool(_LEFT_BEHIND.search(text)), None, None


def neighbour_counts(values: DataFrame) -> np.ndarray:
    """Counts of neighbouring characters over all rows, by bucket."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counts = Counter(b for v in batch["value"] for b in {_bucket(p) for p in _neighbours(v)})
            yield pd.DataFrame({"bucket": list(counts), "n": list(counts.values())}, dtype="int64")

    found = values.select("value").mapInPandas(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow().to_pandas()  # at most BUCKETS rows
    counts = np.zeros(BUCKETS)
    counts[found["bucket"].to_numpy(np.int64)] = found["n"].to_numpy(float)
    return counts


def marks(run: str) -> set[bytes]:
    """What a clean run of :func:`signs` has in common with ``run`` as the garbled one, whichever transformation explains the two.

    That is all its bytes; of bytes with lost places those that it begins with, else ends with, else two of its longest piece.
    """
    out = set()
    for name, pieces in _read(run):
        if len(pieces) == 1:
            out.add(b"=" + pieces[0])
            try:
                again = _bytes(pieces[0].decode("utf-8"), name)
            except UnicodeDecodeError:
                continue
            if again:
                out.add(b"=" + again)
        elif pieces[0]:
            out.add(b"^" + pieces[0][:3])
        else:
            out.add(b"$" + pieces[-1][-3:] if pieces[-1] else b"~" + max(pieces, key=len)[:2])
    return out


def signs(run: str, lost: bool) -> set[bytes]:
    """The :func:`marks` that runs garbled from ``run`` may have, with ``lost`` those of runs with lost places, too."""
    out = {b"=" + whole for whole in _written(run)}
    if lost:
        for whole in _written(run):
            out.update(b"^" + whole[:n] for n in (1, 2, 3))
            out.update(b"$" + whole[-n:] for n in (1, 2, 3))
            out.update(b"~" + whole[i : i + n] for i in range(len(whole)) for n in (1, 2))
    return out


def _digest(*parts: object) -> bytes:
    return hashlib.blake2b(repr(parts).encode(), digest_size=16).digest()


def _places(stripped: str, value: str) -> Iterator[tuple[bytes, str]]:
    """(place, run) of the runs that :func:`aligned` may pair with another value's of the same stripped text; of a pair both are at one place."""
    if stripped.startswith("w"):
        words = [(i, w) for i, w in enumerate(value.split(" ")) if not w.isascii()]
        yield from ((_digest("w", stripped, i), w) for i, w in words)
        if all(_RUN.fullmatch(w) for _, w in words):  # then its runs are its words
            return
    yield from ((_digest("c", stripped, _RUN.sub("", value), i), x) for i, x in enumerate(re.split(r"[\x00-\x7F]", value)) if x)


def _by_marks(members: DataFrame) -> DataFrame:
    """(garbled, clean) of the members (stripped, value) for each run in which they differ and that some transformation explains, without pairing all."""

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(at, run, v) for s, v in zip(batch["stripped"], batch["value"], strict=True) for at, run in _places(s, v)]
            yield pd.DataFrame(rows, columns=["place", "run", "value"])

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["key", "place", "run", "garbled"]
        for batch in batches:
            rows = []
            for at, run, lost in zip(batch["place"], batch["run"], batch["lost"], strict=True):
                at = bytes(at)
                rows.extend((hashlib.blake2b(at + m, digest_size=16).digest(), at, run, True) for m in marks(run))
                if LOST not in run:
                    rows.extend((hashlib.blake2b(at + m, digest_size=16).digest(), at, run, False) for m in signs(run, bool(lost)))
                if len(rows) > 50_000:
                    yield pd.DataFrame(rows, columns=columns)
                    rows = []
            yield pd.DataFrame(rows, columns=columns)

    def confirm(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[[bool(explained(a, b)) for a, b in zip(batch["run"], batch["clean_run"], strict=True)]]

    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # small rows, costly to compare: no part is put together with others
    placed = checkpoints.cut(members.repartition(parts).mapInPandas(place, "place binary, run string, value string"))
    runs = placed.select("place", "run").distinct()
    with_lost = runs.filter(F.contains("run", F.lit(LOST))).select("place").distinct().withColumn("lost", F.lit(True))
    marked = checkpoints.cut(runs.join(with_lost, "place", "left").withColumn("lost", F.coalesce("lost", F.lit(False))).repartition(parts).mapInPandas(mark, "key binary, place binary, run string, garbled boolean"))
    clean = marked.filter(~F.col("garbled")).select("key", F.col("run").alias("clean_run"))
    met = marked.filter("garbled").select("key", "place", "run").join(clean, "key").filter(F.col("run") != F.col("clean_run"))
    # a clean run is written once for all that it meets
    met = met.select("place", "run", "clean_run").distinct().repartition(parts, "clean_run").sortWithinPartitions("clean_run").mapInPandas(confirm, "place binary, run string, clean_run string")
    known = placed.filter(~F.contains("value", F.lit(LOST))).select("place", F.col("run").alias("clean_run"), F.col("value").alias("clean"))
    return met.join(placed.withColumnRenamed("value", "garbled"), ["place", "run"]).join(known, ["place", "clean_run"]).select("garbled", "clean")


def twin_runs(distinct: DataFrame, twins: int) -> DataFrame:
    """(garbled, clean, run, clean_run, ways) of the runs of all twins that some transformation explains.

    The values of a stripped text that has at most ``twins`` of them are paired with each other, those of any other by the bytes of their runs.
    """

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for value in batch["value"]:
                words = value.split(" ")
                other = " ".join(w for w in words if not w.isascii())  # what the value's own numbers and codes don't tell apart
                keys = {f"c{_RUN.sub('', other)}": other, "w" + " ".join(w if w.isascii() else LOST for w in words): value}
                rows.extend((k, v) for k, v in keys.items() if re.search("[0-9A-Za-z]", k[1:]))
            yield pd.DataFrame(rows, columns=["stripped", "value"])

    def align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for g, c, most in zip(batch["garbled"], batch["clean"], batch["most"], strict=True):
                runs = aligned(g, c) or []
                if len(runs) > most:
                    continue
                ways = [explained(a, b) for a, b in runs]
                if ways and (common := set.intersection(*ways)):
                    rows.extend((g, c, a, b, sorted(common)) for a, b in runs)
            yield pd.DataFrame(rows, columns=["garbled", "clean", "run", "clean_run", "ways"])

    keyed = checkpoints.cut(distinct.mapInPandas(keys, "stripped string, value string").distinct())
    sizes = keyed.groupBy("stripped").agg(F.count("*").alias("__n"), F.min(F.contains("value", F.lit(LOST))).alias("__all_lost")).filter((F.col("__n") > 1) & ~F.col("__all_lost"))
    members = checkpoints.cut(keyed.join(sizes.select("stripped", "__n"), "stripped"))
    few, many = (members.filter(f).select("stripped", "value") for f in (F.col("__n") <= twins, F.col("__n") > twins))
    pairs = few.withColumnRenamed("value", "garbled").join(few.withColumnRenamed("value", "clean"), "stripped").filter((F.col("garbled") != F.col("clean")) & ~F.contains("clean", F.lit(LOST))).select("garbled", "clean", F.lit(1 << 31).alias("most"))
    if not many.isEmpty():
        pairs = pairs.unionByName(_by_marks(many).withColumn("most", F.lit(1).cast("long")))
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = pairs.groupBy("garbled", "clean").agg(F.sum("most").alias("most"))  # how many runs may be explained, at most
    return pairs.repartition(parts, "garbled").mapInPandas(align, "garbled string, clean string, run string, clean_run string, ways array<string>")


def covering(counted: list[tuple[frozenset[str], int]], support: int) -> list[str]:
    """The fewest transformations that explain the aligned characters, the one that explains most first; each has ``support`` of them or more."""
    place = {name: i for i, name in enumerate(encodings())}

    def order(way: str) -> tuple[int, int, int]:
        true, wrong = way.split(">")
        return (int(true.endswith("*2")), place[wrong], place[true.removesuffix("*2")])

    left, chosen = list(counted), []
    while left:
        votes: Counter[str] = Counter()
        for ways, n in left:
            votes.update(dict.fromkeys(ways, n))
        way, n = min(votes.items(), key=lambda x: (-x[1], order(x[0])))
        if n < support:
            break
        chosen.append(way)
        left = [(ways, k) for ways, k in left if way not in ways]
    return chosen


def learn(values: DataFrame, distinct: DataFrame, support: int = 4, twins: int = 12) -> tuple[Judge, DataFrame]:
    """(judge, (run, clean_run)): the transformations that twins show, and the runs that they show to mean one other run."""
    counts = neighbour_counts(values)
    found = checkpoints.cut(twin_runs(distinct, twins))
    # letters that differ may be two words (Möller, Müller), so one for one counts once; more characters than letters are hardly chance
    shown = F.when(F.length("run") > F.length("clean_run"), F.length("run") * F.count("*")).otherwise(F.length("run"))
    by_ways = found.groupBy("ways", "run", "clean_run").agg(shown.alias("n")).groupBy("ways").agg(F.sum("n").alias("n")).collect()  # sets of transformations, not values
    learned = covering([(frozenset(r["ways"]), r["n"]) for r in by_ways], support)
    judge = Judge(counts, learned)

    def sound(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[[not judge.judge(c)[0] for c in batch["clean"]]]

    known = found.filter(F.arrays_overlap("ways", F.array(*map(F.lit, learned))) if learned else F.lit(False))
    # one reading of a text may look like another one's bytes, and what is garbled itself shows no clean run
    known = known.join(known.select("clean").distinct().repartition(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))).mapInPandas(sound, "clean string"), "clean")
    runs = known.groupBy("run").agg(F.min("clean_run").alias("clean_run"), F.max("clean_run").alias("__other"), F.count_distinct("garbled").alias("n"))
    return judge, runs.filter((F.col("clean_run") == F.col("__other")) & (F.col("n") > 1)).select("run", "clean_run")


def garbled_values(values: DataFrame, carry: list[str], value: str = "value", support: int = 4, twins: int = 12) -> DataFrame:
    """Columns ``carry``, restored and transformation of each garbled value.

    ``support`` is the number of aligned characters that a transformation needs.  Stripped texts with more than ``twins`` values find theirs
    by bytes and not by pairing all, with the same result (see above).
    """
    picked = values.filter(F.col(value).isNotNull() & F.col(value).rlike(NOT_ASCII)).select(*carry, F.col(value).alias("value"))
    # values are short and costly to judge: many small parts, which no later plan puts together
    distinct = checkpoints.cut(picked.select("value").distinct().repartition(int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    judge, runs = learn(picked, distinct, support, twins)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(v, *verdict[1:]) for v in batch["value"] if (verdict := judge.judge(v))[0]]
            yield pd.DataFrame(rows, columns=["__v", "restored", "transformation"], dtype="object")

    judged = checkpoints.cut(distinct.mapInPandas(run, "__v string, restored string, transformation string"))
    lost = judged.filter(F.col("restored").isNull() | F.contains("restored", F.lit(LOST)))
    pieces = lost.select("__v", F.posexplode(F.regexp_extract_all("__v", F.lit(rf"{NOT_ASCII}+|[\x00-\x7F]+"), F.lit(0))).alias("__at", "run"))
    told = pieces.join(runs, "run", "left").withColumn("clean_run", F.when(F.col("run").rlike(NOT_ASCII), F.col("clean_run")).otherwise(F.col("run")))
    filled = told.groupBy("__v").agg(F.array_sort(F.collect_list(F.struct("__at", "clean_run"))).alias("__told"))  # the runs of one value
    filled = filled.select("__v", F.when(~F.exists("__told", lambda p: p["clean_run"].isNull()), F.array_join("__told.clean_run", "")).alias("__filled"))
    whole = judged.join(filled, "__v", "left").select("__v", F.when(~F.contains("restored", F.lit(LOST)), F.col("restored")).otherwise(F.col("__filled")).alias("restored"), "transformation")
    return picked.join(whole, F.col("value") == F.col("__v")).select(*carry, "restored", "transformation")
