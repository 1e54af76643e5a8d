"""Freely typed values mapped to the entries of a reference list.

The entries' canonical names and aliases are the paths of one trie per field, ending in entry ids.  A value is brought to
plain form, lower case and bare words, and is searched as typed, without the words around a name that say nothing
(fixed lists, below), and with its comma parts in other orders (rotated and reversed).  The search is the product of
the trie with a Levenshtein automaton (with transpositions), whose rows are shared by all paths with one prefix; it
returns every entry within a distance that depends on the length of the value.  Codes and short names allow less.
Abbreviations are edges of a second automaton over the same names with their word bounds: behind a word's first letter
it may skip the word's letters, beside the rows that allow edits.

Hits have a level: paths met exactly, then the distance of paths met with edits, then abbreviations.  Of several entries that of
the least level wins; a tie between entries means that none is meant.  Values that reach none are reported with ``NO_ENTRY``.

Defined results: NULL and blank values give no row; fields without entries give ``NO_ENTRY``; repeated values are mapped
alike.  A list of at most ``block_entries`` entries is sent to the tasks; a longer one stays distributed: its blocks meet
the distinct values in cogroups, each block gives its least level with the entries there, and levels and ties are merged over blocks,
so that blocks change no result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperlane.llm.plainform import plain
from paperlane.sources import checkpoints

NO_ENTRY = -1
_SPLIT = re.compile(r"[^\w]+|_+")
_CODE = re.compile(r"^(?=.*\d)[a-z0-9]{3,8}$")
# What people write around a name without meaning another one.
BEFORE = ("city of", "dep", "deputy", "senior", "sr", "junior", "jr", "acting", "the")
BEHIND = ("city", "shi", "jp", "de", "fr", "us", "uk", "brand", "r", "tm", "inc", "ltd", "co", "day shift", "night shift", "late shift", "acting")
UNITS = "市区町村"
_AROUND = {w for x in BEFORE + BEHIND for w in x.split()}


def bare(text: str) -> list[list[str]]:
    """The readings of a value as lists of words, the one as typed first."""
    text = (plain(text) or "").casefold()
    whole = [w for w in _SPLIT.split(text) if w]
    readings = [whole]
    parts = [p for p in ([w for w in _SPLIT.split(p) if w] for p in re.split("[,、]", text)) if p]
    for k in range(len(parts) if len(parts) > 1 else 0):
        turned = parts[k:] + parts[:k]
        readings.extend([w for p in order for w in p] for order in (turned, turned[::-1]) if order != parts)
    for words in list(readings):
        kept = [w for w in words if w not in _AROUND]
        if kept and kept != words:
            readings.append(kept)
    return readings


def allowance(length: int, code: bool) -> int:
    """Edits that a name of so many letters may have."""
    if code or length < 4:
        return 0
    return 1 if length < 8 else 2 if length < 18 else 3


class Trie:
    """Names of one field as paths over their letters; a node is a dict of children, the key '' holds entry ids.

    ``names`` has the names alone, with a blank where a word ends.
    """

    def __init__(self) -> None:
        self.root: dict = {}
        self.names: dict = {}
        self.longest = 0

    def add(self, name: str, entry: int) -> None:
        """Add a name and the paths that mean it: with words around it, its unit left out, its first words as initials,
        its last word cut short.  The last three and codes are reached without edits only."""
        words = bare(name)[0]
        key = "".join(words)
        if not key:
            return
        code = bool(_CODE.match(key))
        self._path(key, entry, code)
        node = self.names
        for c in " ".join(words):
            node = node.setdefault(c, {})
        node.setdefault("", set()).add(entry)
        if code:
            return
        for before in BEFORE:
            self._path(before.replace(" ", "") + key, entry, False)
        for behind in BEHIND:
            self._path(key + behind.replace(" ", ""), entry, False)
        if len(key) > 2 and key[-1] in UNITS:
            self._path(key[:-1], entry, True)
        if len(words) > 2:
            self._path("".join(w[0] for w in words[:-1]) + words[-1], entry, False)
        if len(words) > 1:
            for k in range(2, len(words[-1])):
                self._path("".join(words[:-1]) + words[-1][:k], entry, True)

    def _path(self, key: str, entry: int, exact: bool) -> None:
        self.longest = max(self.longest, len(key))
        node = self.root
        for c in key:
            node = node.setdefault(c, {})
        ends = node.setdefault("", {})
        ends[entry] = exact and ends.get(entry, True)

    def exact(self, key: str) -> set[int]:
        """Entries with a path that is ``key``."""
        node = self.root
        for c in key:
            if (node := node.get(c)) is None:
                return set()
        return set(node.get("", ())) if key else set()

    def search(self, key: str, most: int, by_length: bool = False) -> dict[int, int]:
        """Entry -> least distance, of all entries within ``most`` edits (insert, delete, replace, swap of neighbours).

        With ``by_length`` a path allows no more edits than its own length does.
        """
        found: dict[int, int] = {}
        n = len(key)
        stack: list[tuple[dict, str, list[int], list[int] | None, int]] = [(self.root, "", list(range(n + 1)), None, 0)]
        while stack:
            node, last, row, before, depth = stack.pop()
            for c, child in node.items():
                if c == "":
                    if row[n] <= (min(most, allowance(depth, False)) if by_length else most):
                        for entry, exact in child.items():
                            if row[n] == 0 or not exact:
                                found[entry] = min(found.get(entry, most), row[n])
                    continue
                new = [row[0] + 1]
                for j in range(1, n + 1):
                    v = min(new[j - 1] + 1, row[j] + 1, row[j - 1] + (key[j - 1] != c))
                    if before is not None and j > 1 and key[j - 1] == last and key[j - 2] == c:
                        v = min(v, before[j - 2] + 1)
                    new.append(v)
                if min(new) <= most:
                    stack.append((child, c, new, row, depth + 1))
        return found


    def abbreviated(self, words: list[str]) -> set[int]:
        """Entries with as many words (two or more) as the given ones, each of which is a word of the name, within the edits
        that its length allows, or stands for it: letters of the word, in order and from its first."""
        out: set[int] = set()
        if len(words) < 2:
            return out
        most = allowance(1 << 30, False)
        # (node, word's place, letters of it met in order or -1, edit row, depth inside the name's word)
        stack: list[tuple[dict, int, int, list[int], int]] = [(self.names, 0, 0, list(range(len(words[0]) + 1)), 0)]
        while stack:
            node, at, met, row, depth = stack.pop()
            word = words[at]
            done = depth > 0 and (met == len(word) or row[-1] <= allowance(depth, False))
            for c, child in node.items():
                if c == "":
                    if done and at + 1 == len(words):
                        out |= child
                elif c == " ":
                    if done and at + 1 < len(words):
                        stack.append((child, at + 1, 0, list(range(len(words[at + 1]) + 1)), 0))
                else:
                    if met >= 0:  # a letter that the short form leaves out, but never the first
                        new_met = met + 1 if met < len(word) and word[met] == c else -1 if depth == 0 else met
                    else:
                        new_met = -1
                    new = [row[0] + 1]
                    for j in range(1, len(word) + 1):
                        new.append(min(new[j - 1] + 1, row[j] + 1, row[j - 1] + (word[j - 1] != c)))
                    if new_met >= 0 or min(new) <= most:
                        stack.append((child, at, new_met, new, depth + 1))
        return out

    def shortened(self, key: str) -> set[int]:
        """Entries whose words but the last are the start of ``key`` and whose last word the rest of it stands for."""
        out: set[int] = set()
        whole = [(self.names, 0)]  # met letter by letter so far
        while whole:
            node, at = whole.pop()
            if at < len(key) and (child := node.get(key[at])):
                whole.append((child, at + 1))
            if (after := node.get(" ")) is None or not 0 < at < len(key):
                continue
            whole.append((after, at))
            last = [(after, at, True)]
            while last:
                inner, met, first = last.pop()
                for c, child in inner.items():
                    if c == "":
                        if met == len(key):
                            out |= child
                    elif c != " " and not (first and c != key[at]):
                        last.append((child, met + (met < len(key) and c == key[met]), False))
        return out


def resolve(trie: Trie, value: str) -> tuple[int, set[int]]:
    """(level, entries) of a value: 0 for paths that are it, 1 to 3 for edits, 9 for abbreviations; (99, none) without a hit."""
    readings = [w for w in bare(value) if w]
    keys = ["".join(w) for w in readings]
    if not keys or min(map(len, keys)) > trie.longest + allowance(1 << 30, False):
        return 99, set()
    if exact := set().union(*map(trie.exact, keys)):
        return 0, exact
    best: dict[int, int] = {}
    for key in keys:
        code = bool(_CODE.match(key))
        for entry, d in trie.search(key, 0 if code else allowance(len(key) + 2, False), by_length=True).items():
            best[entry] = min(best.get(entry, d), d)
    if best:
        least = min(best.values())
        return least, {e for e, d in best.items() if d == least}
    short = set().union(*map(trie.abbreviated, readings), *map(trie.shortened, keys))
    return (9, short) if short else (99, set())


def build(entries: list[tuple[int, str, list[str]]]) -> dict[str, Trie]:
    """Tries by field from (entry_id, field_key, names)."""
    tries: dict[str, Trie] = {}
    for entry, field, names in entries:
        for name in names:
            tries.setdefault(field, Trie()).add(name, entry)
    return tries


def map_values(values: DataFrame, field: str, text: str, reference: DataFrame, carry: list[str], block_entries: int = 50_000, remember: int = 200_000) -> DataFrame:
    """Columns ``carry``, entry_id and level of each value of ``text`` that is neither NULL nor blank.

    ``reference`` has (entry_id, field_key, canonical, aliases).  ``remember`` bounds the values a worker keeps results of.
    """
    names = F.concat(F.array("canonical"), F.coalesce(F.expr("transform(filter(aliases, a -> a.text is not null), a -> a.text)"), F.array().cast("array<string>")))
    rows = reference.filter("entry_id is not null and canonical is not null").select(F.col("entry_id").cast("long").alias("entry_id"), "field_key", names.alias("names"))
    blank = r"^[\s\p{Z}\p{Cf}]*$"
    wanted = values.filter(F.col(text).isNotNull() & ~F.col(text).rlike(blank) & F.col(field).isNotNull()).select(*carry, F.col(field).alias("__field"), F.col(text).alias("__text"))
    schema = wanted.select(*carry, F.lit(0).cast("long").alias("entry_id"), F.lit(0).alias("level")).schema
    n = rows.count()
    if n > block_entries:
        return _in_blocks(wanted, rows, carry, -(-n // block_entries))
    listed = [(r["entry_id"], r["field_key"], list(r["names"])) for r in rows.collect()]  # at most block_entries

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tries, memory = build(listed), {}
        for batch in batches:
            hits = []
            for f, t in zip(batch["__field"], batch["__text"], strict=True):
                hit = memory.get((f, t))
                if hit is None:
                    level, entries = resolve(tries[f], t) if f in tries else (99, set())
                    hit = (next(iter(entries)) if len(entries) == 1 else NO_ENTRY, level)
                    if len(memory) < remember:
                        memory[f, t] = hit
                hits.append(hit)
            out = batch[carry].copy()
            out["entry_id"] = pd.Series([h[0] for h in hits], index=out.index, dtype="int64")
            out["level"] = pd.Series([h[1] for h in hits], index=out.index, dtype="int32")
            yield out

    return wanted.mapInPandas(run, schema)


def _in_blocks(wanted: DataFrame, rows: DataFrame, carry: list[str], blocks: int) -> DataFrame:
    """The same for a list that stays distributed: every block of it against every part of the distinct values."""
    distinct = checkpoints.cut(wanted.select("__field", "__text").distinct())
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    split = F.pmod(F.xxhash64("__field", "__text"), F.lit(parts)).cast("int")
    block = F.pmod(F.xxhash64("entry_id"), F.lit(blocks)).cast("int")
    left = distinct.withColumn("split", split).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = rows.withColumn("block", block).withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def search(values: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
        tries = build([(e, f, list(n)) for e, f, n in zip(entries["entry_id"], entries["field_key"], entries["names"], strict=True)]) if len(values) else {}
        out = []
        for f, t in zip(values["__field"], values["__text"], strict=True):
            level, found = resolve(tries[f], t) if f in tries else (99, set())
            out.extend((f, t, level, e) for e in sorted(found)[:2] or [NO_ENTRY])  # two show a tie
        return pd.DataFrame(out, columns=["__field", "__text", "level", "entry_id"])

    hits = left.groupBy("block", "split").cogroup(right.groupBy("block", "split")).applyInPandas(search, "__field string, __text string, level int, entry_id long")
    levels = hits.groupBy("__field", "__text", "level").agg(F.min("entry_id").alias("low"), F.max("entry_id").alias("high"))
    least = levels.groupBy("__field", "__text").agg(F.min(F.struct("level", "low", "high")).alias("hit"))
    entry = F.when(F.col("hit.low") == F.col("hit.high"), F.col("hit.low")).otherwise(F.lit(NO_ENTRY).cast("long"))
    resolved = least.select("__field", "__text", entry.alias("entry_id"), F.col("hit.level").alias("level"))
    return wanted.join(resolved, ["__field", "__text"]).select(*carry, "entry_id", "level")
