"""Changes between two versions of a page, and text cut into matched and other segments."""

from __future__ import annotations

import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame

CHANGES = "kind string, column string, row_no int, old string, new string"
SEGMENTS = "ord int, text string, match string"


def _cells(line: str) -> list[str] | None:
    line = line.strip()
    if not line.startswith("|"):
        return None
    return [c.strip() for c in re.split(r"(?<!\\)\|", line.strip("|"))]


def _is_rule(cells: list[str]) -> bool:
    return all(re.fullmatch(r":?-+:?|", c) for c in cells)


def changes(old: str | None, new: str | None) -> list[tuple[str, str | None, int | None, str | None, str | None]]:
    """(kind, column, row, old, new): changed cells with their column's header and the row's number below it, and changed lines."""
    a, b = (old or "").split("\n"), (new or "").split("\n")
    header: list[str] = []
    numbers: list[int] = []
    count, inside = 0, False
    for line in a:  # row numbers within each table of the old version
        cells = _cells(line)
        if cells is None:
            inside = False
        elif not inside:
            inside, count = True, 0
            header = header or cells
        elif not _is_rule(cells):
            count += 1
        numbers.append(count)
    out: list[tuple[str, str | None, int | None, str | None, str | None]] = []
    for tag, i, j, k, m in SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        if tag == "equal":
            continue
        for n in range(max(j - i, m - k)):
            x, y = (a[i + n] if i + n < j else None), (b[k + n] if k + n < m else None)
            cx, cy = _cells(x) if x is not None else None, _cells(y) if y is not None else None
            if (cx is not None and _is_rule(cx)) or (cy is not None and _is_rule(cy)):
                continue
            if cx is not None and cy is not None:
                for c in range(max(len(cx), len(cy))):
                    p, q = (cx[c] if c < len(cx) else ""), (cy[c] if c < len(cy) else "")
                    if p != q:
                        out.append(("cell", header[c] if c < len(header) else None, numbers[i + n], p, q))
            elif (x or "").strip() or (y or "").strip():
                out.append(("text", None, None, x, y))
    return out


def segments(text: str | None, matches: list[str]) -> list[tuple[int, str, str | None]]:
    """(ord, text, match): a text cut at its matches, longest first; line breaks cut first."""
    wanted = sorted({m for m in matches if m}, key=lambda m: (-len(m), m))
    pattern = re.compile("|".join(map(re.escape, wanted))) if wanted else None
    out: list[tuple[int, str, str | None]] = []
    for part in re.split(r"(?i)<br\s*/?>", text or ""):
        at = 0
        for m in pattern.finditer(part) if pattern else ():
            if m.start() > at:
                out.append((len(out), part[at : m.start()], None))
            out.append((len(out), m.group(), m.group()))
            at = m.end()
        if at < len(part):
            out.append((len(out), part[at:], None))
    return out


def changed(pairs: DataFrame, key: str, old: str, new: str) -> DataFrame:
    """(key, ord, kind, column, row_no, old, new) of each change between two columns of Markdown."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, i, *c) for k, a, b in zip(batch["k"], batch["a"], batch["b"], strict=True) for i, c in enumerate(changes(a, b))]
            yield pd.DataFrame(rows, columns=[key, "ord", "kind", "column", "row_no", "old", "new"]).astype({"row_no": "Int32", "ord": "int32"})

    kind = dict(pairs.dtypes)[key]
    return pairs.selectExpr(f"`{key}` as k", f"`{old}` as a", f"`{new}` as b").mapInPandas(run, f"`{key}` {kind}, ord int, {CHANGES}")


def segmented(rows: DataFrame, key: str, text: str, matches: str) -> DataFrame:
    """(key, ord, text, match) of the segments of a text column by an array of matches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(k, *s) for k, t, m in zip(batch["k"], batch["t"], batch["m"], strict=True) for s in segments(t, [] if m is None else list(m))]
            yield pd.DataFrame(found, columns=[key, "ord", "text", "match"]).astype({"ord": "int32"})

    kind = dict(rows.dtypes)[key]
    return rows.selectExpr(f"`{key}` as k", f"`{text}` as t", f"`{matches}` as m").mapInPandas(run, f"`{key}` {kind}, {SEGMENTS}")
