"""Column functions over Markdown: cells, blocks, text units, tables.

Built-in higher-order functions; only HTML tables need a parser.
"""

from __future__ import annotations

from html import unescape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperlane.functions.text import WS, collapsed, lines, strip, without_breaks

_EMPTY = "array<string>"


def _none() -> Column:
    return F.array().cast(_EMPTY)


def cells_of(line: Column) -> Column:
    """The cells between the outer bars of a row, split at every bar."""
    return F.transform(F.split(F.regexp_replace(F.regexp_replace(strip(line), r"^\|", ""), r"\|$", ""), r"\|", -1), strip)


def unescaped_cells(line: Column) -> Column:
    """The cells of a row, split at bars that aren't escaped; escapes are resolved."""
    return F.transform(F.split(F.regexp_replace(F.regexp_replace(strip(line), r"^\|", ""), r"(?<!\\)\|$", ""), r"(?<!\\)\|", -1), lambda c: F.replace(strip(c), F.lit("\\|"), F.lit("|")))


def is_row(line: Column) -> Column:
    return strip(line).startswith("|") & strip(line).endswith("|") & (F.length(strip(line)) > 1)


def is_rule(cells: Column) -> Column:
    """Whether all cells are those of a rule under a header."""
    return F.forall(cells, lambda c: c.rlike(r"^:?-{3,}:?$"))


def table_cells(text: Column) -> Column:
    """array<array<string>>: the cells of all table rows but rules, collapsed."""
    rows = F.transform(F.filter(lines(text), is_row), lambda r: F.transform(cells_of(r), collapsed))
    return F.filter(rows, lambda r: ~is_rule(r))


def plain_text(text: Column) -> Column:
    """Markdown as plain text: no blank, image and rule lines, rows as their cells two spaces apart."""

    def flat(line: Column) -> Column:
        cells = F.filter(F.transform(cells_of(line), lambda c: strip(without_breaks(c, " "))), lambda c: c != "")
        return F.when(line.startswith("|"), F.array_join(cells, "  ")).otherwise(without_breaks(line, "\n"))

    kept = F.filter(F.transform(lines(text), strip), lambda x: (x != "") & ~x.startswith("![") & ~(x.startswith("|") & x.rlike(r"^[\s\-:|]+$")))
    return strip(F.array_join(F.transform(kept, flat), "\n"))


def text_units(text: Column) -> Column:
    """What may name something: each line of running text, its words of two letters or more, then the same of table cells.

    Heading marks are dropped, rows and images are not running text, repeated units keep their first place.
    """

    def split(unit: Column) -> Column:
        words = F.filter(F.split(unit, rf"{WS}+"), lambda w: w != "")
        several = lambda ws: F.when(F.size(ws) > 1, F.filter(ws, lambda w: F.length(w) >= 2)).otherwise(F.array().cast(_EMPTY))
        return F.concat(F.array(unit), F.flatten(F.transform(F.array(words), several)))

    running = F.filter(F.transform(lines(text), lambda x: strip(F.regexp_replace(strip(x), "^#+", ""))), lambda x: (x != "") & ~x.startswith("|") & ~x.startswith("!["))
    cells = F.filter(F.flatten(table_cells(text)), lambda c: c != "")
    return F.array_distinct(F.concat(F.flatten(F.transform(running, split)), F.flatten(F.transform(cells, split))))


def escaped_cell(cell: Column) -> Column:
    return F.replace(F.replace(strip(cell), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit("<br>"))


def rendered_table(rows: Column) -> Column:
    """array<array<string>> as a Markdown table; the first row is the header, short rows are filled up; empty without rows."""
    width = F.array_max(F.transform(rows, F.size))

    def row(cells: Column) -> Column:
        filled = F.concat(F.transform(cells, escaped_cell), F.array_repeat(F.lit(""), F.greatest(width - F.size(cells), F.lit(0))))
        return F.concat(F.lit("| "), F.array_join(filled, " | "), F.lit(" |"))

    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    drawn = F.concat(F.array(row(rows[0]), rule), F.transform(F.slice(rows, 2, F.size(rows)), row))
    return F.when(F.size(rows) > 0, F.array_join(drawn, "\n")).otherwise(F.lit(""))


def blocks(text: Column) -> Column:
    """array<struct<ord, kind, content>>: runs of table rows, images, and other lines of a Markdown text, in order."""
    kinds = F.transform(F.filter(F.transform(F.split(text, "\n", -1), strip), lambda x: x != ""), lambda x: F.struct(F.when(x.startswith("|"), F.lit("table")).when(x.rlike(r"^!\[[^\]]*\]\([^)]*\)"), F.lit("image")).otherwise(F.lit("text")).alias("kind"), x.alias("line")))
    kind = "array<struct<ord:int,kind:string,content:string>>"

    def add(done: Column, x: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        joins = (x["kind"] == "table") & (last["kind"] == "table")
        more = F.struct(last["ord"].alias("ord"), last["kind"].alias("kind"), F.concat(last["content"], F.lit("\n"), x["line"]).alias("content"))
        new = F.struct((F.size(done)).alias("ord"), x["kind"].alias("kind"), x["line"].alias("content"))
        return F.when(joins, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(more))).otherwise(F.concat(done, F.array(new)))

    return F.aggregate(kinds, F.array().cast(kind), lambda d, x: add(d, x).cast(kind))


class _Table(HTMLParser):
    """Rows of cells of an HTML table; spanned columns are blank, spanned rows are not followed."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[list[str]] = []
        self.cell: list[str] | None = None
        self.span = 1

    def close_cell(self) -> None:
        if self.cell is not None:
            if not self.rows:
                self.rows.append([])
            self.rows[-1].extend(["".join(self.cell).strip(), *[""] * (self.span - 1)])
        self.cell = None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "tr":
            self.close_cell()
            self.rows.append([])
        elif tag in ("td", "th"):
            self.close_cell()
            self.cell = []
            digits = "".join(filter(str.isdigit, dict(attrs).get("colspan") or "1"))
            self.span = min(max(1, int(digits or 1)), 1000)
        elif tag == "br" and self.cell is not None:
            self.cell.append("\n")

    def handle_endtag(self, tag: str) -> None:
        if tag in ("td", "th", "tr", "table"):
            self.close_cell()

    def handle_data(self, data: str) -> None:
        if self.cell is not None:
            self.cell.append(data)


def html_rows(html: str) -> list[list[str]]:
    parser = _Table()
    parser.feed(html)
    parser.close()
    parser.close_cell()
    return [r for r in parser.rows if any(r)]


def drawn(rows: list[list[str]]) -> str:
    """Rows as a Markdown table, as :func:`rendered_table` draws them."""
    width = max(map(len, rows), default=0)
    cell = lambda c: c.strip().replace("|", "\\|").replace("\n", "<br>")
    lines = ["| " + " | ".join([*map(cell, r), *[""] * (width - len(r))]) + " |" for r in rows]
    return "\n".join([lines[0], "| " + " | ".join(["---"] * width) + " |", *lines[1:]]) if lines else ""


def html_table(html: Column) -> Column:
    """An HTML table as Markdown; text without rows loses its tags."""

    @F.pandas_udf(T.StringType())
    def table(values: pd.Series) -> pd.Series:
        return values.map(lambda v: drawn(html_rows(v)), na_action="ignore")

    found = F.when(html.rlike(r"(?i)<t[dhr]\b"), F.nullif(table(html), F.lit("")))
    return F.coalesce(found, stripped_tags(html))


def stripped_tags(html: Column) -> Column:
    return strip(F.regexp_replace(html, "<[^>]+>", " "))


def block_region(label: Column, content: Column) -> Column:
    """struct<kind, markdown, vertical> of a recognised layout block by its label."""
    label = F.lower(F.coalesce(label, F.lit("text")))

    @F.pandas_udf(T.StringType())
    def decoded(values: pd.Series) -> pd.Series:
        return values.map(unescape, na_action="ignore")

    body = strip(decoded(F.coalesce(content, F.lit(""))))
    kind = F.when(label == "table", "table").when(label.isin("doc_title", "paragraph_title", "title"), "title").when(label.isin("image", "figure", "chart", "seal"), "figure").when(label.contains("hand"), "handwriting").otherwise("text")
    table = F.when(F.lower(content).contains("<table"), html_table(content)).otherwise(content)
    markdown = F.when(kind == "table", table).when(kind == "title", F.concat(F.lit("## "), body)).when(kind == "figure", F.lit("")).otherwise(body)
    return F.struct(kind.alias("kind"), markdown.alias("markdown"), label.contains("vert").alias("vertical"))


_EDITED = "array<struct<kind:string,text:string,rows:array<array<string>>>>"


def edited_blocks(text: Column) -> Column:
    """array<struct<kind, text, rows>>: tables (their rows of unescaped cells, rules left out), images and lines of text, as an editor shows them.

    A blank line ends a table. :func:`serialized` writes them back.
    """
    right = lambda x: F.regexp_replace(x, rf"{WS}+$", "")
    cells = lambda x: F.transform(F.split(F.substring(x, F.lit(2), F.length(x) - 2), r"(?<!\\)\|", -1), lambda c: F.replace(F.replace(strip(c), F.lit("\\|"), F.lit("|")), F.lit("<br>"), F.lit("\n")))
    kind = lambda x: F.when(x.rlike(r"^\|[\s\-:|]+\|$"), "rule").when(x.startswith("|") & x.endswith("|") & (F.length(x) > 1), "table").when(strip(x) == "", "blank").when(strip(x).rlike(r"^!\[[^\]]*\]\(.+\)$"), "image").otherwise("text")
    state = f"struct<done:{_EDITED},open:boolean>"
    lines_of = F.transform(F.transform(F.split(text, "\n", -1), right), lambda x: F.struct(kind(x).alias("kind"), x.alias("line"), F.when(kind(x) == "table", cells(x)).alias("cells")))

    def add(s: Column, x: Column) -> Column:
        last = F.try_element_at(s["done"], F.lit(-1))
        longer = F.struct(last["kind"].alias("kind"), last["text"].alias("text"), F.array_append(last["rows"], x["cells"]).alias("rows"))
        new = F.struct(x["kind"].alias("kind"), F.when(x["kind"] != "table", strip(x["line"])).alias("text"), F.when(x["kind"] == "table", F.array(x["cells"])).alias("rows"))
        done = (
            F.when(x["kind"].isin("rule", "blank"), s["done"])
            .when((x["kind"] == "table") & s["open"], F.concat(F.slice(s["done"], 1, F.size(s["done"]) - 1), F.array(longer).cast(_EDITED)))
            .otherwise(F.concat(s["done"], F.array(new).cast(_EDITED)))
        )
        return F.struct(done.alias("done"), F.when(x["kind"] == "rule", s["open"]).otherwise(x["kind"] == "table").alias("open")).cast(state)

    return F.aggregate(lines_of, F.struct(F.array().cast(_EDITED).alias("done"), F.lit(False).alias("open")).cast(state), add)["done"]


def serialized(blocks: Column) -> Column:
    """The Markdown of :func:`edited_blocks`, a blank line between them; empty rows, tables and texts are left out."""
    filled = lambda rows: F.filter(rows, lambda r: F.exists(r, lambda c: strip(c) != ""))
    drawn = F.transform(blocks, lambda b: F.when(b["kind"] == "table", rendered_table(filled(b["rows"]))).otherwise(b["text"]))
    return F.array_join(F.filter(drawn, lambda t: t != ""), "\n\n")
