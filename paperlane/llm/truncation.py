"""Texts cut off by field limits or in transfer.

Every document has two lengths, in characters and in UTF-8 bytes.  For each source and measure the discrete hazard of
a length is the number of texts that end there over the number that get so far; window functions compare it with the
pooled hazard of the lengths within ``reach`` on both sides, and a Chernoff bound of the Poisson tail gives its p-value.
Lengths are significant by Benjamini-Hochberg within the source.  At significant lengths an ending is a cut unless it is
terminated or a known closing line; elsewhere it must be incomplete by itself: no terminator, and its last line neither
a closing line of the corpus nor of a closing line's form.

Closing lines (signatures, departments, "end of document") are learned: an unterminated last line is one if, at lengths
that are not significant, enough different texts end with it, set against how often the corpus has paragraphs that start
with it and go on.  Counts cover all documents; digits are read as one figure.

Everything is built-in expressions.  The texts are read twice: once for one narrow row per document, which is written and from
which everything else is made, and once for the paragraphs' heads, of which only those meet an aggregation that a candidate closing line
starts with (hashes of bounded number are broadcast after a count, more are joined by shuffle).

Defined results: NULL, empty and blank texts (white space and format characters only) are no cases; copies of a cut
text are cases; NULL sources form one source; repeated rows count as rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperlane.sources import checkpoints

# What closes a sentence, forms of closing lines, and abbreviations that end with a full stop.
_CLOSED = r"[.!?。！？．｡][)）\]\"”’'」』»]*$"
_MARKED = r"(\.\.\.|…|\[\.\.\.\]|\(\.\.\.\))$"
_PART_OF_FIGURE = r"(^|\s)\d{1,2}\.\d{1,2}\.$|[$€£¥]\s?\d[\d,]*\.$|\b(vom|zum|am|bis|den) \d{1,2}\.$"
_ABBREVIATION = r"\b(Ltd|Co|Inc|Corp|No|Nr|Ref|Mr|Mrs|Dr|Str|ca|approx|bzw)\.$"
_FORMS = "|".join((
    r"^\d{4}-\d{2}-\d{2}$", r"^\d{1,2}[./]\d{1,2}[./]\d{4}$", r"^\d{4}年\d{1,2}月\d{1,2}日$",  # dates
    r"^[A-Z]{2,4}-\d{5,}(-\d+)?$",  # references
    r"^\d{1,4} ?/ ?\d{1,4}$|^[-–] ?\d{1,4} ?[-–]$",  # page marks
    r"^[(（\[【][^()（）\[\]【】]{1,40}[)）\]】]$",  # bracketed remarks
    r"^\p{Lu}[\p{L}.&' -]{1,40} (GmbH|AG|KG|SA|SARL|SAS|Ltd|LLC|Inc|Co|Corp|Company|Partners|Industries|Works|Logistics|Group)$",  # companies
    r"^(株式会社|有限会社|合同会社)[\p{IsHan}\p{IsKatakana}ー]{2,12}$|^[\p{IsHan}\p{IsKatakana}ー]{2,12}(株式会社|有限会社|合同会社)$",
))
#: The date behind a signature or a department.
_DATED = r", ?(\d{4}-\d{2}-\d{2}|\d{1,2}[./]\d{1,2}[./]\d{4}|\d{4}年\d{1,2}月\d{1,2}日)$"
#: White space and format characters, trimmed from the end without a pattern over the whole text.
_BLANK = " \t\n\r\x0b\x0c\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\xad\u200b\u200c\u200d\u200e\u200f\u2060\ufeff"


def head_lengths(longest: int) -> list[int]:
    """Lengths at which paragraph heads are counted: each a third longer than the last, up to the longest closing line."""
    out, k = [], 2
    while k <= max(longest, 2):
        out.append(k)
        k = max(k + 1, k * 4 // 3)
    return out


def _figures(text: Column) -> Column:
    return F.regexp_replace(text, r"\p{Nd}", "9")


def endings(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One narrow row per document with letters or digits: lengths, text hash, and how its text ends."""
    raw = F.col(text)
    rows = documents.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(source), F.lit("")).alias("source"), raw.alias("t")).filter(F.col("t").rlike(r"[\p{L}\p{N}]"))
    rows = rows.withColumn("body", F.rtrim("t", F.lit(_BLANK)))
    rows = rows.withColumn("line", F.substring_index("body", "\n", -1)).withColumn("block", F.substring_index("body", "\n\n", -1))
    bars = lambda c: F.length(c) - F.length(F.replace(c, F.lit("|"), F.lit("")))
    header = F.regexp_extract("block", r"(?m)^(\|[^\n]*)", 1)
    is_row = F.col("line").startswith("|")
    whole_row = F.col("line").endswith("|") & (bars(F.col("line")) == bars(header)) & (F.length(header) < F.length("block")) & ~F.col("line").rlike(r"^[|\s:-]+$")
    lost = F.col("body").rlike("�$") | F.col("line").rlike(_MARKED)
    closed = F.when(is_row, whole_row).when(lost, False).otherwise(F.col("line").rlike(_CLOSED) & ~F.col("line").rlike(_PART_OF_FIGURE))
    return rows.select(
        "doc_id", "source", F.length("t").alias("chars"), F.octet_length("t").alias("bytes"), F.xxhash64("t").alias("same"),
        closed.alias("closed"),
        (closed & ~is_row & F.col("line").rlike(_ABBREVIATION) & (F.size(F.split("line", " ")) > 5)).alias("short_form"),
        # surely cut: part of a table row, a lost character, a mark, or an open sentence behind a closed one
        (~closed & (is_row | lost | F.col("line").rlike(r"[.!?] \S|[。！？]."))).alias("surely"),
        F.col("line").rlike(_FORMS).alias("form"),
        F.when(~closed & ~is_row, _figures(F.regexp_replace("line", _DATED, ""))).alias("tail"),
    )


def significant_lengths(ends: DataFrame, reach: int = 40, rate: float = 0.001, least: int = 4) -> DataFrame:
    """(source, measure, length): lengths at which more texts end than at neighbouring ones.

    ``rate`` is the false-discovery rate, ``least`` the number of texts below which a length is not tested.
    """
    measured = ends.select("source", F.explode(F.map_from_arrays(F.array(F.lit("chars"), F.lit("bytes")), F.array("chars", "bytes"))).alias("measure", "length"), "same")
    n = measured.groupBy("source", "measure", "length").agg(F.count_distinct("same").alias("n"))  # copies end where their original does
    group = Window.partitionBy("source", "measure")
    longer = group.orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, 0)
    near = group.orderBy("length").rangeBetween(-reach, reach)
    rows = n.withColumn("risk", F.sum("n").over(longer))
    rows = rows.withColumn("near_n", F.sum("n").over(near) - F.col("n")).withColumn("near_risk", F.sum("risk").over(near) - F.col("risk")).withColumn("near_rows", F.count("*").over(near) - 1)
    # lengths without texts have a hazard of 0 at the same risk, so the pooled hazard is over the whole reach
    pooled = (F.col("near_n") + 1) / (F.greatest(F.col("near_risk"), F.col("risk")) * F.greatest(F.lit(1.0), F.lit(2.0 * reach) / F.greatest(F.col("near_rows"), F.lit(1))))
    rows = rows.filter(F.col("n") >= least).withColumn("mean", F.col("risk") * pooled).filter("n > mean")
    rows = rows.withColumn("log_p", F.col("n") - F.col("mean") - F.col("n") * F.log(F.col("n") / F.col("mean")))
    tested = Window.partitionBy("source")
    ranked = rows.withColumn("rank", F.row_number().over(tested.orderBy("log_p"))).withColumn("tests", F.count("*").over(tested))
    passed = ranked.withColumn("ok", F.when(F.col("log_p") <= F.log(F.lit(rate) * F.col("rank") / F.col("tests")), F.col("rank")))
    return passed.withColumn("last", F.max("ok").over(tested)).filter(F.col("rank") <= F.col("last")).select("source", "measure", "length", "n", "risk", "mean")


def _going_on(documents: DataFrame, text: str, heads: DataFrame, lengths: list[int], most_broadcast: int) -> DataFrame:
    """(head, going_on): of each hash of ``heads`` the number of terminated paragraphs that start with it and go on."""
    paragraph = documents.filter(F.col(text).isNotNull()).select(F.explode(F.split(text, r"\n")).alias("p")).filter(F.col("p").rlike(r"[.!?。！？]$|[.!?] \S|[。！？].") & ~F.col("p").startswith("|"))
    begun = paragraph.select(_figures(F.substring("p", 1, max(lengths) + 1)).alias("begun"))
    cuts = F.transform(F.filter(F.array(*map(F.lit, lengths)), lambda k: k < F.length("begun")), lambda k: F.xxhash64(F.substring("begun", F.lit(1), k), k))
    every = begun.select(F.explode(cuts).alias("head"))
    wanted = heads.filter("head is not null").select("head").distinct()
    if wanted.count() <= most_broadcast:
        return every.join(F.broadcast(wanted), "head").groupBy("head").agg(F.count("*").alias("going_on"))
    return every.groupBy("head").agg(F.count("*").alias("going_on")).join(wanted, "head")


def cut_texts(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", reach: int = 40, rate: float = 0.001, closing_share: float = 0.004, closing_least: int = 3,
              most_broadcast: int = 1_000_000) -> DataFrame:
    """(doc_id, source) of each cut document.

    A last line closes texts if at least ``closing_least`` different texts end with it at ordinary lengths, and these
    are at least ``closing_share`` of the paragraphs that start with it and go on.  ``most_broadcast`` bounds the hashes (8 bytes) that are
    broadcast; it changes the plan only.
    """
    ends = checkpoints.cut(endings(documents, doc_id, text, source))
    limits = significant_lengths(ends, reach, rate)
    # a limit is a (source, measure, length); few survive the test
    at = limits.groupBy("source").agg(F.collect_set(F.when(F.col("measure") == "chars", F.col("length"))).alias("c"), F.collect_set(F.when(F.col("measure") == "bytes", F.col("length"))).alias("b"))
    marked = ends.filter("not closed or short_form").join(at, "source", "left")
    marked = checkpoints.cut(marked.withColumn("at_limit", F.coalesce(F.array_contains("c", F.col("chars")) | F.array_contains("b", F.col("bytes")), F.lit(False))).drop("c", "b", "chars", "bytes"))
    tails = marked.filter(F.col("tail").isNotNull() & ~F.col("surely")).groupBy("tail").agg(F.count_distinct(F.when(~F.col("at_limit"), F.col("same"))).alias("ending"))
    tails = checkpoints.cut(tails.filter(F.col("ending") >= closing_least))  # others close nothing, whatever goes on behind them
    lengths = head_lengths(tails.agg(F.max(F.length("tail"))).first()[0] or 0)
    cut = F.array_max(F.filter(F.array(*map(F.lit, lengths)), lambda k: k <= F.length("tail")))
    tails = tails.withColumn("head", F.when(cut.isNotNull(), F.xxhash64(F.substring("tail", F.lit(1), cut), cut)))
    known = tails.join(_going_on(documents, text, tails, lengths, most_broadcast), "head", "left").withColumn("going_on", F.coalesce("going_on", F.lit(0)))
    closing = F.col("ending") >= F.col("going_on") * closing_share
    always = (F.col("ending") >= 5 * closing_least) & (F.col("ending") >= F.col("going_on"))
    known = known.select("tail", closing.alias("closing"), always.alias("always"))
    judged = marked.join(known, "tail", "left")
    closes = F.coalesce(F.col("closing"), F.lit(False)) | F.col("form")
    is_cut = F.when(F.col("closed"), F.col("short_form") & F.col("at_limit")).otherwise(
        F.col("surely") | ~closes | (F.col("at_limit") & ~F.coalesce(F.col("always"), F.lit(False)) & ~F.col("form")))
    # a copy of a cut text is a case wherever it is
    flagged = judged.filter(is_cut).select("same").distinct()
    return marked.join(flagged, "same", "left_semi").select("doc_id", "source").distinct()


def cut_rates(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **options: float) -> DataFrame:
    """(source, n_rows, n_cut, rate) of every source; a source without cases has the rate 0."""
    rows = documents.groupBy(F.coalesce(F.col(source), F.lit("")).alias("source")).agg(F.count("*").alias("n_rows"))
    cut = cut_texts(documents, doc_id, text, source, **options).groupBy("source").agg(F.count("*").alias("n_cut"))
    return rows.join(cut, "source", "left").select("source", "n_rows", F.coalesce("n_cut", F.lit(0)).alias("n_cut"), (F.coalesce("n_cut", F.lit(0)) / F.col("n_rows")).alias("rate"))
