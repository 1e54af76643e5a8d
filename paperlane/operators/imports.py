"""Tabular files imported as records: preview, header decision, inferred fields, rows with outcome, tally.

Rows come from ``sources.files`` as (path, row_no, cells).  What a file decides (its header, its fields) is one row per file made from
its first nine rows; the data rows are never gathered.

Defined results: files without rows give no preview; a file whose header names no field has every data row in error; empty rows and
rows that are known or came before are skipped; cells beyond the header are ignored, missing ones are absent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperlane.operators.relational import signature

# Words that header cells contain.
HEADER_HINTS = ("名", "コード", "番号", "単価", "価格", "数量", "金額", "日付", "住所", "name", "code", "price", "amount", "qty", "id", "no.", "email", "tel")
FIELD = "array<struct<key:string,label:string,required:boolean>>"


def fields_of(fields: list[dict]) -> Column:
    """A literal list of fields (key, label, required)."""
    rows = [F.struct(F.lit(f["key"]).alias("key"), F.lit(f["label"]).alias("label"), F.lit(bool(f.get("required"))).alias("required")) for f in fields]
    return F.array(*rows).cast(FIELD)


def header_guess(sample: Column, fields: Column) -> Column:
    """Whether the first of a file's first nine rows names its columns: by a field, by words above figures, or by a header's words."""
    first = sample[0]
    figures = lambda c: c.rlike(r"^[\p{Nd},.\-¥￥%/年月日: ]+$")
    below = lambda k: F.filter(F.transform(F.slice(sample, 2, 8), lambda r: F.get(r, k)), lambda c: c.isNotNull() & (c != ""))
    names_field = F.exists(first, lambda c: F.exists(fields, lambda f: (f["key"] == c) | (f["label"] == c)))
    words_on_figures = F.exists(F.sequence(F.lit(0), F.size(first) - 1), lambda k: (F.get(first, k) != "") & ~figures(F.get(first, k)) & (F.size(below(k)) > 0) & F.forall(below(k), figures))
    has_hint = F.exists(first, lambda c: F.exists(F.array(*map(F.lit, HEADER_HINTS)), lambda h: F.contains(F.lower(c), h)))
    return (F.size(first) > 0) & (names_field | words_on_figures | has_hint)


def inferred_fields(header: Column) -> Column:
    """Fields of a header's filled cells: ASCII names as lower-case keys, other names ``col_<n>``; a key that is taken gets ``_<n>``."""
    ascii_key = lambda c: F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9_]", "_"), "^_+|_+$", "")
    cells = F.transform(header, lambda c, i: F.struct(F.trim(c).alias("label"), (i + 1).alias("n")))

    def add(done: Column, cell: Column) -> Column:
        number = F.concat(F.lit("col_"), cell["n"].cast("string"))
        key = F.when(cell["label"].rlike(r"^[A-Za-z0-9_\- ]+$") & (ascii_key(cell["label"]) != ""), ascii_key(cell["label"])).otherwise(number)
        free = F.when(F.exists(done, lambda f: f["key"] == key), F.concat(key, F.lit("_"), cell["n"].cast("string"))).otherwise(key)
        return F.array_append(done, F.struct(free.alias("key"), cell["label"].alias("label"), F.lit(False).alias("required"))).cast(FIELD)

    return F.aggregate(F.filter(cells, lambda c: c["label"] != ""), F.array().cast(FIELD), add)


def previews(rows: DataFrame, fields: list[dict], shown: int = 6) -> DataFrame:
    """(path, first_rows, total_rows, guessed_header) of each file."""
    heads = _heads(rows)
    return heads.select("path", F.slice("sample", 1, shown).alias("first_rows"), "total_rows", header_guess(F.col("sample"), fields_of(fields)).alias("guessed_header"))


def _heads(rows: DataFrame) -> DataFrame:
    """(path, sample, total_rows, width): the first nine rows of each file."""
    first = F.array_sort(F.collect_list(F.when(F.col("row_no") <= 9, F.struct("row_no", "cells"))))  # at most nine
    return rows.groupBy("path").agg(first["cells"].alias("sample"), F.count("*").alias("total_rows"), F.max(F.size("cells")).alias("width"))


def imported(rows: DataFrame, fields: list[dict], existing: DataFrame, has_header: bool | None = None) -> DataFrame:
    """(path, line_no, data, outcome, reason) of each data row: ``created``, ``skipped`` or ``error``.

    Without ``fields`` they are inferred from the file. The header names fields by key or label; without one, columns are the fields in order.
    """
    known = fields_of(fields)
    heads = _heads(rows).withColumn("with_header", header_guess(F.col("sample"), known) if has_header is None else F.lit(has_header))
    numbered = F.transform(F.sequence(F.lit(1), F.col("width")), lambda i: F.struct(F.concat(F.lit("col_"), i.cast("string")).alias("key"), F.concat(F.lit("列"), i.cast("string")).alias("label"), F.lit(False).alias("required"))).cast(FIELD)
    heads = heads.withColumn("fields", known if fields else F.when(F.col("with_header"), inferred_fields(F.col("sample")[0])).otherwise(numbered))
    by_label = F.transform(F.col("sample")[0], lambda c: F.coalesce(F.get(F.filter("fields", lambda f: f["label"] == c), F.lit(0))["key"], c))
    heads = heads.withColumn("header", F.when(F.col("with_header"), by_label).otherwise(F.col("fields.key")))
    heads = heads.withColumn("named", F.exists("fields", lambda f: F.array_contains("header", f["key"]))).select("path", "with_header", "fields", "header", "named")
    body = rows.join(heads, "path").filter(~F.col("with_header") | (F.col("row_no") > 1))
    # of columns with one name the last counts
    place = lambda key: F.size("header") - F.array_position(F.reverse("header"), key).cast("int")
    entries = F.transform(F.filter("fields", lambda f: F.array_contains("header", f["key"])), lambda f: F.struct(f["key"].alias("key"), F.trim(F.get("cells", place(f["key"]))).alias("value")))
    body = body.withColumn("data", F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull())))
    lacking = F.get(F.filter("fields", lambda f: f["required"] & (F.coalesce(F.try_element_at("data", f["key"]), F.lit("")) == "")), F.lit(0))["label"]
    body = body.withColumn("reason", F.when(~F.col("named"), "the header names no field").otherwise(F.concat(F.lit("field '"), lacking, F.lit("' is required")))).withColumn("sig", signature(F.col("data")))
    old = existing.select(signature(F.col("data")).alias("sig")).distinct().withColumn("old", F.lit(True))
    firsts = body.filter("reason is null").groupBy("path", "sig").agg(F.min("row_no").alias("first"))
    joined = body.join(old, "sig", "left").join(firsts, ["path", "sig"], "left")
    outcome = F.when(F.col("reason").isNotNull(), "error").when((F.col("sig") == "") | F.col("old") | (F.col("row_no") > F.col("first")), "skipped").otherwise("created")
    return joined.select("path", F.col("row_no").alias("line_no"), "data", outcome.alias("outcome"), "reason")


def tally(outcomes: DataFrame, shown: int = 20) -> DataFrame:
    """(path, created, skipped, failed, errors): counts of each file, and its first errors as ``line <n>: <reason>``."""
    counts = outcomes.groupBy("path").agg(*[F.count_if(F.col("outcome") == o).alias(n) for o, n in (("created", "created"), ("skipped", "skipped"), ("error", "failed"))])
    order = Window.partitionBy("path").orderBy("line_no")
    first = outcomes.filter("outcome = 'error'").withColumn("__n", F.row_number().over(order)).filter(F.col("__n") <= shown)
    errors = first.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("line_no", "reason"))).alias("e"))  # at most `shown`
    said = F.transform("e", lambda x: F.concat(F.lit("line "), x["line_no"].cast("string"), F.lit(": "), x["reason"]))
    return counts.join(errors, "path", "left").select("path", "created", "skipped", "failed", F.coalesce(said, F.array().cast("array<string>")).alias("errors"))


def checked_fields(fields: DataFrame) -> DataFrame:
    """(type_id, fields, error) of field definitions (type_id, fields array of key, label, matchable, required): keys as slugs, or what is wrong."""
    slug = lambda f: F.regexp_replace(F.lower(F.trim(F.coalesce(f["key"], F.lit("")))), "[^a-z0-9_]", "_")
    clean = F.transform("fields", lambda f: F.struct(slug(f).alias("key"), F.trim(F.coalesce(f["label"], F.lit(""))).alias("label"), F.coalesce(f["matchable"], F.lit(False)).alias("matchable"), F.coalesce(f["required"], F.lit(False)).alias("required")))
    rows = fields.select("type_id", clean.alias("clean"))
    keys = F.col("clean.key")
    twice = F.get(F.filter(F.array_distinct(keys), lambda k: F.size(F.filter(keys, lambda x: x == k)) > 1), F.lit(0))
    error = (
        F.when(F.exists("clean", lambda f: (f["key"] == "") | (f["label"] == "")), "every field needs a key and a label")
        .when(twice.isNotNull(), F.concat(F.lit("duplicate field key: "), twice))
        .when((F.size("clean") > 0) & ~F.exists("clean", lambda f: f["matchable"]), "at least one field must be matchable")
    )
    return rows.withColumn("error", error).select("type_id", F.when(F.col("error").isNull(), F.col("clean")).alias("fields"), "error")
