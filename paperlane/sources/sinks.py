"""Results as files: Markdown, JSON lines, CSV lines, spreadsheet rows, HTML pages, digests, events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperlane.functions.markdown import blocks, plain_text, unescaped_cells
from paperlane.functions.text import category_label, guarded_cell, markdown_path, without_breaks

PAGE_BREAK = "\n\n---\n\n"


def write_splits(rows: DataFrame, path: str) -> None:
    """JSON lines, one folder per split."""
    rows.write.mode("overwrite").partitionBy("split").json(path)


def write_markdown(documents: DataFrame, path: str, parts: int | None = None) -> None:
    """(document_id, markdown) as Parquet, the file layout that scales; one row per document."""
    rows = documents if parts is None else documents.repartition(parts, "document_id")
    rows.write.mode("overwrite").parquet(path)


def write_document_files(documents: DataFrame, root: str) -> DataFrame:
    """(document_id, path, bytes) of the files that documents (company_id, document_id, markdown) are written to below ``root``: one UTF-8 file per
    document, replaced if it is there.

    The result must be consumed for the files to be written. For many documents :func:`write_markdown` is the layout that scales.
    """
    rows = documents.filter("markdown is not null").select(F.col("document_id").cast("string").alias("document_id"), markdown_path(F.col("company_id"), F.col("document_id")).alias("path"), "markdown")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        files, base = fs.FileSystem.from_uri(root if "://" in root else f"file://{root}")
        for batch in batches:
            sizes = []
            for path, text in zip(batch["path"], batch["markdown"], strict=True):
                data = text.encode()
                files.create_dir(f"{base}/{path}".rsplit("/", 1)[0], recursive=True)
                with files.open_output_stream(f"{base}/{path}") as out:
                    out.write(data)
                sizes.append(len(data))
            yield batch[["document_id", "path"]].assign(bytes=sizes)

    return rows.mapInPandas(run, "document_id string, path string, bytes long")


def spreadsheet_rows(documents: DataFrame) -> DataFrame:
    """What a bulk export has per document (original_filename, doc_type, created_at, markdown): name, category, day, text; no formulas."""
    return documents.select(
        guarded_cell(F.col("original_filename")).alias("name"), guarded_cell(category_label(F.coalesce("doc_type", F.lit("other")))).alias("category"),
        F.date_format("created_at", "yyyy/MM/dd").alias("day"), guarded_cell(plain_text(F.coalesce("markdown", F.lit("")))).alias("text"))


def csv_line(values: Column) -> Column:
    """An array of strings as one fully quoted CSV line."""
    return F.array_join(F.transform(values, lambda v: F.concat(F.lit('"'), F.replace(F.coalesce(v, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))), ",")


def field_csv(labels: Column, values: Column) -> Column:
    """A file of one record: byte order mark, labels, quoted values."""
    return F.concat(F.lit("﻿"), F.array_join(labels, ","), F.lit("\r\n"), csv_line(values))


def template_csv(keys: Column) -> Column:
    return F.concat(F.lit("﻿"), F.array_join(keys, ","))


def html_page(blocks: Column) -> Column:
    """Blocks (functions.markdown.blocks) as escaped HTML."""

    def escaped(c: Column) -> Column:
        for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
            c = F.replace(c, F.lit(a), F.lit(b))
        return c

    def drawn(b: Column) -> Column:
        rows = F.filter(F.split(b["content"], "\n"), lambda r: ~r.rlike(r"^[\s\-:|]+$"))
        row = lambda r: F.concat(F.lit("<tr><td>"), F.replace(escaped(F.regexp_replace(F.regexp_replace(r, r"^\|\s*", ""), r"\s*\|$", "")), F.lit(" | "), F.lit("</td><td>")), F.lit("</td></tr>"))
        return F.when(b["kind"] == "table", F.concat(F.lit("<table>"), F.array_join(F.transform(rows, row), ""), F.lit("</table>"))).otherwise(F.concat(F.lit("<p>"), escaped(b["content"]), F.lit("</p>")))

    return F.concat(F.lit("<html><body>"), F.array_join(F.transform(blocks, drawn), ""), F.lit("</body></html>"))


def folder_digest(files: DataFrame) -> DataFrame:
    """(folder, digest): SHA-256 over the names and contents of (path, content), in path order; each folder's files by itself.

    For folders of one model: names and contents of a folder are one row's work.
    """
    folder = F.regexp_replace("path", "/[^/]*$", "")
    part = F.concat(F.encode(F.element_at(F.split("path", "/"), -1), "UTF-8"), F.col("content"))
    ordered = F.array_sort(F.collect_list(F.struct("path", part.alias("part"))))
    return files.groupBy(folder.alias("folder")).agg(ordered["part"].alias("parts")).select("folder", F.sha2(F.aggregate("parts", F.lit(b""), lambda a, x: F.concat(a, x)), 256).alias("digest"))


def sheets(pages: DataFrame) -> DataFrame:
    """(document_id, page_number, row_no, cells) of pages (document_id, page_number, markdown): tables as grids with a blank row behind, other blocks in
    the first cell; no formulas. One sheet per page."""
    rule = lambda line: line.rlike(r"^[\s\-:|]+$")
    grid = lambda b: F.concat(F.transform(F.filter(F.split(b["content"], "\n"), lambda r: ~rule(r)), lambda r: F.transform(unescaped_cells(r), lambda c: guarded_cell(without_breaks(c, "\n")))), F.array(F.array().cast("array<string>")))
    rows = F.flatten(F.transform(blocks(F.col("markdown")), lambda b: F.when(b["kind"] == "table", grid(b)).when(b["kind"] == "text", F.array(F.array(guarded_cell(without_breaks(b["content"], "\n")))))))
    return pages.filter("markdown is not null").select("document_id", "page_number", F.posexplode(rows).alias("row_no", "cells"))


def append_audit(events: DataFrame, path: str) -> None:
    """Audit rows (company_id, actor, action, target_id, detail) appended with the day as partition; detail defaults to {}."""
    rows = events.withColumn("target_id", F.col("target_id").cast("string")).withColumn("detail", F.coalesce("detail", F.lit("{}"))).withColumn("day", F.current_date())
    rows.write.mode("append").partitionBy("day").parquet(path)


def event_message(company: Column, topic: Column, data: Column, moment: Column) -> Column:
    """The JSON text of an event."""
    return F.to_json(F.struct(company.alias("company_id"), topic.alias("topic"), data.alias("data"), moment.alias("ts")))
