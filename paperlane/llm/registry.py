"""Queries of the operators on training text (problems 1-4 and 6-10)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperlane.llm import batches, canonical, leaks, mojibake, pii, plainform, scannoise, tokenize, truncation
from paperlane.plans.layout_queries import regions
from paperlane.sources import checkpoints, table


def _read_pages(spark: SparkSession, folder: str) -> DataFrame:
    """(row_id, page, doc, page_number, pages, text) of every result."""
    results = table(spark, folder, "ocr_results").select(F.col("id").alias("row_id"), F.col("page_id").alias("page"), F.col("markdown").alias("text"))
    pages = table(spark, folder, "ocr_pages").select(F.col("id").alias("page"), F.col("document_id").alias("doc"), "page_number")
    documents = table(spark, folder, "scan_documents").select(F.col("id").alias("doc"), F.col("page_count").alias("pages"))
    return results.join(pages.join(documents, "doc", "left"), "page", "left")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Kinds of scan noise in ocr_results.markdown."""
    return scannoise.noise(_read_pages(spark, folder)).select(F.col("row_id").alias("result_id"), "noise")


def p1_repaired(spark: SparkSession, folder: str) -> DataFrame:
    """Every page's text as continuous paragraphs."""
    return scannoise.repair(_read_pages(spark, folder), "repaired").select(F.col("row_id").alias("result_id"), "repaired")


def p1_repaired_regions(spark: SparkSession, folder: str) -> DataFrame:
    """The text of every region of layout_json, repaired by what its page shows; a region that was furniture is empty."""
    parts = regions(spark, folder).select(F.col("ocr_result_id").alias("row_id"), "ord", F.col("markdown").alias("text"))
    return scannoise.repair(_read_pages(spark, folder), "repaired", parts).select(F.col("row_id").alias("result_id"), "ord", "repaired")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Reference entry of every typed city, brand and job title; -1 where the list has none."""
    wanted = F.col("field_key").isin("city", "brand", "job_title")
    matches = table(spark, folder, "master_matches").filter(wanted)
    typed = [matches.select(F.lit(c).alias("source"), F.col("id").alias("row_id"), F.lit(0).alias("ordinal"), "field_key", F.col(c).alias("text")) for c in ("matched_text", "master_value")]
    aliases = table(spark, folder, "master_records").select("id", F.posexplode("aliases").alias("ordinal", "alias"))
    typed.append(aliases.select(F.lit("alias").alias("source"), F.col("id").alias("row_id"), "ordinal", F.col("alias.field_key").alias("field_key"), F.col("alias.text").alias("text")).filter(wanted))
    values = typed[0].unionByName(typed[1]).unionByName(typed[2]).dropDuplicates(["source", "row_id", "ordinal"])  # some matches are delivered twice
    found = canonical.map_values(values, "field_key", "text", table(spark, folder, "reference_entries"), ["source", "row_id", "ordinal"])
    return found.select("source", "row_id", "ordinal", "entry_id")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of ocr_results.markdown on which personal information begins."""
    found = pii.found_lines(table(spark, folder, "ocr_results"), "id", "markdown")
    return found.select(F.col("row_id").alias("result_id"), "pii_type", "line_no")


def p3_redacted(spark: SparkSession, folder: str) -> DataFrame:
    """ocr_results.markdown with a placeholder for each item of personal information."""
    results = table(spark, folder, "ocr_results").select("id", "markdown")
    return pii.redact(results, "id", "markdown", "redacted").select(F.col("id").alias("result_id"), "redacted")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of scanned documents of one company that are the same paper."""
    documents = table(spark, folder, "scan_documents").select(F.col("company_id").alias("scope"), "id", F.col("batch_id").alias("batch"), F.col("created_at").alias("at"), "content_sha256")
    journal = table(spark, folder, "upload_journal").select(F.col("document_id").alias("id"), batches.file_hash(F.col("sha256")).alias("hash"))
    hashes = documents.select("id", batches.file_hash(F.col("content_sha256")).alias("hash")).unionByName(journal).filter("id is not null and hash is not null").groupBy("id").agg(F.collect_set("hash").alias("hashes"))
    pages = table(spark, folder, "ocr_pages").select(F.col("id").alias("page_id"), F.col("document_id").alias("id"), "page_number")
    figures = batches.figures(F.col("markdown"))
    # letters are needed only of pages whose figures are few
    few = F.length(F.regexp_replace(figures, "[^0-9]", "")) < batches.FEW
    results = table(spark, folder, "ocr_results").filter("is_current and markdown is not null").select("page_id", figures.alias("figures"), F.when(few, batches.letters(F.col("markdown"))).otherwise("").alias("text"))
    read = pages.join(results, "page_id").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("page_number", "page_id", "figures", "text"))).alias("pages"))
    read = read.select("id", F.array_join("pages.figures", " ").alias("figures"), F.array_join("pages.text", "").alias("text"))
    known = documents.drop("content_sha256").dropDuplicates(["id"]).join(hashes, "id", "left").join(read, "id", "left")
    return batches.pairs_of(batches.papers(known, checkpoints.place(spark, "batches"))).distinct()


def _shown_values(spark: SparkSession, folder: str) -> DataFrame:
    """(field, row_id, text) of the values whose form problem 6 is about."""
    matches = table(spark, folder, "master_matches")
    values = [matches.select(F.lit(field).alias("field"), F.col("id").alias("row_id"), F.col(field).alias("text")) for field in ("matched_text", "master_value")]
    values.append(table(spark, folder, "ocr_results").select(F.lit("markdown").alias("field"), F.col("id").alias("row_id"), F.col("markdown").alias("text")))
    return values[0].unionByName(values[1]).unionByName(values[2])


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Values of master_matches and texts of ocr_results that are not in plain form."""
    found = plainform.not_plain(_shown_values(spark, folder), "text", ["field", "row_id"])
    return found.distinct()  # some matches are delivered twice


def p6_plain(spark: SparkSession, folder: str) -> DataFrame:
    """The same values in plain form."""
    return _shown_values(spark, folder).select("field", "row_id", plainform.in_form(F.col("text")).alias("text")).distinct()


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Values of master_records.data decoded with a wrong encoding."""
    values = table(spark, folder, "master_records").select(F.col("id").alias("record_id"), F.explode("data").alias("field_key", "value"))
    return mojibake.garbled_values(values, ["record_id", "field_key"]).select("record_id", "field_key").distinct()


def p7_restored(spark: SparkSession, folder: str) -> DataFrame:
    """The garbled values with their text where it can be restored."""
    values = table(spark, folder, "master_records").select(F.col("id").alias("record_id"), F.explode("data").alias("field_key", "value"))
    return mojibake.garbled_values(values, ["record_id", "field_key"])


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every document."""
    documents = table(spark, folder, "documents").select("doc_id", "text")
    return tokenize.encode(documents, "text", "ids").select("doc_id", "ids")


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with passages of evaluation items."""
    return leaks.leaked(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents whose text was cut."""
    return truncation.cut_texts(table(spark, folder, "documents")).select("doc_id")


def p10_rates(spark: SparkSession, folder: str) -> DataFrame:
    """How often each source cuts."""
    return truncation.cut_rates(table(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p1_repaired, p1_repaired_regions, p2_found, p3_found, p3_redacted, p4_found, p6_found, p6_plain, p7_found, p7_restored, p8_ids, p9_found, p10_found, p10_rates)}
SQL: dict[str, str] = {}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
