"""Queries over page layouts: reading order, tables, fields, differences, segments, engines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperlane.functions import geometry as G
from paperlane.functions import markdown as M
from paperlane.functions import text as X
from paperlane.operators import diffs, engines, extraction, layout
from paperlane.plans.text_queries import SQL_EOL, sql_strip
from paperlane.sources import sinks, table

_REGION = "struct<bbox:array<double>,kind:string,markdown:string,confidence:double,vertical:boolean,lines:array<struct<text:string,score:double,box:array<array<double>>>>>"
_TABLE = "'| 品目 | 数量 | 単価 | 金額 |' || chr(10) || '| --- | --- | --- | --- |' || chr(10) || '| サンプル品目A | 2 | ¥1,000 | ¥2,000 |' || chr(10) || '| サンプル品目B | 1 | ¥5,000 | ¥5,000 |'"


def _escaped(x: str) -> str:
    return f"replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


def _guarded(x: str) -> str:
    return f"CASE WHEN regexp_matches({x}, '^[=+\\-@\\t\\r]') THEN chr(39) || {x} ELSE {x} END"


_LABEL = " ".join(f"WHEN '{kind}' THEN '{label}'" for kind, label in X.CATEGORY_LABELS.items())
_CELL = sql_strip("regexp_replace(" + sql_strip("x") + r", '(?i)<br\s*/?>', ' ', 'g')")
_LINE, _ANY_LINE = sql_strip("unnest(string_split(markdown, chr(10)))"), sql_strip(f"unnest(regexp_split_to_array(t, '{SQL_EOL}'))")
_ROW = _escaped("regexp_replace(regexp_replace(line, '^[|][ \\t]*', ''), '[ \\t]*[|]$', '')")
SQL = {
    "html_pages": rf"""WITH p AS (SELECT page_id, markdown FROM ocr_results WHERE is_current AND markdown IS NOT NULL), l AS (SELECT page_id, {_LINE} AS line, generate_subscripts(string_split(markdown, chr(10)), 1) AS i FROM p),
k AS (SELECT *, CASE WHEN line LIKE '|%' THEN 'table' WHEN regexp_matches(line, '^!\[[^\]]*\]\([^)]*\)') THEN 'image' ELSE 'text' END AS kind FROM l WHERE line <> ''),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY page_id ORDER BY i) AS b FROM (SELECT *, CASE WHEN kind = 'table' AND lag(kind) OVER (PARTITION BY page_id ORDER BY i) = 'table' THEN 0 ELSE 1 END AS fresh FROM k)),
h AS (SELECT page_id, b, CASE WHEN any_value(kind) = 'table' THEN '<table>' || coalesce(string_agg('<tr><td>' || replace({_ROW}, ' | ', '</td><td>') || '</td></tr>', '' ORDER BY i) FILTER (NOT regexp_full_match(line, '[\s\-:|]+')), '') || '</table>'
ELSE '<p>' || {_escaped("any_value(line)")} || '</p>' END AS html FROM g GROUP BY 1, 2), w AS (SELECT page_id, string_agg(html, '' ORDER BY b) AS html FROM h GROUP BY 1)
SELECT p.page_id, '<html><body>' || coalesce(w.html, '') || '</body></html>' AS html FROM p LEFT JOIN w USING (page_id)""",
    "bulk_export": rf"""WITH m AS (SELECT p.document_id, string_agg(coalesce(r.markdown, '<!-- page ' || p.page_number || ': no text -->'), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY p.page_number, p.id) AS t FROM ocr_pages p LEFT JOIN ocr_results r ON r.page_id = p.id AND r.is_current GROUP BY 1),
l AS (SELECT document_id, {_ANY_LINE} AS line, generate_subscripts(regexp_split_to_array(t, '{SQL_EOL}'), 1) AS i FROM m),
f AS (SELECT document_id, string_agg(CASE WHEN line LIKE '|%' THEN array_to_string([y FOR y IN [{_CELL} FOR x IN string_split(regexp_replace(regexp_replace(line, '^[|]', ''), '[|]$', ''), '|')] IF y <> ''], '  ') ELSE regexp_replace(line, '(?i)<br\s*/?>', chr(10), 'g') END, chr(10) ORDER BY i) AS t FROM l
WHERE line <> '' AND NOT starts_with(line, '![') AND NOT (line LIKE '|%' AND regexp_full_match(line, '[\s\-:|]+')) GROUP BY 1),
d AS (SELECT d.original_filename AS n, coalesce(d.doc_type, 'other') AS k, strftime(d.created_at, '%Y/%m/%d') AS day, {sql_strip("coalesce(f.t, '')")} AS t FROM scan_documents d JOIN m ON m.document_id = d.id LEFT JOIN f ON f.document_id = d.id), c AS (SELECT *, CASE k {_LABEL} ELSE k END AS c FROM d)
SELECT {_guarded("n")} AS name, {_guarded("c")} AS category, day, {_guarded("t")} AS text FROM c""",
    "mock_regions": f"""SELECT p.id || '.png' AS name, r.* REPLACE (replace(r.markdown, '@', p.id) AS markdown) FROM ocr_pages p, (VALUES (50.0, 40.0, 550.0, 80.0, 'title', '# 請求書', 0.99, false),
(50.0, 100.0, 550.0, 140.0, 'text', '株式会社サンプル 御中 (mock page: @)', 0.97, false), (50.0, 160.0, 550.0, 320.0, 'table', {_TABLE}, 0.93, false), (300.0, 340.0, 550.0, 380.0, 'text', '合計: ¥7,000 (税込)', 0.95, false)) r(x0, y0, x1, y1, kind, markdown, confidence, vertical)"""
}


def page_regions(spark: SparkSession, folder: str) -> DataFrame:
    """(ocr_result_id, page_id, regions) of current results: an array of (ord, kind, text, x0, y0, x1, y1, confidence, vertical, lines).

    Regions without a whole bbox have NULL for their place.
    """
    rows = table(spark, folder, "ocr_results").filter("is_current and layout_json is not null").select("id", "page_id", "layout_json")
    text = F.when(F.col("layout_json").startswith('"'), F.from_json(F.concat(F.lit('{"v":'), F.col("layout_json"), F.lit("}")), "v string")["v"]).otherwise(F.col("layout_json"))
    layout_of = F.from_json(text, f"regions array<{_REGION}>, layout struct<regions:array<{_REGION}>>, pages array<struct<regions:array<{_REGION}>>>")
    every = F.coalesce("l.regions", "l.layout.regions", F.flatten("l.pages.regions"))

    def flat(r: Column, ord: Column) -> Column:
        box = F.when((F.size(r["bbox"]) >= 4) & ~F.exists(F.slice(r["bbox"], 1, 4), lambda v: v.isNull()), r["bbox"])
        named = [box[i].alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))]
        return F.struct(ord.alias("ord"), r["kind"].alias("kind"), F.coalesce(r["markdown"], F.lit("")).alias("text"), *named, r["confidence"].alias("confidence"), F.coalesce(r["vertical"], F.lit(False)).alias("vertical"), r["lines"].alias("lines"))

    parsed = rows.select(F.col("id").alias("ocr_result_id"), "page_id", layout_of.alias("l"))
    return parsed.select("ocr_result_id", "page_id", F.filter(F.transform(every, lambda r, i: F.when(r.isNotNull(), flat(r, i))), lambda r: r.isNotNull()).alias("regions")).filter("regions is not null")


def regions(spark: SparkSession, folder: str) -> DataFrame:
    """(ocr_result_id, page_id, ord, kind, markdown, x0, y0, x1, y1, confidence, vertical, lines) of current results, a row per region."""
    return page_regions(spark, folder).select("ocr_result_id", "page_id", F.explode("regions").alias("r")).select("ocr_result_id", "page_id", "r.*").withColumnRenamed("text", "markdown")


def reading_order(spark: SparkSession, folder: str) -> DataFrame:
    """Each page's regions in reading order."""
    rows = page_regions(spark, folder)
    return layout.ordered_regions(rows.withColumn("regions", F.transform("regions", lambda r: r.dropFields("lines", "kind", "confidence"))), "ocr_result_id")


def table_reconstruction(spark: SparkSession, folder: str) -> DataFrame:
    """Regions rebuilt from the positioned text lines of pages that have them."""

    def placed(line: Column) -> Column:
        b = G.box_of_points(line["box"])
        return F.struct(line["text"].alias("text"), line["score"].alias("confidence"), *[b[n].alias(n) for n in ("x0", "y0", "x1", "y1")])

    lines = F.flatten(F.transform("regions", lambda r: F.coalesce(r["lines"], F.array())))
    rows = page_regions(spark, folder).select("ocr_result_id", F.transform(F.filter(lines, lambda x: x["box"].isNotNull()), placed).alias("lines"))
    return layout.reconstructed(rows, "ocr_result_id")


def document_regions(spark: SparkSession, folder: str) -> DataFrame:
    """(document_id, regions): all regions of each document with their page's number."""
    pages = table(spark, folder, "ocr_pages").select(F.col("id").alias("page_id"), "document_id", "page_number")
    slim = F.transform("regions", lambda r: F.struct(r["ord"].alias("ord"), r["kind"].alias("kind"), r["text"].alias("markdown"), *[r[c].alias(c) for c in ("x0", "y0", "x1", "y1", "confidence")]))
    rows = page_regions(spark, folder).select("page_id", slim.alias("regions")).join(pages, "page_id")
    numbered = F.transform("regions", lambda r: r.withField("page_number", F.col("page_number")))
    return rows.groupBy("document_id").agg(F.flatten(F.collect_list(numbered)).alias("regions"))  # one document's pages


def extracted_fields(spark: SparkSession, folder: str) -> DataFrame:
    """The default fields of every document with a layout; a region without a place is at the origin, without extent."""
    return extraction.extract(document_regions(spark, folder), "document_id")


def result_changes(spark: SparkSession, folder: str) -> DataFrame:
    """Cells and lines that differ between a superseded result and the current one of its page."""
    rows = table(spark, folder, "ocr_results").select("id", "page_id", "markdown", "is_current")
    now = rows.filter("is_current").select("page_id", F.col("markdown").alias("new"))
    return diffs.changed(rows.filter("not is_current").join(now, "page_id"), "id", "markdown", "new")


def highlight_segments(spark: SparkSession, folder: str) -> DataFrame:
    """The lines of pages cut at their matched texts."""
    matches = table(spark, folder, "master_matches").filter("status <> 'dismissed' and length(matched_text) > 1").groupBy("page_id").agg(F.collect_set("matched_text").alias("matches"))  # a page's matches: few
    pages = table(spark, folder, "ocr_results").filter("is_current").select("page_id", "markdown")
    return diffs.segmented(pages.join(matches, "page_id"), "page_id", "markdown", "matches")


def mock_regions(spark: SparkSession, folder: str) -> DataFrame:
    """The fixed engine over every page."""
    pages = table(spark, folder, "ocr_pages").select(F.concat(F.col("id"), F.lit(".png")).alias("name"), F.lit(b"").alias("content"))
    return engines.recognised(pages).select("name", F.explode("regions").alias("r")).select("name", "r.*")


def bulk_export(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of a bulk spreadsheet."""
    from paperlane.plans.document_queries import assembled_documents

    documents = table(spark, folder, "scan_documents").select(F.col("id").alias("document_id"), "original_filename", "doc_type", "created_at")
    return sinks.spreadsheet_rows(documents.join(assembled_documents(spark, folder), "document_id"))


def html_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Each current page as escaped HTML."""
    rows = table(spark, folder, "ocr_results").filter("is_current and markdown is not null")
    return rows.select("page_id", sinks.html_page(M.blocks(F.col("markdown"))).alias("html"))


QUERIES = {f.__name__: f for f in (reading_order, table_reconstruction, extracted_fields, result_changes, highlight_segments, mock_regions, bulk_export, html_pages)}
