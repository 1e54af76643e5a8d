"""Queries over small literal cases whose results are known one by one; their SQL is the list of these results."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperlane.functions import geometry as G
from paperlane.functions import markdown as M
from paperlane.functions import text as X
from paperlane.operators import diffs, extraction, imports, layout, lifecycle, matching, nested, quality
from paperlane.sources import sinks

SQL: dict[str, str] = {}
QUERIES: dict = {}


def _literal(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, float):
        return f"{value!r}::DOUBLE"
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else repr(value)


def known(columns: str, *rows: tuple):
    """Registers a query with the rows that it must give."""

    def add(f):
        QUERIES[f.__name__] = f
        listed = ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows)
        SQL[f.__name__] = f"SELECT * FROM (VALUES {listed}) t({columns})"
        return f

    return add


@known("n, score, kind", (1, 1.0, "exact"), (2, 1.0, "exact"), (3, 0.9, "fuzzy"), (4, None, None), (5, None, None), (6, 1.0, "exact"), (7, None, None), (8, None, None))
def score_cases(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of values against units: equal, contained, other width, one misread character of ten, unrelated, a paragraph, too many edits, nothing."""
    name = "株式会社サンプル商事"
    rows = [(1, name, f"{name} 御中"), (2, "C-001", "Ｃ－００１"), (3, name, "株式会社サンプル商亊"), (4, name, "有限会社テスト工業"), (5, "東京都", "大阪府大阪市北区の長い段落で、まったく関係のない文章が続きます。"), (6, "ｻﾝﾌﾟﾙ", "サンプル"), (7, name, "株式会社サソプノレ商亊"), (8, name, "")]
    scored = spark.createDataFrame(rows, "n int, value string, unit string").select("n", matching.score(X.normal_form(F.col("value")), X.normal_form(F.col("unit"))).alias("score"))
    return scored.select("n", F.round("score", 4).alias("score"), F.when(F.col("score") == 1, "exact").when(F.col("score").isNotNull(), "fuzzy").alias("kind"))


def _masters(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    types = spark.createDataFrame([("t", [("name", "名称", True, True), ("address", "住所", True, False), ("code", "コード", False, False)])], "id string, fields array<struct<key:string,label:string,matchable:boolean,required:boolean>>")
    rows = [
        ("c", "m", "t", {"name": "株式会社サンプル商事", "address": "東京都港区1-2-3", "code": "C-001"}, [("name", "サソプル商亊")]),
        ("c", "n", "t", {"name": "株式会社サンプル商会", "address": " ", "code": "C-002"}, None), ("d", "o", "t", {"name": "株式会社サンプル商事"}, None),
    ]
    return spark.createDataFrame(rows, "company_id string, id string, master_type_id string, data map<string,string>, aliases array<struct<field_key:string,text:string>>"), types


@known("page_id, master_record_id, field_key, matched_text, score, kind, is_alias",
       ("p1", "m", "name", "株式会社サンプル商事", 1.0, "exact", False), ("p1", "m", "address", "東京都港区1-2-3", 1.0, "exact", False), ("p1", "n", "name", "株式会社サンプル商事", 0.9, "fuzzy", False),
       ("p2", "m", "name", "株式会社サンプル商亊", 0.9, "fuzzy", False), ("p2", "n", "name", "株式会社サンプル商亊", 0.9, "fuzzy", False),
       ("p3", "m", "name", "サソプル商亊", 1.0, "exact", True), ("p4", "o", "name", "株式会社サンプル商事", 1.0, "exact", False))
def match_cases(spark: SparkSession, folder: str) -> DataFrame:
    """Best matches of pages: exact in a line and in a table cell, fuzzy, by a learned spelling, within the company only."""
    pages = [("c", "p1", "# 請求書\n株式会社サンプル商事 御中\n| 住所 | 備考 |\n| --- | --- |\n| 東京都港区1-2-3 | なし |"), ("c", "p2", "株式会社サンプル商亊"), ("c", "p3", "サソプル商亊\nC-001"), ("d", "p4", "株式会社サンプル商事"), ("c", "p5", "")]
    frame = spark.createDataFrame([(c, p, f"r{p}", t) for c, p, t in pages], "company_id string, page_id string, ocr_result_id string, markdown string")
    return matching.best_matches(frame, *_masters(spark)).select("page_id", "master_record_id", "field_key", "matched_text", "score", "kind", "is_alias")


def _decided(spark: SparkSession) -> DataFrame:
    rows = [("1", "c", "p2", "rp2", "m", "t", "name", "株式会社サンプル商亊", "株式会社サンプル商事", 0.9, "fuzzy", "dismissed"), ("2", "c", "p2", "rp2", "n", "t", "name", "古い", "株式会社サンプル商会", 0.9, "fuzzy", "suggested")]
    return spark.createDataFrame(rows, "id string, company_id string, page_id string, ocr_result_id string, master_record_id string, master_type_id string, field_key string, matched_text string, master_value string, score double, kind string, status string")


@known("page_id, master_record_id, matched_text, status", ("p2", "m", "株式会社サンプル商亊", "dismissed"), ("p2", "n", "株式会社サンプル商亊", "suggested"), ("p3", "m", "サソプル商亊", "linked"))
def rematch_cases(spark: SparkSession, folder: str) -> DataFrame:
    """The match table after matching again: a dismissal stays, an old suggestion goes, a learned spelling is linked."""
    pages = spark.createDataFrame([("c", "p2", "rp2", "株式会社サンプル商亊"), ("c", "p3", "rp3", "サソプル商亊")], "company_id string, page_id string, ocr_result_id string, markdown string")
    best = matching.best_matches(pages, *_masters(spark))
    return matching.after_rematch(_decided(spark), best).select("page_id", "master_record_id", "matched_text", "status")


def _linked(spark: SparkSession) -> matching.Linked:
    matches = _decided(spark).withColumn("status", F.lit("suggested")).withColumn("linked_by", F.lit(None).cast("string")).withColumn("linked_at", F.lit(None).cast("timestamp"))
    results = spark.createDataFrame([("rp2", "株式会社サンプル商亊 御中\n株式会社サンプル商亊")], "id string, markdown string")
    chosen = spark.createDataFrame([("1", "u"), ("2", "u"), ("7", "u")], "id string, linked_by string").withColumn("linked_at", F.lit("2024-01-01").cast("timestamp"))
    return matching.linked(matches, results, _masters(spark)[0], chosen)


@known("kind, id, detail", ("match", "1", "linked"), ("match", "2", "suggested"), ("refused", "2", "matched text no longer there"), ("refused", "7", "no such match"),
       ("result", "rp2", "株式会社サンプル商事 御中\n株式会社サンプル商事"), ("correction", "1", "approved"), ("alias", "m", "サソプル商亊"), ("alias", "m", "株式会社サンプル商亊"))
def link_cases(spark: SparkSession, folder: str) -> DataFrame:
    """Confirmed matches: text replaced everywhere, correction recorded, spelling learned, stale and unknown ones refused."""
    done = _linked(spark)
    parts = [
        done.matches.select(F.lit("match").alias("kind"), "id", F.col("status").alias("detail")), done.refused.select(F.lit("refused").alias("kind"), "id", F.col("reason").alias("detail")),
        done.results.select(F.lit("result").alias("kind"), "id", F.col("markdown").alias("detail")), done.corrections.select(F.lit("correction").alias("kind"), F.col("match_id").alias("id"), F.col("status").alias("detail")),
        done.records.select(F.lit("alias").alias("kind"), "id", F.explode("aliases.text").alias("detail")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).unionByName(parts[4])


@known("document_id, key, match_id, score", ("d", "to", "m1", 0.9), ("d", "from", "m2", 0.8))
def field_match_cases(spark: SparkSession, folder: str) -> DataFrame:
    """Extracted fields with the best match of their page; amounts, blank values and other pages have none."""
    fields = [{"key": "to", "value": "株式会社甲 御中", "page_number": 1, "type": "text"}, {"key": "from", "value": "乙商店", "page_number": 1}, {"key": "total", "value": "株式会社甲", "page_number": 1, "type": "amount"}, {"key": "blank", "value": " ", "page_number": 1}, {"key": "far", "value": "株式会社甲", "page_number": 2}]
    documents = spark.createDataFrame([("d", json.dumps({"fields": fields})), ("e", None), ("f", "{broken")], "document_id string, extracted_json string")
    pages = spark.createDataFrame([("p", "d", 1), ("q", "d", 2)], "id string, document_id string, page_number int")
    matches = spark.createDataFrame([("m1", "p", "株式会社申", "株式会社甲", 0.9, "suggested"), ("m2", "p", "乙", "乙商店", 0.8, "linked"), ("m3", "p", "株式会社甲", "株式会社甲", 1.0, "dismissed")], "id string, page_id string, matched_text string, master_value string, score double, status string")
    return matching.document_field_matches(documents, pages, matches)


@known("type_id, keys, error", (1, "name_", None), (2, None, "at least one field must be matchable"), (3, None, "duplicate field key: a"), (4, "", None), (5, None, "every field needs a key and a label"))
def field_definition_cases(spark: SparkSession, folder: str) -> DataFrame:
    types = spark.createDataFrame([(1, [("Name!", "N", True, None)]), (2, [("a", "A", False, False)]), (3, [("a", "A", True, False), ("A", "B", True, False)]), (4, []), (5, [("a", " ", True, True)])], "type_id int, fields array<struct<key:string,label:string,matchable:boolean,required:boolean>>")
    return imports.checked_fields(types).select("type_id", F.when(F.col("error").isNull(), F.array_join("fields.key", ",")).alias("keys"), "error")


@known("template_id, keys, error", (1, "doc_no,total", None), (2, None, "duplicate field key"), (3, None, "unknown field type"), (4, None, "every field needs a key"))
def template_cases(spark: SparkSession, folder: str) -> DataFrame:
    rows = [(1, [("Doc No", "番号", None), ("total", "合計", "amount")]), (2, [("a", "A", "text"), ("A", "B", "text")]), (3, [("a", "A", "money")]), (4, [(" ", "A", "text")])]
    templates = spark.createDataFrame(rows, "template_id int, fields array<struct<key:string,label:string,type:string>>")
    return extraction.checked_template(templates).select("template_id", F.when(F.col("error").isNull(), F.array_join("fields.key", ",")).alias("keys"), "error")


_FIELDS = [{"key": "name", "label": "名称", "required": True}, {"key": "price", "label": "単価"}]
_FILES = {
    "keys.csv": [["name", "price"], ["A", "1"], ["A", "1"], ["", "5"], ["B", "2"], ["", ""]], "labels.csv": [["単価", "名称"], ["7", "甲"]], "plain.csv": [["D", "4"], ["E"]], "hints.csv": [["番号", "数量"], ["x", "y"]], "figures.csv": [["first", "second"], ["z", "1"], ["w", "2"]],
}


def _rows(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(p, n, cells) for p, rows in _FILES.items() for n, cells in enumerate(rows, 1)], "path string, row_no int, cells array<string>")


@known("path, total_rows, shown, guessed_header", ("keys.csv", 6, 6, True), ("labels.csv", 2, 2, True), ("plain.csv", 2, 2, False), ("hints.csv", 2, 2, True), ("figures.csv", 3, 3, True))
def import_preview_cases(spark: SparkSession, folder: str) -> DataFrame:
    """The first rows of files and whether they begin with a header: by key, by label, by a header's words, by words above figures, or not."""
    return imports.previews(_rows(spark), _FIELDS).select("path", "total_rows", F.size("first_rows").alias("shown"), "guessed_header")


@known("path, line_no, name, price, outcome, reason",
       ("keys.csv", 2, "A", "1", "created", None), ("keys.csv", 3, "A", "1", "skipped", None), ("keys.csv", 4, "", "5", "error", "field '名称' is required"), ("keys.csv", 5, "B", "2", "skipped", None),
       ("keys.csv", 6, "", "", "error", "field '名称' is required"), ("labels.csv", 2, "甲", "7", "created", None), ("plain.csv", 1, "D", "4", "created", None), ("plain.csv", 2, "E", None, "created", None),
       ("hints.csv", 2, None, None, "error", "the header names no field"), ("figures.csv", 2, None, None, "error", "the header names no field"), ("figures.csv", 3, None, None, "error", "the header names no field"))
def import_cases(spark: SparkSession, folder: str) -> DataFrame:
    existing = spark.createDataFrame([({"name": "B", "price": "2"},)], "data map<string,string>")
    done = imports.imported(_rows(spark), _FIELDS, existing)
    return done.select("path", "line_no", *[F.try_element_at("data", F.lit(k)).alias(k) for k in ("name", "price")], "outcome", "reason")


@known("path, created, skipped, failed, first_error", ("keys.csv", 1, 2, 2, "line 4: field '名称' is required"), ("labels.csv", 1, 0, 0, None), ("plain.csv", 2, 0, 0, None), ("hints.csv", 0, 0, 1, "line 2: the header names no field"), ("figures.csv", 0, 0, 2, "line 2: the header names no field"))
def import_tally_cases(spark: SparkSession, folder: str) -> DataFrame:
    existing = spark.createDataFrame([({"name": "B", "price": "2"},)], "data map<string,string>")
    return imports.tally(imports.imported(_rows(spark), _FIELDS, existing)).select("path", "created", "skipped", "failed", F.get("errors", F.lit(0)).alias("first_error"))


@known("n, keys, labels", (1, "unit_price,col_2,unit_price_4,col_5,col_6", "Unit Price,単価,unit price,Price ($),__"))
def inferred_field_cases(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.createDataFrame([(1, ["Unit Price", "単価", "", "unit price", "Price ($)", "__"])], "n int, header array<string>")
    fields = rows.select("n", imports.inferred_fields(F.col("header")).alias("f"))
    return fields.select("n", F.array_join("f.key", ",").alias("keys"), F.array_join("f.label", ",").alias("labels"))


_BOXES = "x0 double, y0 double, x1 double, y1 double, text string, vertical boolean"


def _boxed(spark: SparkSession, pages: dict[str, list[tuple]], columns: str) -> DataFrame:
    return spark.createDataFrame([(p, boxes) for p, boxes in pages.items()], f"page string, boxes array<struct<{columns.replace(' ', ':').replace(',:', ',')}>>")


@known("page, ord, text", ("rows", 0, "top left"), ("rows", 1, "top right"), ("rows", 2, "bottom"), ("columns", 0, "a"), ("columns", 1, "b"), ("columns", 2, "c"), ("columns", 3, "d"), ("upright", 0, "400"), ("upright", 1, "250"), ("upright", 2, "100"), ("placeless", 0, "first"), ("placeless", 1, "behind"), ("placeless", 2, "second"))
def reading_order_cases(spark: SparkSession, folder: str) -> DataFrame:
    """Strips, columns, upright text from the right, and regions without a place."""
    near = 30.0
    pages = {
        "rows": [(300.0, 0.0, 500.0, 20.0, "top right", False), (0.0, 0.0, 200.0, 20.0, "top left", False), (0.0, 100.0, 500.0, 120.0, "bottom", False), (0.0, 200.0, 1.0, 210.0, " ", False)],
        "columns": [(0.0, 0.0, 100.0, 20.0, "a", False), (0.0, 25.0, 100.0, 45.0, "b", False), (300.0, 0.0, 400.0, 20.0, "c", False), (300.0, 25.0, 400.0, 45.0, "d", False)],
        "upright": [(100.0, 0.0, 100.0 + near, 300.0, "100", True), (400.0, 0.0, 400.0 + near, 300.0, "400", True), (250.0, 0.0, 250.0 + near, 300.0, "250", True)],
        "placeless": [(0.0, 0.0, 10.0, 10.0, "first", False), (None, None, None, None, "behind", False), (0.0, 50.0, 10.0, 60.0, "second", None)],
    }
    return layout.ordered_regions(_boxed(spark, pages, _BOXES), "page", "boxes")


_GRID = "| 品目 | 単価 | 数量 | 価格 |\n| --- | --- | --- | --- |\n| マスター管理 | 45,000 | 38 | 1,710,000 |"
_LINES = {
    "grid": [("納品書", 40, 30, 140, 70), ("品目", 40, 400, 120, 430), ("単価", 200, 400, 270, 430), ("数量", 320, 400, 390, 430), ("価格", 460, 400, 540, 430), ("マスター管理", 40, 450, 180, 480), ("45,000", 200, 450, 270, 480), ("38", 320, 450, 360, 480), ("1,710,000", 460, 450, 560, 480)],
    "bleed": [("品目", 40, 400, 110, 428), ("単価", 280, 400, 340, 428), ("数量", 360, 400, 420, 428), ("単位", 440, 400, 490, 428), ("価格", 520, 400, 590, 428), ("マスター管理", 40, 432, 180, 452), ("45,000", 280, 470, 340, 498), ("38", 360, 470, 400, 498), ("日", 440, 470, 470, 498), ("1,710,000", 520, 470, 610, 498)],
    "wrapped": [("品目", 40, 400, 110, 428), ("単価", 280, 400, 340, 428), ("数量", 360, 400, 420, 428), ("単位", 440, 400, 490, 428), ("価格", 520, 400, 590, 428), ("マスター管理", 40, 450, 180, 478), ("45,000", 280, 450, 340, 478), ("38", 360, 450, 400, 478), ("日", 440, 450, 470, 478), ("1,710,000", 520, 450, 610, 478), ("監視および月次レポート作成", 40, 490, 260, 518), ("クラウド運用", 40, 560, 160, 588), ("80,000", 280, 560, 340, 588), ("12", 360, 560, 400, 588), ("月", 440, 560, 470, 588), ("960,000", 520, 560, 600, 588), ("小計", 400, 640, 460, 668), ("25,020,000", 520, 640, 620, 668), ("合計", 400, 680, 460, 708), ("27,522,000", 520, 680, 620, 708)],
    "total": [("合計金額", 400, 40, 500, 70), ("27,522,000円", 520, 40, 700, 70), ("納品書", 40, 40, 140, 70)],
    "far": [("小計", 40, 40, 100, 70), ("¥1,000", 400, 40, 480, 70)],
    "beside": [("株式会社アルファ", 40, 40, 220, 70), ("株式会社ベータ", 400, 40, 580, 70)],
    "above": [("件名", 40, 40, 100, 70), ("部品一式", 120, 40, 220, 70), ("品目", 40, 200, 120, 230), ("数量", 200, 200, 270, 230), ("金額", 320, 200, 390, 230), ("A", 40, 250, 60, 280), ("2", 200, 250, 220, 280), ("100", 320, 250, 360, 280)],
    "blank": [("  ", 0, 0, 1, 1)],
}


def _line_pages(spark: SparkSession, names: tuple[str, ...] = tuple(_LINES)) -> DataFrame:
    pages = {p: [(float(x0), float(y0), float(x1), float(y1), t, 0.95) for t, x0, y0, x1, y1 in _LINES[p]] for p in names}
    return _boxed(spark, pages, "x0 double, y0 double, x1 double, y1 double, text string, confidence double")


@known("page, kind, text",
       ("grid", "text", "納品書"), ("grid", "table", _GRID), ("bleed", "table", "| 品目 | 単価 | 数量 | 単位 | 価格 |\n| --- | --- | --- | --- | --- |\n| マスター管理 | 45,000 | 38 | 日 | 1,710,000 |"),
       ("wrapped", "table", "| 品目 | 単価 | 数量 | 単位 | 価格 |\n| --- | --- | --- | --- | --- |\n| マスター管理<br>監視および月次レポート作成 | 45,000 | 38 | 日 | 1,710,000 |\n| クラウド運用 | 80,000 | 12 | 月 | 960,000 |\n|  |  |  | 小計 | 25,020,000 |\n|  |  |  | 合計 | 27,522,000 |"),
       ("total", "text", "納品書"), ("total", "table", "| 合計金額 | 27,522,000円 |\n| --- | --- |"), ("far", "text", "小計"), ("far", "text", "¥1,000"), ("beside", "text", "株式会社アルファ"), ("beside", "text", "株式会社ベータ"),
       ("above", "table", "| 件名 | 部品一式 |\n| --- | --- |"), ("above", "table", "| 品目 | 数量 | 金額 |\n| --- | --- | --- |\n| A | 2 | 100 |"))
def table_cases(spark: SparkSession, folder: str) -> DataFrame:
    """Tables from lines: a grid, a header that took in an item, wrapped descriptions and totals, a labelled amount beside a title, a label and an
    amount far apart, addresses side by side, a pair above a grid, blank lines."""
    return layout.reconstructed(_line_pages(spark), "page", "boxes").select("page", "kind", "text")


@known("engine, ord, row_text", ("first", 0, "品目|単価|数量|価格"), ("first", 1, "マスター管理|45,000|38|1,710,000"), ("second", 0, "品目|単価|数量|価格"), ("second", 1, "マスター管理|45,000|38|1,710,000"))
def older_row_cases(spark: SparkSession, folder: str) -> DataFrame:
    """The rows that two older engines make of a grid's lines."""
    rows = []
    lines = [layout.Box(float(x0), float(y0), float(x1), float(y1), t) for t, x0, y0, x1, y1 in _LINES["grid"][1:]]
    for engine, reach in (("first", None), ("second", 15.0)):
        grouped = layout.grouped_rows(lines, reach)
        cells = layout.table_rows(lines, grouped, layout.centre_groups(grouped, 520.0)) if reach is None else [[b.text for b in r] for r in grouped]
        rows += [(engine, i, "|".join(r)) for i, r in enumerate(cells)]
    return spark.createDataFrame(rows, "engine string, ord int, row_text string")


@known("doc, key, value, confidence, page_number, missing",
       ("d", "recipient", "株式会社甲", 0.97, "1", False), ("d", "issuer", "株式会社乙", 0.9, "1", False), ("d", "doc_no", "A-1", 0.95, "1", False), ("d", "subject", None, 0.0, None, True), ("d", "total", "12300", 0.72, "1", False), ("d", "date", "2024-03-05", 0.99, "1", False), ("d", "reg_no", "T1", 0.91, "1", False),
       ("e", "recipient", None, 0.0, None, True), ("e", "issuer", None, 0.0, None, True), ("e", "doc_no", None, 0.0, None, True), ("e", "subject", "合計金額 5", 0.774, "2", False), ("e", "total", "9", 0.9, "2", False), ("e", "date", None, 0.0, None, True), ("e", "reg_no", None, 0.0, None, True),
       ("f", "no", "7", 0.9, "1", False))
def extraction_cases(spark: SparkSession, folder: str) -> DataFrame:
    """Fields by their labels: on the label's line (with blanks inside), right of it, below it, within a table cell; a template of its own."""
    at = lambda page, ord, text, box, sure, kind="text": (page, ord, kind, text, *map(float, box), sure)
    documents = {
        "d": ([at(1, 0, "株式会社甲 御中", (0, 0, 100, 20), 0.97), at(1, 1, "株式会社乙", (300, 0, 400, 20), 0.9), at(1, 2, "合計金額", (0, 50, 80, 70), 0.9), at(1, 3, "¥12,300", (100, 50, 160, 70), 0.8), at(1, 4, "発行日: 2024年3月5日", (0, 90, 160, 110), 0.99), at(1, 5, "請 求 書 番 号：A-1", (0, 130, 160, 150), 0.95), at(1, 6, "| 登録番号 T1 | x |", (0, 170, 300, 200), 0.91, "table")], None),
        "e": ([at(2, 0, "件名", (0, 0, 50, 20), 0.9), at(2, 1, "部品", (0, 30, 50, 50), 0.9), at(2, 2, "合計金額 5", (200, 0, 300, 20), 0.86), at(2, 3, "9", (310, 0, 320, 20), 1.0)], None),
        "f": ([at(1, 0, "番号", (0, 0, 50, 20), 1.0), at(1, 1, "7", (60, 0, 80, 20), 1.0)], [("no", "番号", "number", None)]),
    }
    region = "array<struct<page_number:int,ord:int,kind:string,markdown:string,x0:double,y0:double,x1:double,y1:double,confidence:double>>"
    frame = spark.createDataFrame([(d, r, t) for d, (r, t) in documents.items()], f"doc string, regions {region}, template array<struct<key:string,label:string,type:string,description:string>>")
    return extraction.extract(frame, "doc").withColumn("page_number", F.col("page_number").cast("string"))


@known("key, value, confidence, missing", ("a", "typed", 1.0, False), ("b", "", 1.0, True), ("c", "kept", 0.5, False))
def override_cases(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.createDataFrame([([("a", None, 0.0, True), ("b", "x", 0.7, False), ("c", "kept", 0.5, False)], {"a": "typed", "b": ""})], "f array<struct<key:string,value:string,confidence:double,missing:boolean>>, c map<string,string>")
    return rows.select(F.explode(extraction.overridden(F.col("f"), F.col("c"))).alias("f")).select("f.*")


@known("n, f1, cer, passed", (1, 1.0, 0.0, True), (2, 0.0, 1.0, False), (3, 1.0, 0.0, True), (4, 0.5, 0.0769, True), (5, 1.0, 1.0, False))
def golden_cases(spark: SparkSession, folder: str) -> DataFrame:
    """Cells and error rates of samples: equal in other widths, nothing read, no tables, half of the cells, text where none is expected."""
    rows = [(1, "金額123 カタカナ", "金額１２３ ｶﾀｶﾅ"), (2, "| a | b |", ""), (3, "abc", "abc"), (4, "| abcd | ef |", "| abxd | ef |"), (5, "", "junk")]
    done = quality.golden_evaluation(spark.createDataFrame(rows, "n int, expected string, read string"), "n", "expected", "read")
    return done.select("n", F.round("f1", 4).alias("f1"), F.round("cer", 4).alias("cer"), "passed")


@known("text, japanese", ("爱知県の纳品书", "愛知県の納品书"), ("合計金额", "合計金額"), ("変わらない", "変わらない"), ("", ""))
def japanese_form_cases(spark: SparkSession, folder: str) -> DataFrame:
    return spark.createDataFrame([("爱知県の纳品书",), ("合計金额",), ("変わらない",), ("",)], "text string").select("text", X.japanese_forms(F.col("text")).alias("japanese"))


@known("n, slug, path, needle, summary, online", (1, "alpha-trading-co", "C:\\Scans", "品目", "A — B", True), (2, "x" * 63, "", "見出し", "A", False), (3, "", "a b", "a" * 30, "", False))
def small_text_cases(spark: SparkSession, folder: str) -> DataFrame:
    """Slugs of sites, typed paths, what of a region is looked for, summaries of records, devices seen lately."""
    rows = [(1, " Alpha_Trading  Co. ", ' "C:\\Scans" ', "table", "| --- | 品目 | 数 |\n| a | b | c |", ["", "A", None, "B", "C"], 599), (2, "x" * 80, None, "text", " 見出し ", ["A"], 600), (3, "--", "a b ", "text", "a" * 40, [], None)]
    frame = spark.createDataFrame(rows, "n int, name string, typed string, kind string, markdown string, v array<string>, ago int")
    now = F.lit("2024-01-01 12:00:00").cast("timestamp")
    seen = F.when(F.col("ago").isNotNull(), F.timestamp_micros(F.unix_micros(now) - F.col("ago").cast("long") * 1_000_000))
    return frame.select("n", X.site_slug(F.col("name")).alias("slug"), X.folder_path(F.col("typed")).alias("path"), X.first_needle(F.col("kind"), F.col("markdown")).alias("needle"), X.record_summary(F.col("v")).alias("summary"), X.online(seen, now).alias("online"))


_EDITED = "# t\n\n| a\\|b | c |\n| --- | --- |\n| 1<br>2 |  |\n|  |  |\n\n| x |\n\n![i](p.png)\n"


@known("n, kinds, again", (1, "text,table,table,image", "# t\n\n| a\\|b | c |\n| --- | --- |\n| 1<br>2 |  |\n\n| x |\n| --- |\n\n![i](p.png)"), (2, "", ""), (3, "text,text", "a\n\nb"))
def editor_cases(spark: SparkSession, folder: str) -> DataFrame:
    """Markdown as an editor's blocks, and written back."""
    rows = spark.createDataFrame([(1, _EDITED), (2, ""), (3, "a\n  b  ")], "n int, t string").select("n", M.edited_blocks(F.col("t")).alias("b"))
    return rows.select("n", F.array_join("b.kind", ",").alias("kinds"), M.serialized(F.col("b")).alias("again"))


@known("document_id, page_number, row_no, cells", ("d", 1, 0, "'=1+1"), ("d", 1, 1, "品目|金額"), ("d", 1, 2, "A|'-5"), ("d", 1, 3, ""), ("d", 2, 0, "only text"))
def sheet_cases(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of a document's sheets: no formulas, tables as grids with a blank row behind."""
    pages = spark.createDataFrame([("d", 1, "=1+1\n| 品目 | 金額 |\n| --- | --- |\n| A | -5 |"), ("d", 2, "only text"), ("d", 3, None)], "document_id string, page_number int, markdown string")
    return sinks.sheets(pages).select("document_id", "page_number", "row_no", F.array_join("cells", "|").alias("cells"))


def _b(*xs: float) -> Column:
    return G.box(*map(F.lit, xs))


@known("step, key, ord", ("first", "a", "0"), ("first", "b", "1"), ("first", "c", None), ("left", "y", None))
def box_join_cases(spark: SparkSession, folder: str) -> DataFrame:
    """Lines with the first table box that has their centre, and boxes that no table covers by half."""
    page = lambda rows: spark.createDataFrame([("p", *r) for r in rows], "page string, line string, ord int, x0 double, y0 double, x1 double, y1 double").select("page", "line", "ord", G.box(*map(F.col, ("x0", "y0", "x1", "y1"))).alias("b"))
    lines = page([("a", 0, 10.0, 10.0, 20.0, 20.0), ("b", 0, 101.0, 0.0, 111.0, 10.0), ("c", 0, 500.0, 0.0, 510.0, 10.0)])
    tables = page([("t", 0, 0.0, 0.0, 100.0, 100.0), ("t", 1, 0.0, 0.0, 200.0, 100.0)])
    first = G.first_box(lines.drop("ord"), tables.drop("line"), "page").select(F.lit("first").alias("step"), F.col("line").alias("key"), F.col("ord").cast("string").alias("ord"))
    boxes = page([("x", 0, 90.0, 0.0, 110.0, 10.0), ("y", 0, 95.0, 0.0, 115.0, 10.0)])
    left = G.uncovered(boxes, tables.filter("ord = 0"), "page", "line").select(F.lit("left").alias("step"), F.col("line").alias("key"), F.lit(None).cast("string").alias("ord"))
    return first.unionByName(left)


@known("total, documents, on_both_sides, some_held", (9, 9, 0, True))
def training_set_cases(spark: SparkSession, folder: str) -> DataFrame:
    """Ten corrections, nine of them approved: split by document."""
    rows = [(str(i), f"p{i}", f"raw {i}", f"fixed {i}", "approved" if i < 9 else "draft", i) for i in range(10)] + [("10", "p3", "same", "same", "approved", 10)]
    corrections = spark.createDataFrame(rows, "id string, page_id string, original_markdown string, corrected_markdown string, status string, created_at int")
    pages = spark.createDataFrame([(f"p{i}", f"d{i}") for i in range(10)], "id string, document_id string")
    built = quality.training_set(corrections, pages, 0.2)
    sides = built.groupBy("document_id").agg(F.count_distinct("split").alias("n"))
    sizes = quality.set_sizes(built)
    return sizes.crossJoin(sides.agg(F.count("*").alias("documents"), F.count_if(F.col("n") > 1).alias("on_both_sides"))).select("total", "documents", "on_both_sides", (F.col("holdout") >= 1).alias("some_held"))


@known("ord, kind, column_name, row_no, old, new", (0, "text", None, None, "t", "u"), (1, "cell", "金額", "2", "2", "3"))
def change_cases(spark: SparkSession, folder: str) -> DataFrame:
    """A changed line, and a changed cell with its column's header and its row below it."""
    old, new = "t\n| 品目 | 金額 |\n| --- | --- |\n| A | 1 |\n| B | 2 |", "u\n| 品目 | 金額 |\n| --- | --- |\n| A | 1 |\n| B | 3 |"
    rows = spark.createDataFrame([("k", old, new), ("same", old, old), ("none", None, None)], "id string, old_text string, new_text string")
    return diffs.changed(rows, "id", "old_text", "new_text").select("ord", "kind", F.col("column").alias("column_name"), F.col("row_no").cast("string").alias("row_no"), "old", "new")


@known("ord, text, match", (0, "a ", None), (1, "foobar", "foobar"), (2, " ", None), (3, "foo", "foo"), (4, " end", None))
def segment_cases(spark: SparkSession, folder: str) -> DataFrame:
    """A text cut at its matches, the longest first."""
    rows = spark.createDataFrame([("k", "a foobar foo end", ["foo", "foobar", ""]), ("n", None, ["x"])], "id string, t string, m array<string>")
    return diffs.segmented(rows, "id", "t", "m").select("ord", "text", "match")


@known("record_id, parent_path, node_path", ("a", "$", "$.r[0]"), ("a", "$.r[0]", "$.r[0].l[0]"), ("a", "$.r[0]", "$.r[0].l[1]"), ("b", "$", "$[0]"), ("c", "$", "$.x[0]"))
def nested_link_cases(spark: SparkSession, folder: str) -> DataFrame:
    """Objects within arrays with their parents: nested, at the top, in JSON within JSON; broken and empty records have none."""
    rows = [("a", '{"r": [{"l": [{"t": 1}, {"t": 2}, 3]}, 4]}'), ("b", '[{"k": null}]'), ("c", json.dumps('{"x": [{}]}')), ("d", '{"x": [{"a": 1'), ("e", ""), ("f", None), ("g", "{}")]
    return nested.nodes(spark.createDataFrame(rows, "record_id string, json string"), "record_id", "json").filter("is_element").select("record_id", "parent_path", "node_path")


@known("text, normal, key, number_like, amount_like, broken, hidden",
       ("Ａ １２３ ｶﾅ ", "A 123 カナ", "a123カナ", False, True, "Ａ １２３ ｶﾅ ", "Ａ １２３ ｶﾅ "), ("¥1,234円", "¥1,234円", "¥1,234円", False, True, "¥1,234円", "¥1,234円"), ("2024年5月1日", "2024年5月1日", "2024年5月1日", True, True, "2024年5月1日", "2024年5月1日"),
       ("a<br>b<BR />c", "a<br>b<BR />c", "a<br>b<br/>c", False, False, "a\nb\nc", "a<br>b<BR />c"), ("key=s3cret!", "key=s3cret!", "key=s3cret!", False, False, "key=s3cret!", "key=***!"), ("", "", "", False, False, "", ""))
def text_function_cases(spark: SparkSession, folder: str) -> DataFrame:
    """Normal form, label form, what looks like figures or amounts, line breaks, secrets left out."""
    t = F.col("text")
    rows = spark.createDataFrame([("Ａ １２３ ｶﾅ ",), ("¥1,234円",), ("2024年5月1日",), ("a<br>b<BR />c",), ("key=s3cret!",), ("",)], "text string")
    return rows.select("text", X.normal_form(t).alias("normal"), X.key_form(t).alias("key"), X.numberish(t).alias("number_like"), X.looks_amount(t).alias("amount_like"), X.without_breaks(t).alias("broken"), X.without_secret(t, "s3cret").alias("hidden"))


@known("n, prefix, suffix", (1, 2, 1), (2, 3, 0), (3, 0, 0), (4, 2, 0))
def common_affix_cases(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.createDataFrame([(1, "abcd", "abxd"), (2, "abc", "abc"), (3, "", "x"), (4, "aa", "aaa")], "n int, a string, b string")
    return rows.select("n", X.common_affix(F.col("a"), F.col("b")).alias("s")).select("n", "s.*")


@known("n, text", (1, "T\nA  B\n1  2\nend"), (2, ""), (3, "a\nb"))
def plain_text_cases(spark: SparkSession, folder: str) -> DataFrame:
    """Markdown as plain text: cells two spaces apart, no rules, images or blank lines."""
    rows = spark.createDataFrame([(1, "T\n\n| A | B |\n| --- | --- |\n| 1 | 2 |\n![i](x)\nend"), (2, ""), (3, "a<br>b")], "n int, t string")
    return rows.select("n", M.plain_text(F.col("t")).alias("text"))


@known("label, kind, markdown, vertical", ("doc_title", "title", "## 請求書", False), ("table", "table", "| a | b |\n| --- | --- |", False), ("image", "figure", "", False), ("vertical_text", "text", "x & y", True), (None, "text", "plain", False))
def block_cases(spark: SparkSession, folder: str) -> DataFrame:
    """Recognised layout blocks as regions, by their labels."""
    rows = spark.createDataFrame([("doc_title", " 請求書 "), ("table", "<table><tr><td>a</td><td>b</td></tr></table>"), ("image", "noise"), ("vertical_text", "x &amp; y"), (None, "plain")], "label string, content string")
    return rows.select("label", M.block_region(F.col("label"), F.col("content")).alias("r")).select("label", "r.kind", "r.markdown", "r.vertical")


@known("n, x0, y0, x1, y1, mean", (1, 0.0, 0.0, 30.0, 20.0, 0.7), (2, 0.0, 0.0, 0.0, 0.0, None))
def box_cases(spark: SparkSession, folder: str) -> DataFrame:
    """Boxes around points, and mean confidences."""
    rows = spark.createDataFrame([(1, [[0.0, 0.0], [30.0, 5.0], [10.0, 20.0]], [0.6, 0.8]), (2, [], [])], "n int, p array<array<double>>, c array<double>")
    return rows.select("n", G.box_of_points(F.col("p")).alias("b"), F.round(quality.confidence(F.col("c")), 4).alias("mean")).select("n", "b.*", "mean")


@known("ord, x0, x1", (0, 0.0, 10.0), (1, 40.0, 60.0), (2, 100.0, 120.0))
def merged_box_cases(spark: SparkSession, folder: str) -> DataFrame:
    """Seen boxes, and the computed ones that overlap none kept before them."""
    kept = layout.merged_boxes([(0.0, 0.0, 10.0, 10.0), (100.0, 50.0, 120.0, 60.0)], [(1.0, 0.0, 11.0, 10.0), (40.0, 20.0, 60.0, 30.0), (42.0, 20.0, 61.0, 30.0)])
    return spark.createDataFrame([(i, b[0], b[2]) for i, b in enumerate(kept)], "ord int, x0 double, x1 double")


@known("n, kind, text", (1, "text", "株式会社ソナス\n合計"), (3, "table", "| 小計 | 5 |\n| --- | --- |"))
def payload_cases(spark: SparkSession, folder: str) -> DataFrame:
    """A recogniser's answer: its text where it gave no lines, nothing where they are blank, else tables and lines."""
    answers = [(1, "株式会社ソナス\n合計", []), (2, "keep", [layout.Box(0, 0, 1, 1, "  ")]), (3, "x", [layout.Box(0, 0, 40, 20, "小計"), layout.Box(70, 0, 80, 20, "5")])]
    return spark.createDataFrame([(n, b.kind, b.text) for n, t, lines in answers for b in layout.payload_regions(t, lines)], "n int, kind string, text string")


_STEPS = [(1, "draft", "submitted"), (2, "approved", "submitted"), (3, "submitted", "approved"), (4, "submitted", "used_in_training")]


@known("id, status, reason", (1, "submitted", None), (2, "approved", "not from approved"), (3, "approved", None), (4, "submitted", "not from submitted"), (9, None, "not found"))
def transition_cases(spark: SparkSession, folder: str) -> DataFrame:
    """Changes of state: allowed ones are made, others refused with their reason."""
    rows = spark.createDataFrame([(i, s) for i, s, _ in _STEPS], "id int, status string")
    wanted = spark.createDataFrame([(i, to) for i, _, to in _STEPS] + [(9, "submitted")], "id int, to string")
    after, refused = lifecycle.applied(rows, wanted, "id")
    return after.join(refused.select("id", "reason"), "id", "full").select("id", "status", "reason")


@known("step, id, value", ("current", "a1", "false"), ("current", "a2", "true"), ("current", "b1", "true"), ("active", "1", "retired"), ("active", "2", "active"), ("active", "3", "active"), ("seeded", "x", "old"), ("seeded", "y", "new"), ("unlinked", "10", None), ("unlinked", "11", "2"), ("dismissed", "1", "dismissed"), ("dismissed", "2", "suggested"))
def snapshot_cases(spark: SparkSession, folder: str) -> DataFrame:
    """New rows from old ones and changes: the newest result current, one active version, seeds where absent, links to deleted rows cleared, dismissals."""
    results = spark.createDataFrame([("a1", "a", 1, True), ("a2", "a", 2, False), ("b1", "b", 1, False)], "id string, page string, at int, is_current boolean")
    versions = spark.createDataFrame([("1", None, "k", "active"), ("2", None, "k", "candidate"), ("3", "c", "k", "active")], "id string, company_id string, kind string, status string")
    old, seeds = (spark.createDataFrame(r, "id string, value string") for r in ([("x", "old")], [("x", "new"), ("y", "new")]))
    children = spark.createDataFrame([("10", "1"), ("11", "2")], "id string, parent string")
    parts = {
        "current": lifecycle.flipped(results, "page", "id", "at").select("id", F.col("is_current").cast("string").alias("value")),
        "active": lifecycle.activated(versions, spark.createDataFrame([("2",)], "id string")).select("id", F.col("status").alias("value")),
        "seeded": lifecycle.added_if_absent(old, seeds, "id"),
        "unlinked": lifecycle.unlinked(children, spark.createDataFrame([("1",)], "id string"), "parent").select("id", F.col("parent").alias("value")),
        "dismissed": matching.dismissed(_decided(spark).withColumn("status", F.lit("suggested")), spark.createDataFrame([("1",)], "id string")).select("id", F.col("status").alias("value")),
    }
    every = None
    for step, rows in parts.items():
        named = rows.select(F.lit(step).alias("step"), "id", "value")
        every = named if every is None else every.unionByName(named)
    return every


@known("id, texts", ("full", "a"), ("same", "a,bb"), ("none", "a"), ("variant", "a,ＡＢ"))
def alias_cases(spark: SparkSession, folder: str) -> DataFrame:
    """Spellings learned once, only genuine variants, and one removed."""
    rows = spark.createDataFrame([("full", "a", "b"), ("same", "bb", "value"), ("none", "x", "x"), ("variant", "ＡＢ", "value")], "id string, text string, value string")
    known_aliases = F.array(F.struct(F.lit("name").alias("field_key"), F.lit("a").alias("text")))
    learned = matching.learned_aliases(known_aliases, F.lit("name"), F.col("text"), X.normal_form(F.col("value")), F.lit(None).cast("string"))
    removed = F.when(F.col("id") == "full", matching.without_alias(F.array_append(known_aliases, F.struct(F.lit("name").alias("field_key"), F.lit("b").alias("text"))), F.lit("name"), F.lit("b"))).otherwise(learned)
    return rows.select("id", F.array_join(F.array_sort(removed["text"]), ",").alias("texts"))
