from __future__ import annotations

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from paperlane.operators import diffs, engines, extraction, imports, layout, lifecycle, matching, nested, quality
from paperlane.operators import relational as R
from paperlane.sources import files, sinks


def shared(rows):
    return [tuple(r) for r in rows]


# nested records


def links(spark, records):
    rows = spark.createDataFrame(records, "id string, j string, record_id string")
    return sorted(shared(nested.element_links(rows, "id", "j").collect()))


def test_elements_and_parents(spark):
    doc = {"a": [{"b": [1, {"c": None}]}, [[{}]]], "l": {"r": [{}]}}
    want = [("1", "$", "$.a[0]"), ("1", "$", "$.a[1][0][0]"), ("1", "$.a[0]", "$.a[0].b[1]"), ("1", "$.l", "$.l.r[0]")]
    assert links(spark, [("1", json.dumps(doc), "clash")]) == want
    assert links(spark, [("1", json.dumps(json.dumps(json.dumps(doc))), None)]) == want


def test_records_without_rows(spark):
    texts = [None, "", "  ", '{"a": [{}', "null", "[]", "{}", '"x"', '{"a": NaN}', '{"a": [{}]} x', "[1, 2]"]
    assert links(spark, [(str(i), t, None) for i, t in enumerate(texts)]) == []
    assert links(spark, []) == []


def test_deep_records(spark):
    depth = 20000
    deep = "[" * depth + "{}" + "]" * depth
    assert links(spark, [("1", deep, None)]) == [("1", "$", "$" + "[0]" * depth)]
    assert links(spark, [("1", deep[:-1], None)]) == []
    for good in ('{"a":[1,2.5e3,"x\\n",true,null,{"b":{}}]}', "[]", "3"):
        assert nested._parse_deep(good) == json.loads(good)
    for bad in ("{", "[1,]", '{"a"}', '{"a":1,}', "[1 2]", "1 2", "", "{1:2}", "]"):
        with pytest.raises(nested.NotJson):
            nested._parse_deep(bad)


def test_variants_and_supertypes(spark):
    rows = spark.createDataFrame([("1", '{"f": [{"k": "a", "v": 1}, {"k": "b"}, {"k": "c", "v": 2}]}')], "id string, j string")
    flat = nested.nodes(rows, "id", "j")
    top = {r["role"]: r for r in nested.supertypes(flat).collect()}
    assert top["$.f[]"]["n_variants"] == 2 and top["$.f[]"]["common_keys"] == ["k"]
    shape = [r for r in nested.variants(flat).collect() if r["role"] == "$.f[]" and r["n"] == 2][0]
    typed = nested.subtype_table(flat, "$.f[]", shape["variant"], shape["kinds"])
    assert dict(typed.dtypes)["m_v"] == "double"
    assert sorted((r["node_path"], r["m_k"], r["m_v"]) for r in typed.collect()) == [("$.f[0]", "a", 1.0), ("$.f[2]", "c", 2.0)]


def test_every_object_is_in_its_subtype_table(spark):
    doc = {"f": [{"k": "a", "v": 1.5, "on": True, "x": None}, {"k": "b", "v": "2"}, {"k": "c", "in": {"v": 3, "deep": [[{"v": False}]]}}], "n": 7}
    flat = nested.nodes(spark.createDataFrame([("1", json.dumps(doc)), ("2", json.dumps(json.dumps(doc))), ("3", "{")], "id string, j string"), "id", "j")
    stacked = nested.subtypes(flat).collect()
    assert sorted((r["record_id"], r["node_path"]) for r in stacked) == sorted((r["record_id"], r["node_path"]) for r in flat.collect())
    shapes = nested.variants(flat).collect()
    assert len(shapes) == 6
    for shape in shapes:
        typed = nested.subtype_table(flat, shape["role"], shape["variant"], shape["kinds"])
        want = sorted(([r[c] for c in ("record_id", "parent_path", "node_path")], {c[2:]: r[c] for c in typed.columns[3:]}) for r in typed.collect())
        mine = [r for r in stacked if (r["role"], r["variant"]) == (shape["role"], shape["variant"])]
        assert sorted(([r["record_id"], r["parent_path"], r["node_path"]], r["numbers"] | r["flags"] | r["texts"]) for r in mine) == want
    first = next(r for r in stacked if r["node_path"] == "$.f[0]")
    assert (first["numbers"], first["flags"], first["texts"]) == ({"v": 1.5}, {"on": True}, {"k": "a", "x": None})


# relations


def test_visibility(spark):
    rows = spark.createDataFrame([("1", "c", "private", "u"), ("2", "c", "shared", None), ("3", "c", "private", None), ("4", "d", "shared", "u")], "id string, company_id string, visibility string, uploaded_by_user_id string")
    see = lambda who: sorted(r["id"] for r in R.visible(rows, who).collect())
    assert see(R.Principal("c", "u")) == ["1", "2"]
    assert see(R.Principal("c", "x")) == ["2"]
    assert see(R.Principal("c", None)) == ["2"]
    assert see(R.Principal("c", "x", admin=True)) == ["1", "2", "3"]
    assert see(R.Principal(None, admin=True)) == ["1", "2", "3", "4"]


def test_first_copies_keeps_scopes_apart(spark):
    at = datetime(2024, 1, 1)
    rows = spark.createDataFrame([("a", "h", "c", "u", at), ("b", "h", "c", "u", at), ("c", "h", "c", "v", at), ("d", "h", "e", "u", at), ("e", None, "c", "u", at), ("f", "h", "c", None, at), ("g", "h", "c", None, at)], "id string, sha string, company string, who string, at timestamp")
    got = dict(shared(R.first_copies(rows, [F.col("sha"), F.col("company"), F.col("who")], "at", "id").collect()))
    assert got == {"a": "a", "b": "a", "c": "c", "d": "d", "e": "e", "f": "f", "g": "f"}


def test_sessions_part_at_the_gap(spark):
    start = datetime(2024, 1, 1)
    rows = spark.createDataFrame([("d", start + timedelta(seconds=s), str(s)) for s in (0, 59, 119, 120)], "k string, at timestamp, t string")
    assert [r["session"] for r in R.sessions(rows, "k", "at", 60, "t").orderBy("at").collect()] == [1, 1, 2, 2]


def test_daily_volume_fills_gaps(spark):
    rows = spark.createDataFrame([(datetime(2024, 1, 1),), (datetime(2024, 1, 3),), (datetime(2024, 1, 3),)], "created_at timestamp")
    assert [r["n"] for r in R.daily_volume(rows, 4).orderBy("day").collect()] == [0, 1, 0, 2]
    assert R.daily_volume(rows.limit(0), 4).count() == 0


# matching


@pytest.mark.parametrize(("value", "unit", "score"), [("株式会社サンプル商事", "株式会社サンプル商事 御中", 1.0), ("C-001", "Ｃ－００１", 1.0), ("株式会社サンプル商事", "株式会社サンプル商亊", 0.9), ("abc", "xyz", None), ("商事", "x" * 50, None)])
def test_scores(spark, value, unit, score):
    from paperlane.functions.text import normal_form

    rows = spark.createDataFrame([(value, unit)], "v string, u string").select(normal_form(F.col("v")).alias("v"), normal_form(F.col("u")).alias("u"))
    got = rows.select(matching.score(F.col("v"), F.col("u")).alias("s")).head()["s"]
    assert got == (None if score is None else pytest.approx(score))


def test_blocking_finds_what_all_pairs_find(spark):
    import random

    r = random.Random(3)
    values = ["".join(r.choice("abcdefgh ") for _ in range(r.randint(2, 30))).strip() for _ in range(60)]
    values = [" ".join(v.split()) for v in values if len(v.strip()) >= 2]
    units = []
    for v in values:
        u = list(v)
        for _ in range(r.randint(0, max(1, len(u) // 5))):
            u[r.randrange(len(u))] = r.choice("abcdefghz")
        units.append(" ".join("".join(u).split()))
    v = spark.createDataFrame([("c", x) for x in set(values)], "company_id string, norm string")
    u = spark.createDataFrame([("c", x) for x in set(units) if x], "company_id string, unit_norm string")
    got = {tuple(x) for x in matching.candidates(v, u).select("norm", "unit_norm").collect()}
    every = v.join(u, "company_id").withColumn("s", matching.score(F.col("norm"), F.col("unit_norm"))).filter("s is not null")
    assert got == {tuple(x) for x in every.select("norm", "unit_norm").collect()} and got


@pytest.fixture(scope="module")
def masters(spark):
    fields = "array<struct<key:string,label:string,matchable:boolean,required:boolean>>"
    types = spark.createDataFrame([("t", [("name", "n", True, True), ("address", "a", True, False), ("code", "c", False, False)])], f"id string, fields {fields}")
    records = spark.createDataFrame([("r", "c", "t", {"name": "株式会社サンプル商事", "address": "東京都港区1-2-3", "code": "C-001"}, [("name", "サソプル商事")])], "id string, company_id string, master_type_id string, data map<string,string>, aliases array<struct<field_key:string,text:string>>")
    return types, records


def test_best_matches(spark, masters):
    types, records = masters
    pages = spark.createDataFrame([("c", "p", "o", "# 請求書\n株式会社サンプル商事 御中\n| 住所 | 東京都港区1-2-3 |"), ("c", "q", "o2", "サソプル商事"), ("d", "x", "o3", "株式会社サンプル商事"), ("c", "e", "o4", "")], "company_id string, page_id string, ocr_result_id string, markdown string")
    got = sorted((r["page_id"], r["field_key"], r["matched_text"], r["score"], r["kind"], r["is_alias"]) for r in matching.best_matches(pages, records, types).collect())
    assert got == [("p", "address", "東京都港区1-2-3", 1.0, "exact", False), ("p", "name", "株式会社サンプル商事", 1.0, "exact", False), ("q", "name", "サソプル商事", 1.0, "exact", True)]


def test_decisions_stay(spark, masters):
    types, records = masters
    pages = spark.createDataFrame([("c", "p", "o", "株式会社サンプル商事")], "company_id string, page_id string, ocr_result_id string, markdown string")
    best = matching.best_matches(pages, records, types)
    decided = spark.createDataFrame([("dismissed", "p", "r", "name", "株式会社サンプル商事")], "status string, page_id string, master_record_id string, field_key string, matched_text string")
    assert matching.proposals(best, decided).count() == 0
    assert [r["status"] for r in matching.after_rematch(decided, best).collect()] == ["dismissed"]


# layout


def line(text, x0, y0, x1, y1):
    return layout.Box(x0, y0, x1, y1, text, confidence=0.95)


def test_reading_order():
    regions = [layout.Box(300, 0, 500, 20, "right"), layout.Box(0, 0, 200, 20, "left"), layout.Box(0, 100, 500, 120, "below")]
    assert [b.text for b in layout.reading_order(regions)] == ["left", "right", "below"]
    columns = [layout.Box(x, 0, x + 20, 300, str(x), vertical=True) for x in (100, 400, 250)]
    assert sorted(b.text for b in layout.reading_order(columns)) == ["100", "250", "400"]
    assert [b.text for b in layout.by_bands(columns)] == ["400", "250", "100"]
    assert layout.reading_order([]) == [] and layout.page_text([layout.Box(0, 0, 1, 1, " ")]) == ""


def test_tables_from_lines():
    lines = [line("請求書", 200, 0, 300, 30), line("品目", 0, 100, 60, 120), line("数量", 200, 100, 260, 120), line("金額", 400, 100, 460, 120), line("部品A", 0, 140, 80, 160), line("2", 210, 140, 230, 160), line("¥2,000", 400, 140, 470, 160), line(" ", 0, 0, 1, 1)]
    found = layout.regions_of(lines)
    tables = [b for b in found if b.kind == "table"]
    assert len(tables) == 1 and tables[0].text == "| 品目 | 数量 | 金額 |\n| --- | --- | --- |\n| 部品A | 2 | ¥2,000 |"
    assert [b.text for b in found if b.kind == "text"] == ["請求書"]
    assert tables[0].confidence == pytest.approx(0.95)
    beside = [line("東京都港区", 0, 0, 100, 20), line("大阪市北区", 300, 0, 400, 20), line("一丁目", 0, 30, 80, 50), line("二丁目", 300, 30, 380, 50)]
    assert not [b for b in layout.regions_of(beside) if b.kind == "table"]
    assert layout.payload_regions("text", [])[0].text == "text" and layout.payload_regions(" ", []) == []
    assert layout.merged_boxes([(0, 0, 10, 10)], [(1, 1, 10, 10), (50, 50, 60, 60)]) == [(0, 0, 10, 10), (50, 50, 60, 60)]


def test_layout_over_pages(spark):
    rows = spark.createDataFrame([("p", 300.0, 0.0, 400.0, 20.0, "b", False), ("p", 0.0, 0.0, 100.0, 20.0, "a", False), ("q", 0.0, 0.0, 1.0, 1.0, "c", None)], "page string, x0 double, y0 double, x1 double, y1 double, text string, vertical boolean")
    pages = rows.groupBy("page").agg(F.collect_list(F.struct(*[c for c in rows.columns if c != "page"])).alias("regions"))
    pages = pages.unionByName(pages.limit(1).select(F.lit("empty").alias("page"), F.filter("regions", lambda r: F.lit(False)).alias("regions"))).unionByName(pages.limit(1).select(F.lit("null").alias("page"), F.lit(None).cast(pages.schema["regions"].dataType).alias("regions")))
    assert sorted(shared(layout.ordered_regions(pages, "page").collect())) == [("p", 0, "a"), ("p", 1, "b"), ("q", 0, "c")]
    assert layout.reconstructed(pages, "page", "regions").count() == 3
    assert "Exchange" not in layout.reconstructed(pages, "page", "regions")._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[0]


def test_regions_without_a_box_are_kept(spark, tmp_path):
    from paperlane.plans import layout_queries

    def at(text, *bbox, kind="text", **more):
        return {"kind": kind, "markdown": text, "confidence": 0.9, **({"bbox": list(bbox)} if bbox else {}), **more}

    corners = [[0, 0], [50, 0], [50, 20], [0, 20]]
    found = [at("below", 0, 100, 200, 120), at("Total due: 370,400"), at("合計金額: 844,950", lines=[{"text": "合計金額: 844,950", "score": 0.9, "box": corners}]), at("above", 0, 0, 200, 20), at("short", 1, 2), at("| 発行日 | 2024/3/5 |", kind="table")]
    text = json.dumps({"regions": found})
    spark.createDataFrame([("r", "p", True, text), ("s", "q", True, json.dumps({"regions": [at("発行日"), at("無関係 2024-01-01")]}))], "id string, page_id string, is_current boolean, layout_json string").write.parquet(str(tmp_path / "ocr_results.parquet"))
    spark.createDataFrame([("p", "d", 1), ("q", "e", 1)], "id string, document_id string, page_number int").write.parquet(str(tmp_path / "ocr_pages.parquet"))
    assert layout_queries.regions(spark, str(tmp_path)).count() == 8
    fields = {(r["document_id"], r["key"]): r["value"] for r in layout_queries.extracted_fields(spark, str(tmp_path)).collect()}
    assert fields["d", "total"] == "844950"
    assert fields["e", "date"] is None  # regions without a place are nobody's neighbours
    order = [r["text"] for r in sorted(layout_queries.reading_order(spark, str(tmp_path)).filter("ocr_result_id = 'r'").collect(), key=lambda r: r["ord"])]
    assert order == ["above", "short", "| 発行日 | 2024/3/5 |", "below", "Total due: 370,400", "合計金額: 844,950"]
    assert [r["text"] for r in layout_queries.table_reconstruction(spark, str(tmp_path)).collect()] == ["合計金額: 844,950"]


# extraction, differences, engines


def test_fields(spark):
    rows = [("d", 1, 0, "text", "株式会社甲 御中", 0.0, 0.0, 100.0, 20.0, 0.97), ("d", 1, 1, "text", "株式会社乙", 300.0, 0.0, 400.0, 20.0, 0.9), ("d", 1, 2, "text", "合計金額", 0.0, 50.0, 80.0, 70.0, 0.9), ("d", 1, 3, "text", "¥12,300", 100.0, 50.0, 160.0, 70.0, 0.8), ("d", 1, 4, "text", "発行日: 2024年3月5日", 0.0, 90.0, 160.0, 110.0, 0.99), ("e", 1, 0, "text", "", 0.0, 0.0, 1.0, 1.0, None)]
    frame = spark.createDataFrame(rows, "doc string, page_number int, ord int, kind string, markdown string, x0 double, y0 double, x1 double, y1 double, confidence double")
    documents = frame.groupBy("doc").agg(F.collect_list(F.struct(*[c for c in frame.columns if c != "doc"])).alias("regions"))
    got = {(r["doc"], r["key"]): r for r in extraction.extract(documents, "doc").collect()}
    assert got["d", "recipient"]["value"] == "株式会社甲" and got["d", "issuer"]["value"] == "株式会社乙"
    assert (got["d", "total"]["value"], got["d", "total"]["confidence"]) == ("12300", pytest.approx(0.72))
    assert (got["d", "date"]["value"], got["d", "date"]["confidence"]) == ("2024-03-05", pytest.approx(0.99))
    assert got["d", "subject"]["missing"] and all(r["missing"] for (d, _), r in got.items() if d == "e")


def test_differences(spark):
    old, new = "t\n| 品目 | 金額 |\n| --- | --- |\n| A | 1 |\n| B | 2 |", "u\n| 品目 | 金額 |\n| --- | --- |\n| A | 1 |\n| B | 3 |"
    assert diffs.changes(old, new) == [("text", None, None, "t", "u"), ("cell", "金額", 2, "2", "3")]
    assert diffs.changes(None, None) == [] and diffs.changes("a", "a") == []
    assert [(t, m) for _, t, m in diffs.segments("xabcab<br>y", ["ab", "abc", ""])] == [("x", None), ("abc", "abc"), ("ab", "ab"), ("y", None)]
    rows = spark.createDataFrame([(1, old, new), (2, None, "x"), (3, "", "")], "k int, a string, b string")
    assert sorted(r["k"] for r in diffs.changed(rows, "k", "a", "b").collect()) == [1, 1, 2]


def test_engine_isolates_failures(spark):
    def broken():
        def recognise(name, _):
            if name == "bad":
                raise RuntimeError("no")
            return []

        return recognise

    engines.register("broken", broken)
    pages = spark.createDataFrame([("bad", b""), ("good", b"")], "name string, content binary")
    got = {r["name"]: r for r in engines.recognised(pages, "broken").collect()}
    assert got["bad"]["error"] == "no" and got["bad"]["regions"] is None and got["good"]["error"] is None
    assert len(engines.recognised(pages).filter("name = 'good'").head()["regions"]) == 4


# quality and lifecycle


def test_gate(spark):
    rows = spark.createDataFrame([("ok", 0.10, 0.08, 0.05, 0.05, 0.9, 0.9), ("same", 0.10, 0.0999, 0.05, 0.05, 0.9, 0.9), ("golden", 0.10, 0.08, 0.05, 0.07, 0.9, 0.9), ("f1", 0.10, 0.08, 0.05, 0.05, 0.9, 0.8), ("zero", 0.0, 0.0, 0.05, 0.05, 0.9, 0.9)], "name string, base_holdout double, new_holdout double, base_golden double, new_golden double, base_f1 double, new_f1 double")
    assert {r["name"]: r["passed"] for r in quality.gate(rows).collect()} == {"ok": True, "same": False, "golden": False, "f1": False, "zero": False}


def test_cell_f1(spark):
    t = "| a | b |\n| --- | --- |\n| c | d |"
    rows = spark.createDataFrame([(1, t, t), (2, t, t.replace("d", "x").replace("b", "y")), (3, t, ""), (4, None, None)], "k int, a string, b string")
    assert dict(shared(quality.cell_f1(rows, "k", "a", "b").collect())) == {1: 1.0, 2: 0.5, 3: 0.0, 4: 1.0}


def test_splits(spark):
    rows = spark.createDataFrame([(i // 2, "s") for i in range(20)], "doc int, scope string")
    sides = quality.split_rows(rows, "doc", "scope", 0.2).groupBy("doc").agg(F.count_distinct("split").alias("n"), F.first("split").alias("s")).collect()
    assert all(r["n"] == 1 for r in sides) and sum(r["s"] == "holdout" for r in sides) == 2
    assert quality.shuffled_holdout([], 0.1) == set() and len(quality.shuffled_holdout(["a"], 0.1)) == 1
    assert quality.shuffled_holdout(list("abcabc")) == quality.shuffled_holdout(list("abc"))


def test_lifecycle(spark):
    rows = spark.createDataFrame([(1, "draft"), (2, "approved")], "id int, status string")
    changes = spark.createDataFrame([(1, "submitted"), (2, "draft"), (3, "submitted")], "id int, to string")
    after, refused = lifecycle.applied(rows, changes, "id")
    assert dict(shared(after.collect())) == {1: "submitted", 2: "approved"}
    assert sorted(shared(refused.select("id", "reason").collect())) == [(2, "not from approved"), (3, "not found")]
    versions = spark.createDataFrame([(1, None, "k", "active"), (2, None, "k", "candidate"), (3, "c", "k", "active"), (4, None, "k", "broken")], "id int, company_id string, kind string, status string")
    on = lambda i: {r["id"]: r["status"] for r in lifecycle.activated(versions, spark.createDataFrame([(i,)], "id int")).collect()}
    assert on(2) == {1: "retired", 2: "active", 3: "active", 4: "broken"} and on(4)[1] == "active"
    parents = spark.createDataFrame([(1,)], "id int")
    children = spark.createDataFrame([(10, 1), (11, 2), (12, None)], "id int, parent int")
    assert sorted(r["id"] for r in lifecycle.without(children, parents, "parent").collect()) == [11, 12]
    assert {r["id"]: r["parent"] for r in lifecycle.unlinked(children, parents, "parent").collect()} == {10: None, 11: 2, 12: None}


# files and sinks


FIELDS = [{"key": "name", "label": "名称", "required": True}, {"key": "price", "label": "単価"}]


def test_import(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿name,price\nA,1\n\nA,1\n,5\nB,2\n".encode())
    (tmp_path / "b.csv").write_bytes("名称,単価\n甲,1\n".encode("cp932"))
    (tmp_path / "c.csv").write_bytes(b"qty,x\n")
    (tmp_path / "d.csv").write_bytes(b"D,4\nE\n")
    rows = files.tabular(spark, str(tmp_path)).withColumn("path", F.element_at(F.split("path", "/"), -1))
    assert sorted(r["cells"][0] for r in rows.collect()) == ["", "A", "A", "B", "D", "E", "name", "qty", "名称", "甲"]
    seen = {r["path"]: (len(r["first_rows"]), r["total_rows"], r["guessed_header"]) for r in imports.previews(rows, FIELDS).collect()}
    assert seen == {"a.csv": (5, 5, True), "b.csv": (2, 2, True), "c.csv": (1, 1, True), "d.csv": (2, 2, False)}
    existing = spark.createDataFrame([({"name": "B", "price": "2"},)], "data map<string,string>")
    got = imports.imported(rows, FIELDS, existing)
    outcome = {(r["path"], r["line_no"]): (r["outcome"], r["reason"]) for r in got.collect()}
    assert outcome == {
        ("a.csv", 2): ("created", None), ("a.csv", 3): ("skipped", None), ("a.csv", 4): ("error", "field '名称' is required"), ("a.csv", 5): ("skipped", None),
        ("b.csv", 2): ("created", None), ("d.csv", 1): ("created", None), ("d.csv", 2): ("created", None),
    }
    assert {r["path"]: (r["created"], r["skipped"], r["failed"], list(r["errors"])) for r in imports.tally(got).collect()}["a.csv"] == (1, 2, 1, ["line 4: field '名称' is required"])
    forced = imports.imported(rows.filter("path = 'c.csv'").unionByName(spark.createDataFrame([("c.csv", 2, ["1", "2"])], rows.schema)), FIELDS, existing)
    assert [r["reason"] for r in forced.collect()] == ["the header names no field"]
    free = imports.imported(rows.filter("path = 'd.csv'"), [], existing)
    assert sorted(tuple(sorted(r["data"].items())) for r in free.collect()) == [(("col_1", "D"), ("col_2", "4")), (("col_1", "E"),)]
    assert imports.imported(rows.limit(0), FIELDS, existing).count() == 0


def test_headers_and_keys(spark):
    def guess(rows):
        return spark.createDataFrame([(rows,)], "r array<array<string>>").select(imports.header_guess(F.col("r"), imports.fields_of([])).alias("v")).head()["v"]

    assert guess([["x", "y"], ["1", "2"]]) and not guess([["1", "2"]]) and guess([["番号", "数量"]]) and guess([["qty"]]) and not guess([["ab", "c"], ["d", "e"]])
    keys = spark.createDataFrame([(["Unit Price", "単価", "", "unit price", "Price ($)", "__"],)], "h array<string>").select(imports.inferred_fields(F.col("h"))["key"].alias("k")).head()["k"]
    assert keys == ["unit_price", "col_2", "unit_price_4", "col_5", "col_6"]
    types = spark.createDataFrame([(1, [("Name!", "N", True, None)]), (2, [("a", "A", False, False)]), (3, [("a", "A", True, False), ("A", "B", True, False)]), (4, []), (5, [("a", " ", True, True)])], "type_id int, fields array<struct<key:string,label:string,matchable:boolean,required:boolean>>")
    checked = {r["type_id"]: r["error"] or [f["key"] for f in r["fields"]] for r in imports.checked_fields(types).collect()}
    assert checked == {1: ["name_"], 2: "at least one field must be matchable", 3: "duplicate field key: a", 4: [], 5: "every field needs a key and a label"}


def test_links_are_carried_through(spark):
    matches = spark.createDataFrame([(str(i), "r1" if i < 4 else "r2", "m", "name", t, "株式会社甲", s, None, None) for i, (t, s) in enumerate([("株式会社申", "suggested"), ("株式会社申", "suggested"), ("株式会社甲", "suggested"), ("x", "linked"), ("株式会社申 \"", "suggested")])], "id string, ocr_result_id string, master_record_id string, field_key string, matched_text string, master_value string, status string, linked_by string, linked_at timestamp")
    results = spark.createDataFrame([("r1", "株式会社申 御中 株式会社申", '{"m": "株式会社申"}'), ("r2", 'a 株式会社申 " b', '{"m": "株式会社申 \\""}')], "id string, markdown string, layout_json string")
    records = spark.createDataFrame([("m", {"name": "株式会社甲"}, None)], "id string, data map<string,string>, aliases array<struct<field_key:string,text:string>>")
    chosen = spark.createDataFrame([(i, "u", datetime(2024, 1, 1)) for i in ("0", "1", "2", "3", "4", "9")], "id string, linked_by string, linked_at timestamp")
    got = matching.linked(matches, results, records, chosen)
    assert {r["id"]: r["status"] for r in got.matches.collect()} == {"0": "linked", "1": "suggested", "2": "linked", "3": "linked", "4": "linked"}
    assert {r["id"]: (r["markdown"], r["layout_json"]) for r in got.results.collect()} == {"r1": ("株式会社甲 御中 株式会社甲", '{"m": "株式会社甲"}'), "r2": ("a 株式会社甲 b", '{"m": "株式会社甲"}')}
    assert sorted(shared(got.refused.collect())) == [("1", "matched text no longer there"), ("9", "no such match")]
    assert {a["text"] for a in got.records.head()["aliases"]} == {"株式会社申", '株式会社申 "'}
    assert {(r["match_id"], r["corrected_markdown"], r["status"]) for r in got.corrections.collect()} == {("0", "株式会社甲 御中 株式会社甲", "approved"), ("4", "a 株式会社甲 b", "approved")}
    assert matching.dismissed(matches, chosen.limit(1)).filter("status = 'dismissed'").count() == 1


def test_field_matches(spark):
    stored = json.dumps({"fields": [{"key": "to", "value": "株式会社甲 御中", "page_number": 1, "type": "text"}, {"key": "total", "value": "1", "page_number": 1, "type": "amount"}, {"key": "none", "value": " ", "page_number": 1}, {"key": "far", "value": "株式会社甲", "page_number": 2}]})
    documents = spark.createDataFrame([("d", stored), ("e", None), ("f", "{broken")], "document_id string, extracted_json string")
    pages = spark.createDataFrame([("p", "d", 1), ("q", "d", 2)], "id string, document_id string, page_number int")
    matches = spark.createDataFrame([("m1", "p", "株式会社申", "株式会社甲", 0.9, "suggested"), ("m2", "p", "御中", "御中", 0.8, "linked"), ("m3", "p", "株式会社甲", "株式会社甲", 1.0, "dismissed")], "id string, page_id string, matched_text string, master_value string, score double, status string")
    assert shared(matching.document_field_matches(documents, pages, matches).collect()) == [("d", "to", "m1", 0.9)]


def test_prefix_that_all_share_is_no_key(spark):
    """Names that begin alike meet only the units that have what is their own."""
    own = [chr(0x4E00 + 7 * i) + chr(0x5000 + 5 * i) + chr(0x5800 + 3 * i) + chr(0x6000 + 11 * i) + chr(0x6800 + 13 * i) + chr(0x7000 + 17 * i) for i in range(60)]
    values = spark.createDataFrame([("c", f"株式会社{x}") for x in own], "company_id string, norm string")
    found = values.withColumnRenamed("norm", "unit_norm")
    keyed = matching.rarest_keys(values, "norm", F.floor(18 * F.length("norm") / 100) + 1, found, "unit_norm", "company_id")
    met = matching._meeting(found, "unit_norm", 3, "company_id", keyed, "norm")
    assert met.count() == 2 * 60 and matching.candidates(values, found).filter("norm = unit_norm").count() == 60


def test_candidates_equal_brute_force(spark):
    import random

    r = random.Random(3)
    words = ["".join(r.choice("abcd") for _ in range(r.randint(2, 16))) for _ in range(120)]
    spoilt = ["".join(c if r.random() > 0.1 else r.choice("abcd") for c in w) + r.choice(["", "x", " yz"]) for w in words]
    values = spark.createDataFrame([("c", w) for w in words], "company_id string, norm string")
    found = spark.createDataFrame([("c", w) for w in spoilt + ["", "a"]], "company_id string, unit_norm string")
    every = values.crossJoin(found.select("unit_norm").distinct()).withColumn("score", matching.score(F.col("norm"), F.col("unit_norm"))).filter("score is not null").select("norm", "unit_norm").distinct()
    assert sorted(shared(matching.candidates(values, found).select("norm", "unit_norm").collect())) == sorted(shared(every.collect()))
    lines = found.withColumnRenamed("unit_norm", "line")
    got = matching.contained(lines.distinct(), values, "company_id", "line", "norm").select("line", "norm")
    want = lines.distinct().crossJoin(values.select("norm").distinct()).filter(F.contains("line", "norm")).select("line", "norm")
    assert sorted(shared(got.collect())) == sorted(shared(want.collect()))


def test_files_and_sinks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.PDF").write_bytes(b"1")
    (tmp_path / "in" / "y.txt").write_bytes(b"2")
    got = {r["name"]: r["mime_type"] for r in files.documents(spark, str(tmp_path / "in")).collect()}
    assert got == {"x.PDF": "application/pdf", "y.txt": None}
    import hashlib

    assert shared(sinks.folder_digest(files.documents(spark, str(tmp_path / "in"))).select("digest").collect()) == [(hashlib.sha256(b"x.PDF1y.txt2").hexdigest(),)]
    (tmp_path / "gold" / "s1").mkdir(parents=True)
    (tmp_path / "gold" / "s1" / "input.png").write_bytes(b"1")
    (tmp_path / "gold" / "s1" / "expected.md").write_text("# 請求書")
    assert shared(files.golden_samples(spark, str(tmp_path / "gold")).select("sample", "expected").collect()) == [("s1", "# 請求書")]
    line = spark.range(1).select(sinks.field_csv(F.array(F.lit("a"), F.lit("b")), F.array(F.lit('x"y'), F.lit(None).cast("string"))).alias("v")).head()["v"]
    assert line == '﻿a,b\r\n"x""y",""'
    sinks.append_audit(spark.createDataFrame([("c", "u", "login", 5, None)], "company_id string, actor string, action string, target_id int, detail string"), str(tmp_path / "audit"))
    assert spark.read.parquet(str(tmp_path / "audit")).head()["detail"] == "{}"
    from pyspark.sql import types as T

    assert files.json_lines(spark, str(tmp_path / "none.jsonl"), T.StructType([T.StructField("a", T.StringType())])).count() == 0


def test_cut_tables_are_cleared(spark):
    from paperlane.sources import checkpoints

    frame = checkpoints.cut(spark.range(5))
    assert frame.count() == 5 and checkpoints.clear(spark) >= 1 and checkpoints.clear(spark) == 0


def test_no_machine_local_folder_on_a_cluster():
    from types import SimpleNamespace

    from paperlane.sources import checkpoints

    none = SimpleNamespace(isDefined=lambda: False)
    context = SimpleNamespace(master="spark://host:7077", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: none)))
    with pytest.raises(RuntimeError):
        checkpoints.folder(SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=context))


def test_document_files(spark, tmp_path):
    rows = spark.createDataFrame([("c", "d1", "# 請求書\nx"), ("c", "d2", ""), ("c", "d3", None)], "company_id string, document_id string, markdown string")
    assert files.document_texts(rows.drop("markdown"), str(tmp_path / "none")).filter("markdown = ''").count() == 3
    for _ in range(2):  # again replaces
        assert {r["document_id"] for r in sinks.write_document_files(rows, str(tmp_path / "store")).collect()} == {"d1", "d2"}
    got = {r["document_id"]: r["markdown"] for r in files.document_texts(rows.drop("markdown"), str(tmp_path / "store")).collect()}
    assert got == {"d1": "# 請求書\nx", "d2": "", "d3": ""}
