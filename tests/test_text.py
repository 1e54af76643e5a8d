from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from paperlane.functions import geometry as G
from paperlane.functions import markdown as M
from paperlane.functions import text as X


def one(spark, expression, **values):
    types = ", ".join(f"{k} string" for k in values)
    frame = spark.createDataFrame([tuple(values.values())], types) if values else spark.range(1)
    return frame.select(expression.alias("v")).head()["v"]


def test_normal_forms(spark):
    assert one(spark, X.normal_form(F.col("t")), t="Ｃ－００１　 x\n y ") == "C-001 x y"
    assert one(spark, X.key_form(F.col("t")), t="ご請求 Ａ B") == "ご請求ab"
    assert one(spark, X.normal_form(F.col("t")), t=None) is None
    assert one(spark, X.normal_form(F.col("t")), t="") == ""


@pytest.mark.parametrize(("a", "b", "rate"), [("金額123 カタカナ", "金額１２３ ｶﾀｶﾅ", 0.0), ("abc", "abd", 1 / 3), ("", "", 0.0), ("", "junk", 1.0)])
def test_error_rate(spark, a, b, rate):
    assert one(spark, X.error_rate(X.normal_form(F.col("a")), X.normal_form(F.col("b"))), a=a, b=b) == pytest.approx(rate)


def test_lines_as_python_splits_them(spark):
    r = random.Random(1)
    texts = ["", "a", "a\n", "\n", *["".join(r.choice("ab\n\r\x0b\x0c\x1c\x1d\x1e\x85   ") for _ in range(r.randint(0, 12))) for _ in range(300)]]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", X.lines(F.col("t")).alias("l")).collect()
    for row in rows:
        assert row["l"] == texts[row["i"]].splitlines(), repr(texts[row["i"]])


def test_typed_values(spark):
    assert one(spark, X.typed_date(F.col("t")), t="発行日 24年3月5日") == "2024-03-05"
    assert one(spark, X.typed_date(F.col("t")), t="none") is None
    assert one(spark, X.typed_amount(F.col("t")), t="合計 ¥1,234,567円") == "1234567"
    assert one(spark, X.typed_number(F.col("t")), t="x -12,5.50") == "-125.50"


def test_category_and_label(spark):
    assert one(spark, X.category(F.col("t")), t="控え 見積書 納品書") == "quotation"
    assert one(spark, X.category(F.col("t")), t="nothing") is None
    assert one(spark, X.category_label(F.col("t")), t="invoice") == "請求書"
    assert one(spark, X.category_label(F.col("t")), t="poem") == "poem"


def test_slugs_cells_and_names(spark):
    assert one(spark, X.name_slug(F.col("t")), t="  Foo__Bar  & Söhne- ") == "foo-bar-s-hne"
    assert one(spark, X.field_slug(F.col("t")), t="Name!") == "name_"
    for prefix in "=+-@\t\r":
        assert one(spark, X.guarded_cell(F.col("t")), t=prefix + "1") == "'" + prefix + "1"
    assert one(spark, X.guarded_cell(F.col("t")), t="normal") == "normal"
    assert one(spark, X.suffix(F.col("t")), t="A.tar.GZ") == ".gz"
    assert one(spark, X.stem(F.col("t")), t="A.tar.GZ") == "A.tar"
    assert one(spark, X.numberish(F.col("t")), t="¥1,000") and not one(spark, X.numberish(F.col("t")), t="abc")
    assert one(spark, X.looks_amount(F.col("t")), t="7,000円") and not one(spark, X.looks_amount(F.col("t")), t="部品 1")


def test_common_affix(spark):
    got = one(spark, X.common_affix(F.col("a"), F.col("b")), a="abcXdef", b="abcYYdef")
    assert (got["prefix"], got["suffix"]) == (3, 3)
    got = one(spark, X.common_affix(F.col("a"), F.col("b")), a="aa", b="aaa")
    assert (got["prefix"], got["suffix"]) == (2, 0)


def test_tables(spark):
    text = "# t\n| 品目 | 金額 |\n| --- | :---: |\n| A | ¥100 |\nnot | a row"
    assert one(spark, M.table_cells(F.col("t")), t=text) == [["品目", "金額"], ["A", "¥100"]]
    assert one(spark, M.unescaped_cells(F.col("t")), t=r"| a\|b | c |") == ["a|b", "c"]
    assert one(spark, M.plain_text(F.col("t")), t="# h\n\n![x](y)\n| a<br>b |  | c |\n| --- | --- | --- |\nend") == "# h\na b  c\nend"
    assert one(spark, M.rendered_table(F.array(F.array(F.lit("A|B"), F.lit("1\n2")), F.array(F.lit("x"))))) == "| A\\|B | 1<br>2 |\n| --- | --- |\n| x |  |"


def test_units_keep_first_places(spark):
    text = "## 株式会社 御中\n| a b | c |\n| --- | --- |\n| a b | d |\n![i](j)\n株式会社 御中"
    assert one(spark, M.text_units(F.col("t")), t=text) == ["株式会社 御中", "株式会社", "御中", "a b", "c", "d"]


def test_blocks(spark):
    got = one(spark, M.blocks(F.col("t")), t="a\n| x |\n| y |\n\n![i](j)\n| z |")
    assert [(b["ord"], b["kind"], b["content"]) for b in got] == [(0, "text", "a"), (1, "table", "| x |\n| y |"), (2, "image", "![i](j)"), (3, "table", "| z |")]


def test_html_tables(spark):
    assert one(spark, M.html_table(F.col("t")), t="<table><tr><td colspan='2'>合計</td><td>¥7,000</td></tr></table>").split("\n")[0] == "| 合計 |  | ¥7,000 |"
    assert one(spark, M.html_table(F.col("t")), t="<div>plain</div>") == "plain"
    assert one(spark, M.html_table(F.col("t")), t=None) is None
    assert one(spark, M.html_table(F.col("t")), t="<tr><td>open") == "| open |\n| --- |"
    region = one(spark, M.block_region(F.lit("doc_title"), F.col("t")), t="A &amp; B")
    assert (region["kind"], region["markdown"], region["vertical"]) == ("title", "## A & B", False)


def test_rectangles(spark):
    a, b = G.box(F.lit(0), F.lit(0), F.lit(2), F.lit(2)), G.box(F.lit(1), F.lit(1), F.lit(3), F.lit(3))
    assert one(spark, G.overlap(a, b)) == pytest.approx(1 / 7)
    assert one(spark, G.overlap(a, G.box(F.lit(5), F.lit(5), F.lit(5), F.lit(5)))) == 0
    rows = spark.createDataFrame([(1, 0.0, 10.0), (2, 2.0, 3.0), (3, 12.0, 13.0), (4, 40.0, 41.0)], "k int, s double, e double").withColumn("p", F.lit(1))
    assert [r["island"] for r in G.islands(rows, ["p"], "s", "e", 5.0, ["k"]).orderBy("k").collect()] == [1, 1, 1, 2]
    lines = spark.createDataFrame([(1, 1), (1, 2)], "p int, line int").withColumn("b", F.when(F.col("line") == 1, a).otherwise(G.box(F.lit(90), F.lit(90), F.lit(91), F.lit(91))))
    boxes = spark.createDataFrame([(1, 0), (1, 1)], "p int, ord int").withColumn("b", b)
    assert {r["line"]: r["ord"] for r in G.first_box(lines, boxes, "p").collect()} == {1: 0, 2: None}
    assert G.uncovered(lines, boxes, "p", "line", 0.2).select("line").collect()[0]["line"] == 2


def test_text_queries_cover_whole_tables(spark, tmp_path):
    import unicodedata

    from paperlane.plans import text_queries as Q

    def put(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
        return row[-1]

    pairs = [("1", "name", "株式会社サンフル", "株式会社サンプル"), ("2", "name", "ＡＢＣ", "ABD"), ("3", "name", "abc", "abd"), ("4", "name", None, "x"), ("5", "name", "𠮷野", "吉野")]
    put("master_matches", pairs, "id string, field_key string, matched_text string, master_value string")
    want = {}
    for i, _, read, meant in pairs:
        if read is not None:
            a, b = unicodedata.normalize("NFKC", meant), unicodedata.normalize("NFKC", read)
            want[i] = (len(read), edits(a, b) / len(a))
    assert {x["id"]: (x["characters"], x["cer"]) for x in Q.match_error_rates(spark, str(tmp_path)).collect()} == want

    names = {"a": "株式会社サンプルx", "b": "大阪", "c": "㈱", "d": "Acme", "e": "ÀB corp", "f": None, "g": "𠮷野家"}
    put("master_types", [("t", [("name", True)])], "id string, fields array<struct<key:string,matchable:boolean>>")
    put("master_records", [(k, "k", "t", {"name": v}, [(None, None), ("name", None)] if k in "de" else None) for k, v in names.items()], "id string, company_id string, master_type_id string, data map<string,string>, aliases array<struct<field_key:string,text:string>>")
    pages = {"p": "宛先 株式会社サンプルx 御中\n\n大阪市 大阪\n㈱甲", "q": "Acme 大阪\nAcme\n𠮷野家\nÀB corp"}
    put("ocr_results", [("r" + k, "k", k, t, True) for k, t in pages.items()], "id string, company_id string, page_id string, markdown string, is_current boolean")
    held = {(p, v): n for p, t in pages.items() for v in names.values() if v and (n := sum(v in line for line in t.split("\n")))}
    assert {(x["page_id"], x["value"]): x["lines"] for x in Q.contained_values(spark, str(tmp_path)).collect()} == held
    got = {x["id"]: x["aliases"] for x in Q.learned_aliases(spark, str(tmp_path)).collect()}
    assert got == {"a": "name:株式会社サンプルX", "b": "", "c": "", "d": ":|name:|name:ACME", "e": ":|name:|name:ÀB CORP", "f": "", "g": ""}
