from __future__ import annotations

import hashlib
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from paperlane.llm import batches, canonical, leaks, mojibake, pii, plainform, registry, scannoise, tokenize, truncation

EDGES = [None, "", "   ", "x" * 20_000]


# plain form


def test_mapping_is_final_and_canonical():
    table = plainform.mapping()
    assert all(not any(c in table for c in image) for image in table.values())
    for c in "ＡｶﾞﾊﾟﬁÅΩ２㌔":
        assert plainform.plain(c) == unicodedata.normalize("NFKC", c)
    for c in "漢字カナがー、。\t\n\réñß":
        assert plainform.is_plain(c)


@pytest.mark.parametrize(("text", "want"), [("W­il​fold", "Wilfold"), ("Suzuοkuyama", "Suzuokuyama"), ("がe" + "́", "がé"), ("ﾃｽﾄ　ＡＢＣ", "テスト ABC"), ("Берёза", "Берёза"), ("αβγ", "αβγ"), ("e​́", "é"), ("", ""), (None, None)])
def test_plain_form(text, want):
    got = plainform.plain(text)
    assert got == want and plainform.plain(got) == got
    assert plainform.is_plain(text) == (text == want)


def test_plain_form_is_plain_and_linear():
    import time

    r = random.Random(15)
    letters = "abWXz" + "αβΩμά" + "дЖаёщ" + "ｱＡがé\u0301\u0323\u0302\u200b\u00ad -1漢"
    for _ in range(3000):
        text = "".join(r.choice(letters) for _ in range(r.randint(1, 12)))
        got = plainform.plain(text)
        assert plainform.is_plain(got) and plainform.plain(got) == got, (text, got)
    assert plainform.plain("Xдa") == "Хда" and plainform.plain("5 µm") == "5 um" and plainform.plain("pаypаl") == "paypal"
    assert plainform.plain("a\u0302\u0323") == plainform.plain("a\u0323\u0302") == "ậ" and plainform.plain("a\u0327\u0301") == unicodedata.normalize("NFC", "a\u0327\u0301")
    for text in ("a" + "\u0301" * 100_000, "a\u200b" * 50_000 + "é", "x" * 100_000 + "ｱ"):
        began = time.time()
        plainform.plain(text), plainform.is_plain(text)
        assert time.time() - began < 3


def test_scan_drops_plain_texts_only(spark):
    r = random.Random(5)
    texts = ["".join(r.choice("abｱＡあé ­αа漢ー́\t") for _ in range(r.randint(0, 9))) for _ in range(400)] + EDGES
    rows = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "k int, t string, text string")
    got = {x["k"] for x in plainform.not_plain(rows, "t", ["k"]).collect()}
    assert got == {i for i, t in enumerate(texts) if not plainform.is_plain(t)}
    assert [x["p"] for x in rows.orderBy("k").select(plainform.plain_form(F.col("t")).alias("p")).collect()] == [plainform.plain(t) for t in texts]
    assert plainform.not_plain(rows.limit(0), "t", ["k"]).count() == 0


# tokens


def test_tokens_equal_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    path = f"{tokenize.TOKENIZERS}/byte_bpe_50k"
    reference = tokenizers.Tokenizer.from_file(f"{path}.json")
    reference.encode_special_tokens = True
    r = random.Random(2)
    texts = ["Hello  world's <|endoftext|> \n\n x", "請求書の金額は¥1,234です。", "👨‍🔧 ok", "a b　c\x85d\x1c", "é" * 300, *["".join(r.choice("abc XYZ 019'.,\n\tédéß日本語😀̈") for _ in range(60)) for _ in range(60)], *EDGES[1:]]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "k int, text string")
    got = {x["k"]: list(x["ids"]) for x in tokenize.encode(rows, "text", "ids", frequent=50).collect()}
    for i, t in enumerate(texts):
        assert got[i] == reference.encode(t, add_special_tokens=False).ids, repr(t[:80])
    assert got[len(texts)] == []
    ids = spark.createDataFrame([(got[i],) for i in range(5)], "ids array<int>")
    assert [bytes(x["b"]).decode() for x in ids.select(tokenize.decode(F.col("ids")).alias("b")).collect()] == texts[:5]
    assert tokenize.encode(rows.limit(0), "text", "ids").count() == 0


def test_long_words_take_no_quadratic_time(spark):
    import time

    tokenizers = pytest.importorskip("tokenizers")
    path = f"{tokenize.TOKENIZERS}/byte_bpe_50k"
    reference = tokenizers.Tokenizer.from_file(f"{path}.json")
    ranks, r = tokenize.load_ranks(f"{path}.tiktoken"), random.Random(18)
    for text in ["a", "aaaa", "banana", "".join(r.choice("abcdeé日") for _ in range(3000))]:
        assert tokenize.merged(text.encode(), ranks) == reference.encode(text, add_special_tokens=False).ids
    began = time.time()
    tokenize.merged(("".join(r.choice("abcdefgh") for _ in range(100_000))).encode(), ranks)
    assert time.time() - began < 10
    text = "start " + "".join(r.choice("abcde日本") for _ in range(20_000)) + " end"
    got = tokenize.encode(spark.createDataFrame([(1, text), (2, "short")], "k int, text string"), "text", "ids").collect()
    assert list(got[0]["ids"]) == reference.encode(text, add_special_tokens=False).ids and got[0].__fields__ == ["k", "text", "ids"]


# leaks


def brute_leak(text, item, lang, words=12, chars=30):
    a, b = leaks.reduced(text)[0], leaks.reduced(item)
    s, t = "".join(map(chr, a)), "".join(map(chr, b[0]))
    if lang == "ja":
        return any(t[i : i + chars] in s for i in range(len(t) - chars + 1))
    starts = [*b[1].tolist(), len(t)]
    return any(t[starts[i] : starts[i + words]] in s for i in range(len(starts) - words))


def test_leaks_equal_brute_force(spark):
    r = random.Random(4)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(r.randint(1, 9))) for _ in range(200)]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randint(12, 40))), "en") for i in range(12)]
    items += [(100 + i, "".join(r.choice("日月火水木金土山川田") for _ in range(60)), "ja") for i in range(4)]
    items += [(200, None, "en"), (201, "", "en"), (202, "too short", "en"), (203, items[0][1], None)]
    docs = []
    for k in range(150):
        i, text, lang = r.choice(items[:16])
        if lang == "ja":
            n = r.choice([10, 29, 30, 31, 45])
            at = r.randrange(len(text) - n)
            part = "、".join(text[at : at + n][j : j + 7] for j in range(0, n, 7))
        else:
            words = text.split()
            n = min(len(words), r.choice([5, 11, 12, 13, 20]))
            at = r.randrange(len(words) - n + 1)
            part = r.choice([" ", "\n", " - "]).join(w.upper() if r.random() < 0.3 else w for w in words[at : at + n])
        docs.append((k, " ".join(r.choice(vocabulary) for _ in range(20)) + " . " + part + " . " + " ".join(r.choice(vocabulary) for _ in range(20)), 1))
    docs += [(900 + k, t, 1) for k, t in enumerate(EDGES)]
    d = spark.createDataFrame(docs, "doc_id long, text string, item_id int")
    e = spark.createDataFrame(items, "item_id long, text string, lang string")
    want = {(k, i) for k, t, _ in docs if t for i, text, lang in items if text and brute_leak(t, text, lang)}
    for block in (4_000_000, 100):
        got = [tuple(x) for x in leaks.leaked(d, e, block_chars=block).collect()]
        assert sorted(got) == sorted(want) and want
    assert leaks.leaked(d.limit(0), e).count() == 0 and leaks.leaked(d, e.limit(0)).count() == 0


def test_alignment_pays_for_edits():
    codes = lambda t: leaks.reduced(t)[0]
    item = "abcdefghijklmnopqrstuvwxyz0123456789"
    for text, cost in ((item, 0), (item.replace("m", ""), 1), (item.replace("m", "mx"), 1), (item.replace("m", "9"), 1), (item.replace("mno", "xyz"), 3), (item.replace("fg", "").replace("t", "tq"), 3)):
        runs = leaks.runs_of(codes("zz " + text + " zz"), codes(item), -2, 6)
        assert [leaks.aligned(runs, e, len(item)) for e in range(5)] == [e >= cost for e in range(5)], text


# truncation


def test_cut_texts(spark):
    r = random.Random(6)
    sentence = lambda: f"The {r.choice(['north', 'south', 'east'])} store {r.choice(['sends', 'keeps', 'counts'])} {r.randint(10, 99)} boxes of {''.join(r.choice('abcdefgh') for _ in range(r.randint(2, 30)))} on {r.choice(['Monday', 'Friday'])} morning before noon."
    whole, cut, rows = set(), set(), []
    for k in range(700):
        text = " ".join(sentence() for _ in range(r.randint(2, 14))) + r.choice(["", "\n\nEnd of document", "\n\n2024-05-17", "\n\nclaims desk", "\n\n| a | b |\n| --- | --- |\n| 1 | 2 |"])
        source = "short" if k % 2 else "free"
        if source == "short" and len(text) > 500:
            text = text[:500]
            (whole if text.endswith(".") or text.rsplit("\n", 1)[-1] in ("End of document", "claims desk", "2024-05-17") or text.endswith("2 |") else cut).add(k)
        else:
            whole.add(k)
        rows.append((k, text, source))
    broken = [(1000, "Some text that is whole. And one that stops in the mid", "free"), (1001, "x.\n\n| a | b |\n| --- | --- |\n| 1", "free"), (1002, "lost �", "free"), (1003, "marked by...", "free")]
    rows += broken + [(2000 + i, t, None) for i, t in enumerate([None, "", "  ", "﻿", "\n"])]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("tail", F.lit("clash"))
    found = {(x["source"], x["measure"], x["length"]) for x in truncation.significant_lengths(truncation.endings(d)).collect()}
    assert ("short", "chars", 500) in found and all(length in (500,) for _, _, length in found)
    got = {x["doc_id"] for x in truncation.cut_texts(d).collect()}
    assert {1000, 1001, 1002, 1003} <= got and not got & set(range(2000, 2010))
    assert len(got & cut) >= 0.97 * len(cut) and len(got & whole) <= 2
    rates = {x["source"]: x for x in truncation.cut_rates(d).collect()}
    assert rates["short"]["rate"] > 0.3 and rates[""]["n_cut"] == 0
    assert truncation.cut_texts(d.limit(0)).count() == 0


# batches


def paper(r, number):
    return f"Invoice {number} 2024-{r.randint(1, 12):02d}-{r.randint(1, 28):02d} " + " ".join(f"{r.randint(1, 99)} | {r.randint(100, 99999)}" for _ in range(12))


def known(spark, rows):
    """(scope, id, hashes, figures, text, batch, at) of (scope, id, hash, text, batch)."""
    frame = spark.createDataFrame(list(rows), "scope string, id string, h string, t string, batch string").withColumn("at", F.coalesce(F.substring("batch", 2, 9).cast("int"), F.lit(5)).cast("timestamp"))
    return frame.select("scope", "id", F.array(batches.file_hash(F.col("h"))).alias("hashes"), batches.figures(F.col("t")).alias("figures"), batches.letters(F.col("t")).alias("text"), "batch", "at")


def test_papers(spark, tmp_path):
    r = random.Random(8)
    rows, want = [], set()
    for g in range(25):
        text = paper(r, f"QT-{10000 + g}-{r.randint(100, 999)}")
        ids = [f"d{g:02d}{c}" for c in "abc"[: r.randint(1, 3)]]
        for n, i in enumerate(ids):
            rows.append(("c1", i, None, ("page 7 tel 090-5555 " if n == 1 else "") + text, f"b{r.randint(0, 9)}"))
        want |= {(a, b) for a in ids for b in ids if a < b}
    h = hashlib.sha256(b"x").hexdigest()
    note = "We thank you for the good talks in our house and hope that the goods have come whole; please call us when the truck is there, as the doors of the hall are open in the morning only and nobody can tell how long it takes to bring all of it inside before the rain begins again."
    rows += [("c1", "x1", h.upper(), None, "b1"), ("c1", "x2", f"sha256:{h}", "", "b9"), ("c2", "x3", h, None, "b1"), (None, "x4", h, None, None), ("c1", "y1", None, None, "b1"), ("c1", "y2", "short", None, None)]
    rows += [("c1", "n1", None, note, "b2"), ("c1", "n2", None, note.replace("good talks", "good talk"), "b8"), ("c1", "n3", None, note[:50] + " and that nobody was late when the doors were opened again in the early hours of that same morning", "b5"), ("c1", "n4", None, "other words that say nothing of it at all", "b5")]
    want |= {("x1", "x2"), ("n1", "n2")}
    for rounds in (1, 3):
        got = batches.papers(known(spark, rows), str(tmp_path / f"store{rounds}"), rounds)
        assert {tuple(x) for x in batches.pairs_of(got).collect()} == want
    assert batches.papers(known(spark, rows).limit(0), str(tmp_path / "none")).count() == 0


def test_new_batches_meet_history(spark, tmp_path):
    r = random.Random(9)
    old, new, h = paper(r, "QT-11111-111"), paper(r, "QT-22222-222"), hashlib.sha256(b"y").hexdigest()
    store = str(tmp_path / "chunks")
    first = known(spark, [("c", "a", h, old, "b1"), ("c", "z", None, None, "b1"), ("e", "q", None, paper(r, "QT-33333-333"), "b1")])
    for _ in range(2):  # done again, it changes nothing
        checked = batches.check_batch(first, store, 0)
        assert checked.links.count() == 0
        batches.accept(checked, store, 0)
    stored = spark.read.parquet(f"{store}/chunks")
    assert stored.count() == stored.select("id", "chunk").distinct().count() > 0
    second = known(spark, [("c", "b", None, "copy 3 " + old, "b2"), ("c", "n", None, new, "b2"), ("d", "o", h, old, "b2"), ("c", "m", None, new, "b2"), ("c", "f", h, None, "b2")])
    checked = batches.check_batch(second, store, 1)
    assert sorted(tuple(sorted(x)) for x in checked.links.collect()) == [("a", "b"), ("a", "f"), ("m", "n")]
    batches.accept(checked, store, 1)
    # a copy that the store knows adds nothing; a batch reads the buckets of its own scopes only
    third = batches.check_batch(known(spark, [("c", "c", None, old, "b3")]), store, 2)
    assert [tuple(x) for x in third.links.collect()] == [("c", "a")] and third.chunks.count() == third.keys.count() == 0
    seen = batches._stored(known(spark, [("c", "c", None, old, "b3")]), store, "chunks", f"{batches.CHUNKS}, probe boolean", 2)
    assert {x["bucket"] for x in seen.select("bucket").distinct().collect()} == {spark.createDataFrame([("c",)], "scope string").select(batches._bucket()).first()[0]}


def test_rolling_hash_equals_each_windows_own():
    r = random.Random(17)
    for text in ("".join(r.choice("0123456789") for _ in range(500)), "".join(r.choice("abc日本") for _ in range(300)), "12", ""):
        for window in (3, 8):
            places = set(batches.boundaries(text, window, 4).tolist())
            assert places == {e for e in range(window, len(text) + 1) if batches.boundaries(text[e - window : e], window, 4).tolist() == [window]}
        assert "".join(batches.chunk_stream(text)) == text


def test_probing_loses_nothing(spark):
    r = random.Random(10)
    rows = [(k, c, r.randint(3, 9)) for k in range(60) for c in r.sample(range(40), 8)]
    by: dict[int, dict[int, int]] = {}
    for k, c, b in rows:
        by.setdefault(k, {})[c] = b
    frame = spark.createDataFrame([(f"{k:02d}", None, c, b, sum(by[k].values()), 0.45) for k, c, b in rows], batches.CHUNKS)
    near = lambda a, b: (s := sum(min(by[a][c], by[b][c]) for c in by[a] if c in by[b])) >= 8 and s / min(sum(by[a].values()), sum(by[b].values())) >= 0.45
    want = {(f"{a:02d}", f"{b:02d}") for a in by for b in by if a < b and near(a, b)}
    assert {tuple(sorted(x)) for x in batches.similar(batches.probing(frame)).collect()} == want and want
    old, new = frame.filter("id < '30'"), frame.filter("id >= '30'")
    met = {tuple(sorted(x)) for x in batches.similar(batches.probing(new, old), batches.probing(old).drop("shared")).collect()}
    assert met == {(a, b) for a, b in want if b >= "30"}


# values


def distance(a, b):
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            v = min(row[-1] + 1, rows[-1][j] + 1, rows[-1][j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, rows[-2][j - 2] + 1)
            row.append(v)
        rows.append(row)
    return rows[-1][-1]


def test_trie_equals_brute_force():
    r = random.Random(11)
    names = {"".join(r.choice("abcd") for _ in range(r.randint(3, 8))): i for i in range(60)}
    trie = canonical.Trie()
    for name, i in names.items():
        trie._path(name, i, False)
    for _ in range(200):
        key = "".join(r.choice("abcd") for _ in range(r.randint(2, 9)))
        want = {i: distance(key, n) for n, i in names.items() if distance(key, n) <= 2}
        assert trie.search(key, 2) == want


def stands(short, word):
    letters = iter(word)
    return bool(short) and len(short) <= len(word) and short[0] == word[0] and all(c in letters for c in short)


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_abbreviation_edges_equal_brute_force():
    r = random.Random(13)
    make = lambda: ["".join(r.choice("abc") for _ in range(r.randint(1, 9))) for _ in range(r.randint(1, 3))]
    names = {tuple(make()): i for i in range(80)}
    trie = canonical.Trie()
    for words, i in names.items():
        node = trie.names
        for c in " ".join(words):
            node = node.setdefault(c, {})
        node.setdefault("", set()).add(i)
    for _ in range(400):
        words = make()
        key = "".join(words)
        want = {i for n, i in names.items() if len(n) == len(words) > 1 and all(stands(w, x) or levenshtein(w, x) <= canonical.allowance(len(x), False) for w, x in zip(words, n, strict=True))}
        assert trie.abbreviated(words) == want
        assert trie.shortened(key) == {i for n, i in names.items() if len(n) > 1 and key.startswith("".join(n[:-1])) and stands(key[len("".join(n[:-1])) :], n[-1])}


def test_blocks_of_the_list_change_nothing(spark):
    r = random.Random(14)
    names = ["Aobanotoga", "Aobanotogb", "Aobanotxgz", *{"".join(r.choice("abcd") for _ in range(r.randint(5, 9))) + r.choice(["", " works", " trading"]) for _ in range(40)}]
    reference = spark.createDataFrame([(i, "city", n, None) for i, n in enumerate(names)], "entry_id long, field_key string, canonical string, aliases array<struct<field_key:string,text:string>>")
    typed = ["Aobanotoge", *("".join(c for c in r.choice(names) if r.random() > 0.12) for _ in range(150))]
    values = spark.createDataFrame(list(enumerate(typed)), "k int, text string").withColumn("field", F.lit("city"))
    got = [sorted(map(tuple, canonical.map_values(values, "field", "text", reference, ["k"], block_entries=b).collect())) for b in (50_000, 20, 2)]
    assert got[0] == got[1] == got[2] and got[0][0] == (0, -1, 1) and len(got[0]) == len([t for t in typed if t.strip()])


def test_values_meet_entries(spark):
    reference = spark.createDataFrame([(1, "city", "Aobanotoge", [("city", "XLWM6")]), (2, "city", "鷺碧浜市", None), (3, "brand", "Dolibextek Instruments", []), (4, "job", "Quality Assurance Analyst", [])], "entry_id long, field_key string, canonical string, aliases array<struct<field_key:string,text:string>>")
    cases = [("city", "AOBANOTOGE", 1), ("city", "Aobanotuge", 1), ("city", "xlwm6", 1), ("city", "xlwm7", -1), ("city", "City of Aobanotoge", 1), ("city", "鷺碧浜", 2), ("brand", "Instruments, Dolibextek", 3), ("brand", "Dolibextek Instr.", 3), ("job", "QA Analyst", 4), ("job", "Analyst, Quality Assurance", 4), ("city", "unknown", -1), ("none", "x", -1), ("city", "y" * 5000, -1), ("city", "Аobanotoge", 1)]
    values = spark.createDataFrame([(i, f, t, "clash") for i, (f, t, _) in enumerate(cases)] + [(90, "city", None, ""), (91, "city", "  　", ""), (92, None, "x", "")], "k int, field string, text string, entry_id string")
    for block in (50_000, 2):
        got = {x["k"]: x["entry_id"] for x in canonical.map_values(values, "field", "text", reference, ["k"], block_entries=block).collect()}
        assert got == {i: e for i, (_, _, e) in enumerate(cases)}
    assert canonical.map_values(values.limit(0), "field", "text", reference, ["k"]).count() == 0


# encodings


def test_garbling_is_undone():
    for true, wrong in (("utf-8", "cp1252"), ("utf-8", "cp932"), ("utf-8", "cp1251"), ("utf-8", "mac_roman"), ("utf-8*2", "latin-1"), ("cp932", "latin-1")):
        text = "Größe 請求書" if true != "cp932" else "請求書"
        form = mojibake.garble(text, true, wrong, "keep")
        if form and "�" not in form and wrong != "cp932":
            assert mojibake.undo(form, true, wrong)[0] == text
    assert mojibake.aligned("Mﾃｶwe 1", "Möwe 1") == [("ﾃｶ", "ö")] and mojibake.aligned("a1", "b1") is None


def test_garbled_values(spark):
    clean = [f"{a} {b} {i}" for i, (a, b) in enumerate([("Möwenallee", "Größe"), ("Söhnlein", "Prüfung"), ("équerre", "étanche"), ("株式会社風車", "商事"), ("有限会社風車", "工業"), ("Берёза", "Пак")] * 40)]
    bad = {}
    for i, text in enumerate(clean[::10]):
        true, wrong = [("utf-8", "cp1252"), ("utf-8", "cp932"), ("utf-8", "cp1251")][i % 3]
        bad[f"b{i}"] = (mojibake.garble(text, true, wrong, "keep"), text)
    rows = [(f"c{i}", t) for i, t in enumerate(clean)] + [(k, v) for k, (v, _) in bad.items()] + [("lost", "Gr��e"), ("half", "透明ﾛｰﾗｰ"), ("n", None), ("e", ""), ("a", "plain ascii"), ("long", "é" * 3000)]
    frame = spark.createDataFrame([(k, v, "clash") for k, v in rows], "k string, value string, restored string").drop("restored")
    got = {x["k"]: x["restored"] for x in mojibake.garbled_values(frame, ["k"]).collect()}
    assert "lost" in got and not {k for k in got if k.startswith("c")} and not {"half", "n", "e", "a", "long"} & set(got)
    assert len(set(got) & set(bad)) >= 0.9 * len(bad)
    assert sum(got[k] == bad[k][1] for k in got if k in bad) >= 0.85 * len(bad)
    assert mojibake.garbled_values(frame.limit(0), ["k"]).count() == 0


def test_twins_teach_encodings_no_list_names(spark):
    """A pair of encodings is learned from aligned runs, whichever the interpreter has; a single code page for another is told from it."""
    clean = [f"{a} {i}" for i in range(30) for a in ("Берёза Склад", "Груша Завод", "Слива Насос")] + [f"x{i} Вишня" for i in range(30)]
    bad = {f"b{i}": (mojibake.garble(t, "koi8_r", "mac_cyrillic"), t) for i, t in enumerate(clean[:9])}
    frame = spark.createDataFrame([(f"c{i}", t) for i, t in enumerate(clean * 3)] + [(k, g) for k, (g, _) in bad.items()], "k string, value string")
    got = {x["k"]: x["restored"] for x in mojibake.garbled_values(frame, ["k"]).collect()}
    assert got == {k: t for k, (_, t) in bad.items()}
    assert "koi8_r>mac_cyrillic" in mojibake.explained(bad["b0"][0].split(" ")[0], "Берёза")
    sets = [(frozenset({"utf_8>cp850", "utf_8>cp1252"}), 3), (frozenset({"utf_8>cp1252"}), 2), (frozenset({"koi8_r>cp437"}), 1)]
    assert mojibake.covering(sets, 2) == ["utf_8>cp1252"]


def test_no_twins_are_left_out(spark):
    """Twins are found between any number of values with one stripped text, also if others of it are more and less plausible."""
    words = ["Берёза", "Груша", "Слива", "Вишня", "Яблоня", "Рябина", "Калина", "Осина"]
    bad = {f"b{i}": (mojibake.garble(f"{t} 7", "koi8_r", "mac_cyrillic"), f"{t} 7") for i, t in enumerate(words)}
    common = [f"{a}{b}部 7" for a in "東西南北" for b in "営業経理"]
    rare = ["".join(chr(0x3400 + 97 * i + 31 * j) for j in range(4)) + " 7" for i in range(20)]
    rows = [(f"c{i}", f"{t} 7") for i, t in enumerate(words * 4)] + [(f"m{i}", t) for i, t in enumerate(common * 20)] + [(f"r{i}", t) for i, t in enumerate(rare)] + [(k, g) for k, (g, _) in bad.items()]
    frame = spark.createDataFrame(rows, "k string, value string")
    got = {x["k"]: x["restored"] for x in mojibake.garbled_values(frame, ["k"]).collect()}
    assert got == {k: t for k, (_, t) in bad.items()}


def test_twins_by_bytes_are_those_of_all_pairs(spark):
    r = random.Random(11)
    words = ["Größe", "Möwe", "éta", "株式会社", "風車", "Берёза", "Größé", "検査係", "ë", "灯"]
    ways = [("utf-8", "cp1252"), ("utf-8", "cp932"), ("utf-8", "mac_roman"), ("cp932", "latin-1"), ("cp932", "utf-8"), ("utf-8", "utf-8"), ("utf-8*2", "cp1252"), ("koi8_r", "mac_cyrillic")]
    values = {" ".join((*w, "4")) for a in words for b in words for w in [(a,), (a, b)]}
    for text in sorted(values):
        for _ in range(3):
            true, wrong = r.choice(ways)
            parts = [mojibake.garble(w, true, wrong, "keep") if r.random() < 0.7 else w for w in text.split(" ")]  # some in part
            if None not in parts:
                form = " ".join(parts)
                values.add("".join(mojibake.LOST if not c.isascii() and r.random() < 0.1 else c for c in form))
    groups: dict[str, set[str]] = {}
    for v in values:
        other = " ".join(w for w in v.split(" ") if not w.isascii())
        groups.setdefault("w" + " ".join(w if w.isascii() else mojibake.LOST for w in v.split(" ")), set()).add(v)
        if re.search("[0-9A-Za-z]", letters := re.sub(r"[^\x00-\x7F]", "", other)):
            groups.setdefault(f"c{letters}", set()).add(other)
    want = set()
    for members in groups.values():
        for g in members:
            for c in members:
                if g != c and mojibake.LOST not in c:
                    runs = mojibake.aligned(g, c) or []
                    explained = [mojibake.explained(a, b) for a, b in runs]
                    if explained and (common := set.intersection(*explained)):
                        want.update((g, a, b, tuple(sorted(common))) for a, b in runs)
    frame = spark.createDataFrame([(v,) for v in sorted(values)], "value string")
    for twins in (12, 1, 10_000):
        assert {(x["garbled"], x["run"], x["clean_run"], tuple(x["ways"])) for x in mojibake.twin_runs(frame, twins).collect()} == want
    assert any(mojibake.LOST in g for g, *_ in want) and len({g for g, *_ in want}) > 100
    assert mojibake.twin_runs(frame.limit(0), 12).count() == 0


# personal information


def test_personal_information(spark):
    text = "Please ask for Velda Dostrin when the truck arrives.\nThe driver can be reached under 555-559-8838 until noon.\nPersonal ID: 4821-9921-0034. Mail a.b@x.example now.\nThe goods should go to 12 Lantern Row, Mistford.\nTracking 4404-7218-1072\nContact: Goods-in desk\nTotal due: 12,345,678"
    ja = "担当: 灯野 朔郎。\n電話 090-5555-1234。\n個人番号 1234 5678 9012。住所: 灯崎府霧浜市本橋5-6-7。\n追跡番号 6904-6194-5333"
    rows = spark.createDataFrame([(str(i), t, 1) for i, t in enumerate([text] * 5 + [ja] * 5 + EDGES)], "id string, markdown string, line_no int")
    got = {}
    for x in pii.found_lines(rows, "id", "markdown").collect():
        got.setdefault(x["row_id"], set()).add((x["pii_type"], x["line_no"]))
    assert got["0"] == {("name", 1), ("phone", 2), ("id_number", 3), ("email", 3), ("address", 4)}
    assert got["5"] == {("name", 1), ("phone", 2), ("id_number", 3), ("address", 3)}
    assert set(got) == {str(i) for i in range(10)}
    clean = {x["id"]: x["out"] for x in pii.redact(rows, "id", "markdown", "out").collect()}
    assert clean["0"].split("\n")[0] == "Please ask for [NAME] when the truck arrives." and clean["0"].split("\n")[4:] == text.split("\n")[4:]
    assert clean["10"] is None and clean["11"] == ""
    assert pii.found_lines(rows.limit(0), "id", "markdown").count() == 0


def test_redaction_by_place():
    text = "Please ask for Bo Rut and Bo Rutger.\nBo Rut, or Vel-\nda Ｄos\u200btrin　here"
    joined, _ = pii.view(text)
    spans = [("name", m, m + len(w)) for w in ("Bo Rut", "Velda Dostrin") for m in [joined.index(w)]]
    assert pii.replaced(text, spans) == "Please ask for [NAME] and Bo Rutger.\nBo Rut, or [NAME]\n　here"
    r = random.Random(16)
    for _ in range(300):
        text = "".join(r.choice("abＡé\u0301 \u200bｶﾞ漢\n-") for _ in range(30))
        joined, _ = pii.view(text)
        assert pii.replaced(text, []) == text
        plainest, spans = plainform.traced(text)
        assert plainest == plainform.plain(text) and len(spans) == len(plainest) and all(a < b for a, b in spans)


def test_lists_find_names_without_cues(spark):
    given, surnames = ["Velda", "Morin", "Tessa", "Ruvo"], ["Dostrin", "Halbek", "Orfelt"]
    rows = [(str(k), f"Please ask for {g} {s} at noon.") for k, (g, s) in enumerate([(g, s) for g in given for s in surnames] * 4)]
    rows += [("free", "Yesterday Velda Halbek came to the warehouse."), ("turned", "It was Halbek, Velda who came."), ("none", "The Velda Works came, and Quality Assurance too."), ("half", "It was Velda Brune who came.")]
    frame = spark.createDataFrame(rows, "id string, markdown string")
    got = {(x["row_id"], x["pii_type"]) for x in pii.found_lines(frame, "id", "markdown").collect()}
    assert {("free", "name"), ("turned", "name")} <= got and not {("none", "name"), ("half", "name")} & got and len(got) == 50


def test_view_joins_and_keeps_lines():
    joined, at = pii.view("Rook-\ncroft is\nhere.\n\n連絡\n先は　Ａ")
    assert joined == "Rookcroft is here.\n\n連絡先は A" and at[:4] == [1] * 4 and at[4] == 2
    assert len(joined) == len(at)


# scan noise


def test_scan_noise(spark):
    r = random.Random(12)
    words = ["membrane", "delivery", "quantity", "shipment", "supplier", "inspection", "certificate", "warehouse", "document", "reminder"]
    swap = {"e": "c", "t": "f", "l": "1"}
    rows, want = [], {}
    for k in range(400):
        body = [r.choice(words) for _ in range(14)]
        clean = " ".join(body)
        kinds = set()
        if k % 5 == 0:
            w = next(w for w in body if any(c in w for c in swap))
            c = next(c for c in w if c in swap)
            clean = clean.replace(w, w.replace(c, swap[c], 1), 1)
            kinds.add("misread")
        if k % 7 == 0:
            clean += "\nthe ship-\nment was whole"
            kinds.add("hyphenation")
        n = k % 2 + 1
        if k % 4 < 2:
            clean = f"Norbris Logistics - Invoice QT-{k // 2:05d}-123\n" + clean
            kinds.add("running_header")
        if k % 3 == 0:
            clean += f"\n\n- {n} -"
            kinds.add("page_number")
        rows.append((f"r{k}", f"p{k}", f"d{k // 2}", n, 2, clean))
        want[f"r{k}"] = kinds
    rows += [(f"e{i}", "pe", None, None, None, t) for i, t in enumerate(EDGES)]
    frame = spark.createDataFrame(rows, "row_id string, page string, doc string, page_number int, pages int, text string").withColumn("kind", F.lit("clash"))
    got = {}
    for x in scannoise.noise(frame).collect():
        got.setdefault(x["row_id"], set()).add(x["noise"])
    for kind in ("hyphenation", "running_header", "page_number", "misread"):
        a, b = {k for k, v in want.items() if kind in v}, {k for k, v in got.items() if kind in v}
        assert len(a & b) >= 0.9 * len(a) and len(b - a) <= 0.05 * len(a) + 1, (kind, len(a), len(b), len(a & b))
    assert scannoise.noise(frame.limit(0)).count() == 0
    fixed = {x["row_id"]: x["out"] for x in scannoise.repair(frame, "out").collect()}
    assert "shipment was whole" in fixed["r0"] and "QT-" not in fixed["r0"] and "- 1 -" not in fixed["r0"]
    assert fixed["e0"] is None and fixed["e1"] == ""


def test_every_page_read_twice_is_counted(spark):
    """The evidence covers pages with any number of results, however many pages there are."""
    rows = [(f"p{k}", text) for k in range(300) for text in ("whole delivery", "whole dclivery")]
    rows += [("often", "whole delivery")] * 24 + [("often", "whole dclivery"), ("once", "whole dclivery"), (None, "whole dclivery"), (None, "whole delivery")]
    pairs = spark.createDataFrame([("wdclivery", "wdelivery")], "seen string, meant string")
    frame = spark.createDataFrame([(str(i), p, sum(q == p for q, _ in rows) if p else 1, sorted(scannoise.tokens(t))) for i, (p, t) in enumerate(rows)], "row_id string, page string, results long, tokens array<string>")
    assert [tuple(r) for r in scannoise.labelled(frame, pairs).collect()] == [("wdclivery", "wdelivery", 301, 0)]


def test_every_frequent_character_between_neighbours_is_a_candidate(spark):
    counted = spark.createDataFrame([(f"c^{c}の", n) for c, n in (("念", 414), ("書", 27), ("日", 23), ("本", 21), ("中", 18), ("票", 14), ("木", 2))], "token string, n long")
    pairs = scannoise.candidate_pairs(counted).filter("seen = 'c^木の'")
    assert {r["meant"][2] for r in pairs.collect()} == set("念書日本中")


def test_boosted_trees_learn():
    import numpy as np

    r = np.random.default_rng(1)
    x = r.normal(size=(2000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    model = scannoise.Boosted(x[:1500], y[:1500], np.ones(1500))
    assert ((model.probability(x[1500:]) > 0.5) == y[1500:]).mean() > 0.9


# queries


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, small, name):
    got = registry.queries()[name](spark, small)
    rows = got.collect()
    assert got.columns and (len(set(map(str, rows))) == len(rows))
    if name == "p8_ids":
        assert len(rows) == spark.read.parquet(f"{small}/documents.parquet").count()
