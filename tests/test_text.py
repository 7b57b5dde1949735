import hashlib
import json
import re

import pytest
from pyspark.sql import functions as F

from itembank.functions import ocr
from itembank.functions import text as tx


def values(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


STEMS = [
    ("12.选出正确的一项", "12", "选出正确的一项"),
    ("第 8 题：看材料", "8", "看材料"),
    ("【31-33 为题组】31. 背景", "31", "背景"),
    ("【题组 31-33】背景\n32.请作答", "32", "背景\n请作答"),
    ("6-磷酸葡萄糖", "6", "6-磷酸葡萄糖"),
    ("2 分子丙酮酸", "2", "2 分子丙酮酸"),
    ("4.5%的盐水", "4", "4.5%的盐水"),
    ("1998年的实验", "98", "1998年的实验"),
    ("步骤如下\n2.加热", "2", "步骤如下\n2.加热"),
    ("41.别的题号", "40", "41.别的题号"),
    ("7.\n下一行", "7", "7.\n下一行"),
    ("第3题:\n下一行", "3", "第3题:\n下一行"),
    ("  ５．宽数字", None, "  宽数字"),
    ("9、无题号", None, "无题号"),
    ("【1-2 为题组】甲\n第 2 题、乙\n2.丙", "2", "甲\n乙\n2.丙"),
]


@pytest.mark.parametrize("chunk", [STEMS])
def test_clean_stem(spark, chunk):
    got = values(spark, [(s, n) for s, n, _ in chunk], "s string, n string", tx.clean_stem("s", F.col("n")))
    assert [g[0] for g in got] == [e for _, _, e in chunk]


def test_normalize_stem_keeps_the_removed_number(spark):
    stem, number = tx.normalize_stem("s", F.col("n"))
    got = values(spark, [("5.题", None), ("5.题", "5"), ("题", None)], "s string, n string", stem, number)
    assert got == [("题", "5"), ("题", None), ("题", None)]


def test_keys_keep_case_but_not_space(spark):
    got = values(spark, [("B 基因",), ("b　基 因",), (None,)], "s string", tx.ws_key("s"))
    assert got == [("B基因",), ("b基因",), ("",)]


def test_dedupe_key_modes(spark):
    rows = [("3.5%溶液", ["10", "20"]), ("第2题 选项", ["A"]), ("2.选项", ["A"]), ("，。", [])]
    got = values(spark, rows, "s string, o array<string>", tx.dedupe_key("s", "o"), tx.dedupe_key("s", "o", compat=True))
    assert got == [("35%溶液|1020", "%溶液|"), ("选项|a", "选项|a"), ("选项|a", "选项|a"), ("|", "|")]


def test_options(spark):
    rows = [(["A. 甲", "Ｂ．乙", " C)丙", "(D) 丁", " "],)]
    got = values(spark, rows, "o array<string>", tx.clean_options("o"), tx.clean_option_text("o"))
    assert got == [(["甲", "乙", "丙", "(D) 丁", ""], ["甲", "Ｂ．乙", "丙", "丁"])]


def test_embedded_options(spark):
    rows = [
        ("下列判断\nA.一\nB.二\nC.三\nD.四", []),
        ("题\nA.一\nB.二", ["A. 一", "B. 二"]),
        ("题\nA.一\nB.二", ["另一", "二"]),
        ("题\nA.一\nC.二", []),
        ("无提示\nA.一\nB.二\nC.三\nD.四", []),
    ]
    got = values(spark, rows, "s string, o array<string>", tx.split_embedded_options("s", "o").alias("x"))
    out = [(g[0]["stem"], g[0]["options"], g[0]["split"]) for g in got]
    assert out[0] == ("下列判断", ["一", "二", "三", "四"], True)
    assert out[1] == ("题", ["A. 一", "B. 二"], True)
    assert [o[2] for o in out[2:]] == [False, False, False]


def test_answers(spark):
    rows = [("Ｔ、Ｆ，t", "判断正误", ["a", "b", "c"]), ("AC", "逐项判断", []), ("TF", "正误", ["a"]), (" 见解析 ", "其他", [])]
    norm = tx.normalize_answer("a")
    got = values(spark, rows, "a string, s string, o array<string>", norm, tx.format_flags("s", "o", norm))
    assert got == [("TFT", []), ("AC", [tx.FLAG_NOT_TF]), ("TF", [tx.FLAG_TF_COUNT]), ("见解析", [])]


def test_tags(spark):
    got = values(spark, [("#甲，乙 甲,##丙",)], "t string", tx.tag_list("t"), tx.format_remark(tx.tag_list("t"), F.lit(" 因 "), F.lit("注")))
    assert got == [(["甲", "乙", "丙"], "#甲 #乙 #丙\n因\n[人工补充]\n注")]
    empty = F.array().cast("array<string>")
    assert values(spark, [(1,)], "x int", tx.merge_tags(empty, empty)) == [(["其他"],)]


def test_fingerprint_and_identity_equal_the_json_form(spark):
    stem, opts = "2.题 干", ['A. 一"', "B. \\二\n三"]
    text = re.sub(r"\s+", "", "题 干" + json.dumps(['一"', "\\二\n三"], ensure_ascii=False))
    ident = json.dumps(["h", "2", None, stem], ensure_ascii=False)
    got = values(
        spark, [(stem, opts)], "s string, o array<string>", tx.fingerprint("s", "o"),
        tx.identity(F.lit("h"), F.lit("2"), F.lit(None).cast("string"), "s"),
    )
    assert got == [(hashlib.sha256(text.encode()).hexdigest(), hashlib.sha256(ident.encode()).hexdigest())]


def test_titles(spark):
    got = values(spark, [("２０２４ 期末卷（参考答案与解析）",), ("a/b/期中 试题-答案及解析.pdf",)], "t string", tx.title_key("t"), tx.group_name("t"))
    assert got[0][0] == "2024期末卷" and got[1][1] == "期中"


def test_casefold_corpus(spark):
    rows = [("Straße", ["Σίγμας"], ["T"], None)]
    got = values(spark, rows, "s string, o array<string>, t array<string>, r string", tx.select_corpus("s", "o", "t", "r"), tx.select_corpus("s", "o", "t", "r", compat=True))
    doc = json.dumps({"stem": "Straße", "options": ["Σίγμας"], "category_tags": ["T"], "remark": None}, ensure_ascii=False)
    assert got == [("\n".join(["Straße", "Σίγμας", "T"]).casefold(), doc.casefold())]


def test_model_json(spark):
    rows = ['```json\n{"a":1}\n```', 'x {"a":2} y', '[{"a":3}]', "none", "", '{"a":4'], None
    got = values(spark, [(r,) for r in rows[0]] + [(None,)], "r string", F.try_variant_get(tx.parse_model_json("r"), "$.a", "int"))
    assert [g[0] for g in got] == [1, 2, None, None, None, None, None]
    items = F.size(tx.model_items(F.try_parse_json("r")))
    got = values(spark, [('{"items":[1,2]}',), ("[1]",), ('{"kind":"question"}',), ('{"x":1}',)], "r string", F.coalesce(items, F.lit(-1)))
    assert [g[0] for g in got][:3] == [2, 1, 1] and got[3][0] in (-1, None)


def test_secrets(spark):
    got = values(spark, [("key sk-123456789 end",)], "t string", tx.redact("t", ["sk-123456789"], "[x]"), tx.leaks("t", ["sk-123456789", "key"]), tx.mask_key(F.lit("abcdefghijk")))
    assert got == [("key [x] end", 1, "abcd...hijk")]


def test_regions(spark):
    rows = [(1, [10.0, 20.0, 200.0, 300.0]), (9, [10.0, 20.0, 200.0, 300.0]), (1, [10.0, 20.0, 18.0, 300.0]), (1, [0.0, 1.0, 1001.0, 3.0]), (1, [1.0]), (1, [0.0, 1.0, float("nan"), 3.0])]
    got = values(spark, rows, "p int, b array<double>", tx.region_error("p", "b", F.array(F.lit(1), F.lit(2))))
    assert [g[0] for g in got] == [None, "page", "span", "bounds", "shape", "shape"]


PATCHES = [
    ("线粒体内膜发生氧化", "线粒体内膜发生氧化磷酸", "氧化", "stem", "3", None),
    ("角质形成的细胞层", "角质成的细胞层", "角质", "stem", "14", None),
    ("ATP 水鮮放出能量供给反应", "ATP 水解放出能量供给反应", "水鮮", "options[0]", "1", "ATP 水解放出能量供给反应"),
    ("ATP 水鮮放出能量供给反应", "ATP 水解放出能量供给反应", "能量", "options[0]", "1", None),
    ("没有改动的一行文字", "没有改动的一行文字", "改动", "stem", "1", "没有改动的一行文字"),
]


def test_safe_patch(spark):
    df = spark.createDataFrame([p[:5] for p in PATCHES], "b string, a string, q string, f string, n string")
    got = [r[0] for r in df.select(ocr.safe_patch("b", "a", "q", F.col("f"), F.col("n"))).collect()]
    assert got == [p[5] for p in PATCHES]


B = [15, 25, 210, 310]
GOOD = [{"regions": [{"page": 4, "bbox": B}]}, [{"page": 4, "bbox": B}], {"page": 4, "bbox": B}, [{"regions": [{"page": 4, "bbox": B}]}],
        [{"page_name": "第4页", "bbox_2d": B}], [{"page": "4", "page_name": "第 4 页", "bbox": B, "bbox_2d": B}], [{"bbox": B}]]
BAD = [([{"page": "88", "bbox": B}], [4]), ([{"page": "4/88", "bbox": B}], [4, 5]), ([{"page": 4, "page_name": "第5页", "bbox": B}], [4, 5]),
       ([{"page": None, "bbox": B}], [4]), ([{"page": True, "bbox": B}], [1]), ([{"page_": 88, "bbox": B}], [4]), ([{"bbox": B}], [4, 5]),
       ([{"regions": [{"regions": [{"page": 4, "bbox": B}]}]}], [4]), ({"regions": []}, [4]), ({"regions": "x"}, [4]), ([{"page_4": {"regions": []}}], [4]),
       ([{"page": 4, "bbox": B, "bbox_2d": [1, 2, 3, 4]}], [4]), ([{"page": 4, "bbox": B}] * 3, [4]), ([{"page": 4, "bbox": [0, 1, float("nan"), 3]}], [4]),
       ([{"page": 4, "bbox": [0, 1, 1001, 3]}], [4]), ([{"page": 4, "bbox": [False, 1, 2, 3]}], [4]), ([{"page": 4, "bbox": [2, 1, 0, 3]}], [4]), ({"x": 1}, [4])]


def test_locator_rows(spark):
    rows = [(json.dumps(g), [4]) for g in GOOD] + [(json.dumps(b), p) for b, p in BAD] + [("not json", [4])]
    got = [r[0] for r in spark.createDataFrame(rows, "r string, p array<int>").select(ocr.locator_rows("r", "p")).collect()]
    for r in got[: len(GOOD)]:
        assert r["error"] is None and [(x["page"], x["bbox"]) for x in r["regions"]] == [(4, [float(x) for x in B])]
    assert all(r["error"] is not None and r["regions"] is None for r in got[len(GOOD):])


def test_locator_rows_parse_a_reply_a_set_number_of_times(spark):
    plan = spark.createDataFrame([], "r string, p array<int>").select(ocr.locator_rows("r", "p"))._jdf.queryExecution().optimizedPlan().toString()
    assert 1 <= plan.count("from_json") <= 20
