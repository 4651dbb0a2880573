"""Problems 1 and 2 against brute force on small rows."""

import unicodedata
from itertools import combinations

from dialoom.llm import copies, lookalike
from dialoom.llm.forms import Fold

SCHEMA = "line_no long, context array<string>, response string, look string, hash long, first int"


def frame(spark, rows):
    return spark.createDataFrame([(i, c, r, "x", 1, 2) for i, c, r in rows], SCHEMA)


def test_forms():
    fold = Fold({(0, "^H"): 5, (0, "He"): 5, (2, "^О"): 5, (2, "ОК"): 5})
    same = [("Нello", "Hello"), ("ВТ-52", "BT-52"), ("ＡＢＣ，１２！", "ABC,12!"), ("⽼板不", "老板不"), ("Café", "Café"), ("Vе́lo", "Vélo"), ("a‍b\xad", "ab"), ("a　b c", "a b c"), ("a\r\nb", "a\nb"), ("ﬁn", "fin"), ("Ⅳ", "IV"), ("ǆ", "dž"), ("한", "한")]
    for a, b in same:
        assert fold(a) == fold(b) == unicodedata.normalize("NFC", b), (a, b)
    different = [("a b", "ab"), ("A", "a"), ("é", "e"), ("①", "1"), ("²", "2"), ("a\tb", "a b"), ("a ", "a"), ("Да", "Da"), ("。", ".")]
    for a, b in different:
        assert fold(a) != fold(b), (a, b)
    assert fold("Да, ОК") == "Да, ОК" and fold(None) == "" and len(fold("Ｘ" * 100_000)) == 100_000


def test_pairs(spark):
    rows = [(1, ["Hi"], "ok"), (2, ["Нi"], "ok"), (3, ["Hi"], "ok"), (4, ["Hi "], "ok"), (5, None, None), (6, [], ""), (7, ["​"], None), (8, [""], ""), (9, [None], ""), (10, ["Hi", ""], "ok")]
    fold = Fold({})
    shown = {i: ([fold(t) for t in c or []], fold(r)) for i, c, r in rows}
    raw = {i: ([t or "" for t in c or []], r or "") for i, c, r in rows}
    want = {(a, b) for a, b in combinations(sorted(shown), 2) if shown[a] == shown[b] and raw[a] != raw[b]}
    got = {(r.line_no_a, r.line_no_b) for r in lookalike.look_alike_pairs(frame(spark, rows)).collect()}
    assert got == want == {(1, 2), (2, 3), (7, 8), (7, 9)}
    links = {r.line_no: (r.class_line_no, r.links) for r in lookalike.look_alike_classes(frame(spark, rows)).collect()}
    assert links == {i: (min(j for j in shown if shown[j] == shown[i]), sum(i in p for p in want)) for i in {x for p in want for x in p}}
    assert lookalike.look_alike_pairs(frame(spark, rows).where("false")).count() == 0
    out = {r.line_no: r.response for r in lookalike.normalize_columns(frame(spark, rows), ["context", "response"]).collect()}
    assert out[5] is None and out[2] == "ok"


def test_copies(spark):
    card = "[订单] 商品=杯|颜色=红|规格=L|数量=2"
    other = "【订单】\n数量：2\n规格：L\n颜色：红\n商品：杯"
    rows = [(1, ["你好，在吗？"], "好的。"), (2, ["你 好在吗"], "好 的！！"), (3, ["你好，在吗？"], "好的①"), (4, [card], "ok"), (5, [other], "OK~"), (6, ["a"], "？"), (7, ["A"], "?"), (8, ["a"], "？"), (9, None, None), (10, [], ""), (11, ["café"], "x"), (12, ["cafe"], "x")]
    # Enough cards for their field names to be learnt.
    rows += [(100 + i, [f"[订单] 商品=物{i}|颜色=蓝|规格=M|数量={i}|单号=9{i}"], f"r{i}") for i in range(20)]
    got = {(r.first_line_no, r.copy_line_no) for r in copies.copies(frame(spark, rows)).collect()}
    assert got == {(1, 2), (4, 5), (6, 8), (9, 10)}
    whole = copies.collapse(frame(spark, rows).selectExpr("*", "0 AS n_copies"))
    assert {r.line_no: r.n_copies for r in whole.where("n_copies > 1").collect()} == {1: 2, 4: 2, 6: 2, 9: 2}
    assert copies.copies(frame(spark, rows).where("false")).count() == 0


def test_rare_cards_beside_a_hot_card(spark):
    """Names of a rare card count, however often and in how many forms others stand."""
    hot = [(i, ["[订单] 商品=杯|颜色=红|规格=L|数量=2|实付=9"], f"r{i}") for i in range(10, 400)]
    other = [(1000 + i, [f"[订单] 商品=物{i}|颜色=蓝|规格=M|数量={i}|实付={i}"], "x") for i in range(100)]
    rare = [(1, ["[订单] 商品=杯|颜色=红|收件人=甲|电话=5|地址=某处"], "ok"), (2, ["[订单] 地址：某处\n电话：5\n商品：杯\n收件人：甲\n颜色：红"], "ok")]
    df = frame(spark, hot + other + rare)
    assert set(copies.field_names(df)) >= {"收件人", "电话", "地址"}
    assert {(r.first_line_no, r.copy_line_no) for r in copies.copies(df).collect()} == {(1, 2)}


def test_a_set_over_many_partitions(spark):
    rows = [(i, ["same"], "text") for i in range(500)] + [(1000 + i, [f"t{i}"], "x") for i in range(200)] + [(2000, ["T0"], "x")]
    sets = copies.copy_sets(frame(spark, rows), partitions=16)
    firsts = {r.line_no: r["first"] for r in sets.collect()}
    assert len(firsts) == 701 and all(firsts[i] == 0 for i in range(500)) and firsts[2000] == 1000
