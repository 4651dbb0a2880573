"""Cleaning, predicates, scores, formats and metrics on small rows."""

import random

import pytest
from pyspark.sql import functions as F

from dialoom.functions import chat, clean, metrics, predicates as P, scoring


def one(spark, expression, **values):
    schema = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(expression.alias("x")).first()[0]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("  你好　世界\t", "你好世界"),
        ("“好”—…\\", '"好"-.'),
        ("电话 13812345678 吧", "电话 <PHONE> 吧"),
        ("电话13812345678", "电话13812345678"),
        ("单 123456789", "单 <ID>"),
        ("好。。！！", "好！"),
        ("", ""),
        ("   ", ""),
        ("iPhone 12 很 好 3 个", "iPhone 12很好3个"),
        ("中 abc 中", "中 abc 中"),
        ("𠮷 野 家", "𠮷 野家"),
    ],
)
def test_clean_turn(spark, text, want):
    assert one(spark, clean.clean_turn("t"), t=text) == want


def test_keys(spark):
    assert one(spark, clean.mask_key("t"), t="2015年买了3件") == "<YEAR>买了<NUM>件"
    assert one(spark, clean.template_key("t"), t="您好，亲 3件 可以的哦～") == "<NUM>件可以的"
    assert one(spark, clean.template_key("t"), t="您亲好") == ""  # one deletion makes the next possible


def test_document_cleaning(spark):
    assert one(spark, clean.clean_document("t"), t="买家: 你 好\r\n\r\n\r\n卖家：3 - 5 天 ，行") == "用户：你好\n客服：3-5天，行"
    assert one(spark, clean.light_clean("t"), t="﻿a:b  c\r\n\n\n\nd") == "a：b c\n\nd"
    assert one(spark, clean.repair_clean("t"), t=None) == ""
    assert one(spark, clean.repair_clean("t"), t="客服：好\n\n买家: 行") == "好\n行"
    assert one(spark, clean.without_masks("t"), t="，一个 ID <PHONE>，") == "一个账号"
    assert one(spark, clean.without_task("t"), t="请根据下面的电商客服历史对话，生成下一句合适的客服回复。\n用户：a") == "用户：a"


def test_outputs(spark):
    assert one(spark, clean.clean_output("t"), t="好的<|im_end|>再见") == "好的"
    assert one(spark, clean.clean_output("t"), t="好😀的 hello") == "好的"
    assert len(one(spark, clean.clean_output("t", 10), t="一" * 30)) == 10
    assert len(one(spark, clean.clean_output("t", 0), t="一" * 80)) == 80
    row = one(spark, clean.trim_tail("t"), t="可以的，请核对一下收货地址，请核对一下收货地址")
    assert row["text"] == "可以的" and row["issues"] == ["dedup_address_tail", "trim_address_tail"]
    assert one(spark, clean.cell("t"), t="a|b\nc") == "a\\|b c"
    assert one(spark, clean.optional_path("t"), t=" None ") is None


def test_predicates(spark):
    assert one(spark, P.is_garbage("t"), t="！！。") and one(spark, P.is_garbage("t"), t="hello") and not one(spark, P.is_garbage("t"), t="你好ab")
    assert one(spark, P.is_low_info("t"), t="好的。") and not one(spark, P.is_low_info("t"), t="运费我们承担")
    assert one(spark, P.has_role_leak("t"), t="a\n客服：b") and not one(spark, P.has_role_leak("t"), t="客服b")
    assert one(spark, P.clause_count("t"), t="a，b。。c") == 3
    assert one(spark, P.is_fragment("t"), t="嗯嗯嗯嗯")
    assert one(spark, P.keep_reason("c", "t", 2), c=["a"], t="好的好的好的") == "too_few_turns"
    assert one(spark, P.keep_reason("c", "t", 1), c=["a"], t=None) == "too_short"
    assert not one(spark, P.valid_pair("a", "b"), a=" x", b="x ")
    assert one(spark, P.unasked_topics("a", "b"), a="颜色呢", b="券可以领，今天发货") == ["promo", "shipping"]


def test_scores(spark):
    row = one(spark, scoring.context_score("c"), c=["这个怎么退款？", "好", "多久到账呢？"])
    assert row["score"] > 0 and row["issues"] == []
    assert one(spark, scoring.context_score("c"), c=["嗯"])["issues"] == ["weak_last_user_query", "very_weak_last_user_query"]
    good = one(spark, scoring.positive_score("c", "t"), c=["退款多久到账呢？"], t="退款一般三天内到账，已经帮您登记退款了")
    assert good["rejected"] is None and good["score"] > 0
    assert one(spark, scoring.positive_score("c", "t"), c=["x"], t="嗯")["rejected"] is not None
    assert one(spark, scoring.positive_score("c", "t", scoring.Mode(strict=True, sft=True)), c=["退款？"], t="我们保证马上退款的哦亲")["score"] == scoring.REJECTED
    assert one(spark, scoring.negative_score("c", "t", "p"), c=["退款？"], t="退款 可以", p="退款可以")["score"] == scoring.REJECTED
    assert one(spark, scoring.occurrences(F.col("t"), "亲"), t="亲亲亲a") == 3


def test_formats(spark):
    assert one(spark, chat.task_prompt("c"), c=["a", "b"]).endswith("用户：a\n客服：b\n客服：")
    assert one(spark, chat.open_prompt("c"), c=["a", ""]) == "用户：a\n客服："
    turns = one(spark, chat.parse_turns("t"), t="前言用户：a\n客服：b用户：")
    assert [(m["role"], m["content"]) for m in turns] == [("user", "a"), ("assistant", "b")]
    turns = one(spark, chat.prefixed_dialogue("t"), t="开头\n用户：a\n接着\n客服：b")
    assert [(m["role"], m["content"]) for m in turns] == [("user", "开头"), ("user", "a\n接着"), ("assistant", "b")]
    assert one(spark, chat.lines_to_context("t"), t="用户：a\n b \n客服: c") == ["a", "b", "c"]
    for text, mode, want in (("x", "im_end", "x<|im_end|>"), ("x<|im_end|>", "both", "x<|im_end|>"), ("x ", "both", "x<|im_end|><|endoftext|>")):
        assert one(spark, chat.terminated(F.col("t"), mode), t=text) == want
    assert one(spark, chat.terminated(F.col("t"), "eos", True), t="x<|im_end|>") == "x<|endoftext|>"
    assert one(spark, chat.model_label("t"), t="a/b/") == "b"


def test_messages(spark):
    rows = [([("User ", "hi"), ("assistant", "yo")],), ([("system", "s"), ("user", "")],), (None,), ([("user", "a")],)]
    df = spark.createDataFrame(rows, f"messages {chat.MESSAGES}")
    out = [r[0] for r in df.select(chat.prompt_completion("messages")).collect()]
    assert out[0]["completion"] == "yo<|im_end|>" and out[0]["prompt"].startswith("<|im_start|>system\n") and out[1:] == [None, None, None]
    assert chat.convert_rows(df).count() == 1
    alpaca = spark.createDataFrame([("i", "用户：a", "b"), ("i", "用户：a", " ")], "instruction string, input string, output string")
    assert chat.convert_rows(alpaca).count() == 1
    pref = spark.createDataFrame([("用户：a", "x", "y"), ("用户：a", "x", "x"), ("客服：a", "x", "y")], "prompt string, chosen string, rejected string")
    assert chat.convert_preferences(pref).count() == 1


def test_tokens(spark):
    df = spark.createDataFrame([(list(range(10)), [1, 2, 3])], "p array<int>, c array<int>")
    fit = df.select(chat.fit_tokens(F.col("p"), F.col("c"), 6).alias("x")).first()[0]
    assert fit["prompt"] == [7, 8, 9] and fit["completion"] == [1, 2, 3]
    pad = df.select(chat.padded(F.col("c"), F.col("c"), 8).alias("x")).first()[0]
    assert pad["input_ids"] == [1, 2, 3, 1, 2, 3, 0, 0] and pad["labels"] == [-100] * 3 + [1, 2, 3] + [-100] * 2


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        old = row[:]
        for j, y in enumerate(b):
            row[j + 1] = old[j] + 1 if x == y else max(old[j + 1], row[j])
    return row[-1]


def test_metrics(spark):
    rnd = random.Random(3)
    rows = [("".join(rnd.choice("ab中") for _ in range(rnd.randint(0, 9))), "".join(rnd.choice("ab中") for _ in range(rnd.randint(0, 9)))) for _ in range(60)] + [("", ""), (None, "a")]
    df = spark.createDataFrame(rows, "a string, b string")
    got = df.select("a", "b", metrics.lcs_text("a", "b").alias("u"), metrics.char_f1("a", "b").alias("f"), metrics.rouge_l("a", "b").alias("r")).collect()
    for r in got:
        want = lcs(r.a or "", r.b or "")
        assert r.u == want
        assert (r.f > 0) == bool(set(r.a or "") & set(r.b or ""))
    assert df.where("a = b and a <> ''").select(metrics.char_f1("a", "b")).distinct().count() <= 1
