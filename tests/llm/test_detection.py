"""Problems 4, 5, 7 and 10 on written cases and held-out rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from dialoom.llm import pairs, privacy, residue, spam

RESIDUE = [
    "满{{金额}}元可用", "按实付[金额]元开", "%s您好，您的单号是%s", "到____大概3天", "您咨询的null已经为您查询，结果为undefined", "TODO 待补充", "请在此填写答复", "xxx，xxx，xxx", "测试测试测试", "aaaa bbbb cccc", "jhsgggfl fafkd", "Lorem ipsum dolor sit",
    "HTTP/1.1 503 Service Unavailable", "Traceback (most recent call last): KeyError 'a'", "系统繁忙，请稍后再试（错误码：E1303）", "很抱歉，当前页面出现异常，请刷新页面", '{"code":500,"msg":"internal error"}',
    "请先允许运行JavaScript以继续浏览", "You need to enable scripts for this site.", "<noscript>需要启用脚本才能显示聊天内容</noscript>", "第《插入数量》步", "备注:color:袋子就行",
]
ORDINARY = [
    "<ID>这单已经登记了", "拨打<PHONE>就能联系到站点", "[图片] 您看是这个边角吗", "[微笑]不客气的", "系统繁忙的时候晚13分钟再提交就好", "链接打开是404的话换个浏览器再试下哦", "浏览器要开脚本才能看尺码助手，手机上不用", "示例图里的是炭黑，您收到的也是", "模板是M的，按纸样剪就行", "尺码S/M/XXL都有现货", "页面@客服也没人回", "", None, "~",
]


def test_residue(spark):
    rows = [("candidate", i, t) for i, t in enumerate(RESIDUE + ORDINARY)]
    df = spark.createDataFrame([(k, i, t, "x") for k, i, t in rows], "record_kind string, record_id long, text string, sort string")
    found = residue.residue(df)
    got = {r.record_id for r in found.collect()}
    assert [RESIDUE[i] for i in range(len(RESIDUE)) if i not in got] == []
    assert [(RESIDUE + ORDINARY)[i] for i in got if i >= len(RESIDUE)] == []
    assert residue.without_residue(df, found).count() == len(ORDINARY)
    assert residue.residue(df.where("false")).count() == 0


def test_rare_names(spark):
    """A name that is rarer than 500 others is recognised in a mistakable marker."""
    texts = [f"值{{{{name{chr(97 + i // 26)}{chr(97 + i % 26)}}}}}元" for i in range(600)]
    rows = [*enumerate(texts * 2), (5000, "值{{zz_rare}}元"), (5001, "谢谢[zz_rare]光临")]
    df = spark.createDataFrame([("candidate", i, t) for i, t in rows], "record_kind string, record_id long, text string")
    assert "zz_rare" in residue.marker_names(df)
    assert residue.residue(df).where("record_id = 5001").count() == 1


PERSONAL = [
    ("资料发我邮箱north.12@letters.test", {"email"}), ("发票寄到lan_7 at mailbox dot com dot example了", {"email"}), ("手机号是１６０５２４５４９６４", {"phone"}), ("电话一六八六八三二五一七一，到了打我", {"phone"}), ("Call me on +1 555-0111", {"phone"}), ("电话:(+44) 7700 900910", {"phone"}),
    ("身份证119901200107179393", {"idnum"}), ("证件是000-66-8169", {"idnum"}), ("改送到锦澜花园8栋1单元1023，柏台区三槐巷12号", {"address"}), ("Ship it to Flat 3, 12 Tern Hill, Pinder Falls", {"address"}), ("收件人：岑澈昀", {"name"}), ("My name is Saskia Quillane.", {"name"}),
    ("客服热线400-090-9915看到了", set()), ("单号是86745306686971", set()), ("流水 318479651299501655", set()), ("取件码 10-3-2013", set()), ("规格 12-9-17mm", set()), ("页面@客服也没人回", set()), ("我这边是禾丰市", set()), ("店名叫裘记静音梳子", set()), ("The card is charged at checkout. Hello", set()), (None, set()), ("", set()),
]


def test_personal_data(spark):
    names = [(1000 + i, ["登记在岑澈名下的", "我叫岑昀"], "ok") for i in range(4)]
    rows = [(i, [t, None], "好的") for i, (t, _) in enumerate(PERSONAL)] + [(900, None, "发到a@b.test就好，岑澈昀收")] + names
    df = spark.createDataFrame(rows, "line_no long, context array<string>, response string")
    got = {}
    for r in privacy.personal_data(df).collect():
        got.setdefault((r.line_no, r.turn_no), set()).add(r.kind)
    for i, (text, kinds) in enumerate(PERSONAL):
        assert got.get((i, 0), set()) == kinds, text
        assert (i, -1) not in got and (i, 1) not in got
    assert got[900, -1] == {"email", "name"}
    masked = {r.line_no: r for r in privacy.sanitize(df).collect()}
    assert masked[0].context == ["资料发我邮箱<EMAIL>", None] and masked[900].context is None and masked[900].response == "发到<EMAIL>就好,<NAME>收"
    assert privacy.personal_data(df.where("false")).count() == 0 and privacy.sanitize(df.where("false")).count() == 0


def test_sure_names_with_blanks(spark):
    """Surnames that are seen once: only the field tells that it is a name."""
    texts = ["[订单] 商品=杯|收件人=岑栀|数量=2", "【订单】\n商品：杯\n收件人：郁 淙\n数量：2", "登记在裘栀名下 收到了", "订单 联系人：阮澈\t，谢谢", "联系人：冼苒", "包裹 签收的是桑蘅本人", "你好 我叫简岑栀，谢谢"]
    df = spark.createDataFrame([(i, [t], "好") for i, t in enumerate([*texts, "等下 我叫他来拿。", "今天已经发货请留意物流谢谢" * 30])], "line_no long, context array<string>, response string")
    assert sorted((r.line_no, r.kind) for r in privacy.personal_data(df).collect()) == [(i, "name") for i in range(len(texts))]
    masked = {r.line_no: r.context[0] for r in privacy.sanitize(df).collect()}
    assert masked[0] == "[订单] 商品=杯|收件人=<NAME>|数量=2" and masked[1] == "【订单】\n商品:杯\n收件人:<NAME>\n数量:2" and masked[2] == "登记在<NAME>名下 收到了"
    assert masked[3] == "订单 联系人:<NAME>\t,谢谢" and masked[4] == "联系人:<NAME>" and masked[5] == "包裹 签收的是<NAME>本人"


@pytest.fixture(scope="module")
def replies():
    from pathlib import Path

    folder = Path("/root/testdata/sf0.01")
    if not folder.exists():
        pytest.skip("no test tables here")
    return str(folder)


def test_defects(spark, replies):
    real = spark.read.parquet(f"{replies}/candidate.parquet").select("line_no", "context", "response")
    asked = ["麻烦问下，净重大概多少，15斤左右吗？"]
    cases = [(None, "empty"), ("……", "empty"), (asked[0], "copy"), (f"您的问题是“{asked[0]}”", "copy"), ("Das Paket geht morgen früh raus.", "language"), ("はい、こちらの商品は在庫がございます。", "language"), ("抱歉，这个问题我无法回答。", "refusal"), ("该话题恕我不作回应", "refusal"), ("优惠券的使用条件是「", "truncated"), ("亲，您可以先拍下，然后联", "truncated"), ("净重约15斤，可以放心拿。", None), ("不好意思，这个价格已经不能再少了。", None), ("运费由我们承担，您选到付寄回就行", None), ("满{{amount}}元可", None)]
    made = spark.createDataFrame([(10**9 + i, asked, t) for i, (t, _) in enumerate(cases)], "line_no long, context array<string>, response string")
    empty = spark.createDataFrame([(1, None, "", None)], "repair_id long, context array<string>, chosen string, rejected string")
    found = pairs.defects(real.unionByName(made), empty).where("record_id >= 1000000000 or record_kind = 'repair_group'").collect()
    got = {(r.record_id, r.field): r.defect for r in found}
    for i, (text, want) in enumerate(cases):
        assert got.get((10**9 + i, "response")) == want, text
    assert got[1, "chosen"] == got[1, "rejected"] == "empty"
    assert pairs.defects(real.where("false"), empty.where("false")).count() == 0


def test_defects_leave_out_slots(spark, replies):
    """Residue that only its anchors tell is no defect, as in problem 4."""
    real = spark.read.parquet(f"{replies}/candidate.parquet").select("line_no", "context", "response")
    asked = ["麻烦问下，净重大概多少，15斤左右吗？"]
    rows = [(10**9 + i, asked, f"配件编号是{chr(0x4e00 + 37 * i)}，可以先拍下，然后联") for i in range(40)]
    made = spark.createDataFrame([*rows, (2 * 10**9, asked, "配件编号是【款式】，可以先拍下，然后联")], "line_no long, context array<string>, response string")
    empty = spark.createDataFrame([], "repair_id long, context array<string>, chosen string, rejected string")
    both = real.unionByName(made)
    records = residue.reply_records(both, empty)
    assert residue.residue(records).where("record_id = 2000000000").count() == 1
    got = {r.record_id for r in pairs.defects(both, empty).where("record_id >= 1000000000").collect()}
    assert got == {10**9 + i for i in range(40)}


def test_held_out(spark, replies):
    """Synthetic defects of pairs that the classifier has not seen."""
    real = spark.read.parquet(f"{replies}/candidate.parquet")
    rows = real.where("size(context) >= 3").selectExpr("element_at(context, -3) AS a", "element_at(context, -2) AS b").where("length(trim(a)) > 1 and length(trim(b)) > 1").limit(1500).collect()
    ends = pairs.count_endings(real.selectExpr("explode(context) AS text"), real.selectExpr("response AS text"))
    reader = pairs.Reader(ends)
    example = lambda r: reader.example(r[0], reader.fold(r[1]))
    train, test = (pairs.synthesize([(r.a, r.b) for r in part], seed) for part, seed in ((rows[:1000], 1), (rows[1000:], 2)))
    labels = np.zeros((len(train), len(pairs.LABELS)))
    for i, r in enumerate(train):
        if r[2] >= 0:
            labels[i, r[2]] = 1
    model = pairs.fit([example(r) for r in train], labels)
    scores = model.scores([example(r) for r in test])
    truth = np.array([r[2] for r in test])
    for k in range(len(pairs.LABELS)):
        over = scores[:, k] >= model.thresholds[k]
        assert (truth[over] == k).mean() > 0.95 and over[truth == k].mean() > 0.8, pairs.LABELS[k]
    # The checks alone find far too much: the classifier decides.
    tell = residue.Residue(np.zeros(residue.BUCKETS, np.int8), [])
    free = pairs.Model(model.weights, model.dense, np.zeros(len(pairs.LABELS)))
    own, all_ = (pairs.Judge(m, ends, tell).defects([r[:2] for r in test if r[2] < 0]) for m in (model, free))
    assert sum(map(bool, own)) < 0.05 * len(own) and sum(map(bool, all_)) > 0.9 * len(all_)


PAGES = [
    ("#便当盒 #羊毛茶具 #静音地垫 #折叠抱枕 #防水雨伞 #竹纤维拖鞋", True), ("羊毛帽子 " * 30, True), ("首页 » 挂钩 » 保温杯馆 » 茶具下载 » 电热毯专区 » 更多 » 注册 » 热卖", True), ("\n".join(f"锅铲{i} http://shop{i}-hub.test/p/{i}.html" for i in range(8)), True), ("说到迷你台灯，不得不提迷你台灯包邮和迷你台灯价格。买迷你台灯就选迷你台灯，迷你台灯多少钱看迷你台灯价格。" * 3, True), ("\n".join(["More", "Hook", "Kettle", "Sitemap", "Home", "Umbrella", "Lunch Box"]), True),
    ("买家: 净重多少？\n卖家: 大概15斤，可以放心拿。\n买家: 好的谢谢\n卖家: 不客气的亲", False), ("售后处理说明\n\n退款会在三天内原路退回。请保留配件，缺少会影响进度。\n1. 先看照片再定方案。\n2. 不要承诺时刻。", False), ("Name: woollen towel\nColour\tlight grey\nSize\tM\nWeight\t2949 g\nOrigin\tPinder Falls", False), ("退款会在三天内原路退回，请您留意。如需更改颜色，须在出库前提出。安装前先核对螺丝，再把缝线扣紧。差评里提到最多的是说明书，已经重写过了。\n#床垫 #画框 #雨伞", False), (None, False), ("", False), (" \n ", False),
]


def test_spam(spark):
    df = spark.createDataFrame([(i, t, 0.1) for i, (t, _) in enumerate(PAGES)], "doc_id long, text string, other_share double")
    got = {r.doc_id for r in spam.spam_pages(df).collect()}
    for i, (text, want) in enumerate(PAGES):
        assert (i in got) == want, text
    assert spam.spam_pages(df.where("false")).count() == 0


def test_neighbours_and_long_segments_decide():
    """One long line of keywords outweighs a sentence before it; a bare line between
    sentences is prose, between menu entries it is none; the shortcut is exact."""
    model = spam.Markov(spam.START, spam.MOVES, spam.EMISSIONS)
    line = "、".join(f"望潮挂钩{w}" for w in ["包邮", "价格", "批发", "图片", "直销", "代理", "评测", "正品"])
    assert spam.other_share(f"仓库在打包了，今晚能出库。\n{line}", model) > 0.5
    menu, prose = "首页\n挂钩馆\n下载\n登录\n更多\n注册", "退款会在三天内原路退回，请您留意。"
    bare = "水壶大全"
    labels = lambda text: model.viterbi(spam.observe(text)[0])
    assert labels(f"{prose}\n{prose}\n{bare}\n{prose}\n{prose}")[2] < spam.OTHER <= labels(f"{menu}\n{bare}\n{menu}")[6]
    rnd = np.random.default_rng(1)
    for _ in range(300):
        codes = list(rnd.choice([0, 1, 2, 512, 516, 513, 64, 129, 16, 17, 33, 544], rnd.integers(1, 12)))
        if model.prose_only(codes, model.gains):
            assert max(model.viterbi(codes)) < spam.OTHER


def test_every_page_counts_in_the_fit(spark):
    """Which pages are found hangs neither on their keys nor on partitions, and a table
    that is repeated gives the same shares."""
    border, kinds = "上次说的羊毛雨伞到货了没", ("挂钩馆\n下载\n登录\n更多\n注册\n热卖", "仓库在打包了没\n这个是给我的\n那把伞到了没\n都可以换的")
    ids = [r.id for r in spark.range(3000).orderBy(F.xxhash64("id")).collect()]
    found = []
    for first, second in (kinds, kinds[::-1]):
        rows = [(i, first if n < 1500 else second) for n, i in enumerate(ids)] + [(5000, border)]
        for parts, times in ((1, 1), (7, 1), (3, 2)):
            df = spark.createDataFrame([(i + 10_000 * k, t) for k in range(times) for i, t in rows], "doc_id long, text string").repartition(parts)
            found.append({r.doc_id % 10_000: r.other_share for r in spam.page_labels(df).where("doc_id % 10000 in (0, 1, 2, 5000)").collect()}[5000])
    assert len(set(found)) == 1, found


def test_counts_and_labels_of_many_pages_at_once():
    """Expected counts and labels are those of one page after the other."""
    rnd = np.random.default_rng(2)
    pages = sorted((rnd.choice([0, 1, 2, 512, 516, 64, 129, 17, 33, 544], rnd.integers(1, 40)).astype(spam.CODE) for _ in range(60)), key=len, reverse=True)
    times = [int(n) for n in rnd.integers(1, 4, len(pages))]
    given = spam.table(spam.EMISSIONS)
    want = [np.zeros(5), np.zeros((5, 5)), np.zeros((5, 10)), np.zeros(5)]
    for page, n in zip(pages, times):
        alpha, beta = [spam.START * given[:, page[0]]], [np.ones(5)]
        for c in page[1:]:
            alpha.append(alpha[-1] @ spam.MOVES * given[:, c])
        for c in page[:0:-1]:
            beta.insert(0, spam.MOVES @ (given[:, c] * beta[0]))
        gamma = np.array(alpha) * np.array(beta) / alpha[-1].sum()
        want[0] += n * gamma[0]
        for t, c in enumerate(page[1:]):
            want[1] += n * alpha[t][:, None] * spam.MOVES * given[:, c] * beta[t + 1] / alpha[-1].sum()
        want[2] += n * gamma.T @ spam._BITS[page]
        want[3] += n * gamma.sum(axis=0)
    got = spam.expected(list(zip(pages, times)), (spam.START, spam.MOVES, spam.EMISSIONS))
    assert np.allclose(got, np.concatenate([w.ravel() for w in want]), rtol=1e-9)
    model = spam.Markov(spam.START, spam.MOVES, spam.EMISSIONS)
    assert all(model.viterbi(p.tolist()) == own.tolist() for p, own in zip(pages, model.labels(pages)))


def test_hints_are_no_stricter_than_patterns():
    find = privacy.Finder(privacy.Disclosure({}))
    kinds = lambda t: {k for k, _, _ in find.spans(find.fold(t))}
    assert "phone" in kinds("幺三八零零幺三八零零幺") and "name" in kinds("Hello, I am called Ada Byron") and "address" in kinds("It goes to 12, Mill Lane") and "address" in kinds("杏林路 874 号 19 幢 1406 室")


def test_sketch_adds_up(spark):
    from dialoom.llm import sketch

    rows = [sketch.blocks(np.bincount(np.arange(i, 40_000, 7 * i + 1), minlength=1 << 16)) for i in range(5)]
    df = spark.createDataFrame([(int(a), bytes(b)) for r in rows for a, b in zip(r["slice"], r["block"])], sketch.SCHEMA)
    want = sum(np.bincount(np.arange(i, 40_000, 7 * i + 1), minlength=1 << 16) for i in range(5))
    assert (sketch.total(df, 1 << 16) == want).all() and not sketch.total(df.where("false"), 1 << 16).any()
