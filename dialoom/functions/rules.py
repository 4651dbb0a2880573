"""Word lists as data, compiled to patterns once on the driver."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field, fields

from pyspark.sql import Column, functions as F


def pattern(words: list[str] | tuple[str, ...]) -> str:
    """One alternation of literal words."""
    return "|".join("\\Q" + w.replace("\\E", "\\E\\\\E\\Q") + "\\E" if re.search(r"[^\w\s]", w) else w for w in words)


def any_of(c: Column, words: list[str] | tuple[str, ...]) -> Column:
    """Whether a text has one of the words; false without words."""
    return c.rlike(pattern(words)) if words else F.lit(False)


def hits(c: Column, words: list[str] | tuple[str, ...]) -> Column:
    """How many of the words a text has."""
    total = F.lit(0)
    for w in words:
        total = total + c.contains(w).cast("int")
    return total


def found(c: Column, words: list[str] | tuple[str, ...]) -> Column:
    """The words that a text has, in the order of the list."""
    return F.filter(F.array(*[F.when(c.contains(w), F.lit(w)) for w in words]), lambda x: x.isNotNull()) if words else F.array().cast("array<string>")


@dataclass(frozen=True)
class Pack:
    """The word lists of one kind of corpus. The default is written for the
    customer-service tables that the tests use; every list is a parameter."""

    blocked: tuple[str, ...] = ("微信", "加微", "好评返", "公众号", "进群")
    low_info: tuple[str, ...] = ("嗯", "嗯嗯", "好的", "好", "在的", "您好", "你好", "收到", "谢谢", "不客气", "可以的", "有的", "稍等")
    questions: tuple[str, ...] = ("吗", "呢", "多少", "几", "怎么", "什么", "哪", "能不能", "可以", "是不是")
    actions: tuple[str, ...] = ("发货", "退款", "退货", "换", "补发", "寄", "运费", "地址", "快递", "发票", "券", "备注", "价", "尺码", "颜色", "登记", "查")
    topics: tuple[str, ...] = ("退款", "退货", "快递", "物流", "发货", "尺码", "颜色", "材质", "价格", "优惠", "发票", "门店", "贺卡", "包裹", "运费")
    stop: tuple[str, ...] = ("这个", "那个", "可以", "就是", "一下", "您好", "你好")
    temporal: tuple[str, ...] = ("活动到", "截止", "之后恢复原价", "限时", "双11", "618")
    soft: tuple[str, ...] = ("有问题随时找我", "辛苦您", "请您放心", "感谢等待")
    pitch: tuple[str, ...] = ("也有货", "您也可以选", "免运费", "拍下就送")
    shop_names: tuple[str, ...] = ("旗舰", "专柜", "店名叫")
    operations: tuple[str, ...] = ("拍下", "备注", "改价", "结算页", "订单页")
    policies: tuple[str, ...] = ("无理由", "保修", "运费险", "超过")
    incomplete: tuple[str, ...] = ("然后", "还有", "另外", "但是", "所以", "那个")
    overcommit: tuple[str, ...] = ("保证", "一定能", "绝对", "百分百")
    hard_risk: tuple[str, ...] = ("补偿", "赔", "一定")
    refund_promise: tuple[str, ...] = ("马上退", "直接退款", "已经给您申请了")
    time_promise: tuple[str, ...] = ("<NUM>点前付款的当天走", "<NUM>天(?:左右|内)", "<NUM>月<NUM>日前", "今晚能出库")
    generic: tuple[str, ...] = ("您好[，,]", "亲[，,]?好的", "感谢(等待|您的)", "收到[，,]")
    high_risk: tuple[str, ...] = ("运费", "补发", "补偿", "差价", "恢复原价", "到手价")
    helpful: tuple[str, ...] = ("帮您", "给您", "您看", "建议", "可以看到")
    weak_asked: tuple[str, ...] = ("<ID>", "<NUM>", r"\d+", "地址", "质量")
    fragments: tuple[str, ...] = ("[a-zA-Z]+", r"\d+", "(好|行|嗯|哦)+", "[，。！？,.!?]+.{0,2}")
    complete: tuple[str, ...] = ("的", "了", "吗", "呢", "吧", "哦", "哈", "行", "好")
    contact: tuple[str, ...] = ("微信", "电话", "加我", "QQ", "邮箱", "@")
    risky: tuple[str, ...] = ("补偿", "差价", "退款", "承担", "无理由")
    promise: tuple[str, ...] = ("当天", "今晚", "天左右", "日前", "天内")
    store: tuple[str, ...] = ("页面", "结算页", "订单页", "专柜", "门店")
    #: Ordered: the first category whose words occur is taken.
    categories: tuple[tuple[str, tuple[str, ...]], ...] = (
        ("after_sale", ("退款", "退货", "换货", "补发", "怎么办", "给不给换", "补偿")),
        ("product_info", ("材质", "尺码", "颜色", "厚", "色差", "适合", "水洗", "暴晒", "净重", "一套")),
        ("price_activity", ("券", "活动", "优惠", "差价", "便宜", "会员价", "折扣")),
        ("courier_info", ("快递", "物流", "包裹显示", "送到")),
        ("shipping_sla", ("发货", "发出", "几号能到", "赶着用")),
    )
    repair_categories: tuple[tuple[str, tuple[str, ...]], ...] = (
        ("address", ("地址", "改送")),
        ("refund", ("退款", "退货", "补偿")),
        ("shipping", ("发货", "快递", "物流", "几号能到")),
        ("promo", ("券", "活动", "差价", "便宜", "折扣")),
        ("product", ("材质", "尺码", "颜色", "厚", "色差", "适合")),
    )
    #: topic: (words of the reply, wider words of the question)
    expansions: tuple[tuple[str, tuple[str, ...], tuple[str, ...]], ...] = (
        ("promo", ("券", "活动", "免运费"), ("券", "活动", "优惠", "便宜", "价", "运费")),
        ("address", ("地址", "核对一下"), ("地址", "收件", "寄", "送")),
        ("shipping", ("发货", "发出", "打包"), ("发货", "发出", "快递", "几号", "多久", "物流")),
        ("refund", ("退款", "退回"), ("退", "换", "钱", "差价")),
    )
    #: (word, weight) in context or reply
    risks: tuple[tuple[str, float], ...] = (("补偿", 2.0), ("退款", 1.5), ("差价", 1.2), ("保证", 2.0), ("当天", 0.8), ("免运费", 0.6), ("券", 0.5), ("无理由", 1.0))
    #: (word, weight) in the input of an instruction row
    input_risks: tuple[tuple[str, float], ...] = (("地址", 0.6), ("退款", 0.8), ("投诉", 1.0))
    negatives: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {
            "refund": ("退款的事您自己看页面说明吧。", "这个我们不负责，您再等等看。"),
            "shipping": ("物流慢是正常的，您耐心等着就行。", "什么时候到我们也不清楚。"),
            "promo": ("活动规则页面都有，自己看一下。", "没有优惠，想买就拍。"),
            "product": ("尺码都差不多，随便选一个吧。", "参数页面上写了，我就不说了。"),
            "address": ("地址改不了，收不到再说。", "您自己联系快递改吧。"),
            "other": ("这个问题不清楚，您看着办吧。", "随便都行，您自己决定。"),
        }
    )


def load_pack(text: str) -> Pack:
    """A pack from JSON with any of its fields; the others keep their defaults."""
    known = {f.name for f in fields(Pack)}
    data = json.loads(text)
    if set(data) - known:
        raise ValueError(f"no such list: {', '.join(sorted(set(data) - known))}")
    fixed = lambda x: tuple(map(fixed, x)) if isinstance(x, list) else {k: fixed(v) for k, v in x.items()} if isinstance(x, dict) else x
    return Pack(**{k: fixed(v) for k, v in data.items()})


DEFAULT = Pack()
