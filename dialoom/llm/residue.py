"""Problem 4: template residue, filler, error pages and script notices.

Records of one template are aligned by their anchors: corpus counts of character
n-grams tell what usually stands beside a piece of text. A marked piece between
anchors that mostly have other neighbours is a slot that kept its marker; names
found in unmistakable markers (variable names) are learnt over the corpus and
recognised in mistakable ones too. Whole-page templates of errors, filler and
notices about scripts are told by their fixed wording.

Defined cases: null and empty texts are no case; text of any length is read
whole; rows are independent, so repeated rows are each named; an empty table
gives no rows."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from dialoom.llm import sketch
from dialoom.llm.forms import Fold
from dialoom.session import cut

#: Buckets of the sketch that counts anchors (a power of two), whatever the corpus.
BUCKETS = 1 << 21
#: An anchor has so many characters, and says something from this count on.
ANCHOR, SEEN = 3, 8
#: A slot: the marker is the neighbour of an anchor in less than OPEN of its
#: places; a marker that belongs to the text is so in more than FIXED.
OPEN, FIXED = 0.5, 0.9

#: This project's own masks.
MASKS = {"id", "phone", "num", "year"}

#: Unmistakable markers; group "n" is the name.
STRONG = re.compile(
    r"\{\{\s*[#/]?(?P<n>[^{}]{0,40})\}\}|\$\{(?P<n1>[^{}]{0,40})\}|\$(?P<n2>[A-Za-z_]\w{1,30})\$|<%=?(?P<n3>[^%<>]{0,40})%>|<#(?P<n4>[^#<>]{1,40})#>"
    r"|@@(?P<n5>\w{1,40})@@|__(?P<n6>[A-Za-z]\w{0,30}?)__|\[\[(?P<n7>[^\[\]]{1,40})\]\]|\{(?P<n8>\w{1,30})\}|%(?P<n9>[A-Z_]{2,30})%|:(?P<n10>[a-z_]{3,20}):"
    r"|(?<![A-Za-z0-9%])%[sd](?![A-Za-z])|_{3,}|(?<![A-Za-z0-9])[xX]{3}(?![A-Za-z0-9-])"
    r"|(?<=[\u4e00-\u9fff])(?:null|undefined|NaN)(?![A-Za-z])|(?<![A-Za-z])(?:null|undefined|NaN)(?=[\u4e00-\u9fff])"
)
#: Markers that ordinary text has too.
WEAK = re.compile(r"\[([^\[\]\d]{1,16})\]|【([^【】\d]{1,16})】|<([^<>\d]{1,16})>|#([^#\s\d]{1,16})#|\(([^()\d]{1,16})\)|《([^《》\d]{1,16})》|(?<![A-Za-z0-9])([xX]{2})(?![A-Za-z0-9-])|(?<![A-Za-z])(null|undefined|NaN|None)(?![A-Za-z])")
#: Words that tell someone to fill something in.
FILL_IN = re.compile(r"客户|姓名|用户名|昵称|商品名|公司名|店铺名|待填|待补|待定|待完善|插入|此处|这里填|请替换|请填|填写|样例|话术|insert|your[ _]|placeholder|fill in", re.I)

#: Standard reason phrases, and words of error messages and pages.
ERRORS = re.compile(
    r"bad request|unauthorized\b|forbidden\b|not found\b|request time-?out|too many requests|internal server error|bad gateway|service unavailable|gateway time-?out|no healthy upstream"
    r"|traceback \(most recent|uncaught \w*error|\b\w*exception\b\s*(?:[:\-]|$)|\bfatal error\b|\bpanic\s*[:\-]|^\W*error\s*[:\-\d]|\bjava\.\w+\.|\b\w+error '|connect(?:ion)? (?:refused|timed out|reset)|segmentation fault|stack trace"
    r"|could not load (?:this|the) page|(?:content|page) is no longer available|access denied|session has expired|do not have permission to view|something went wrong on our|request id\s*:|internal error|please try again later"
    r"|系统繁忙[,，。!！\s]*请?稍[后候]|服务器(?:内部)?错误|网关超时|请求过于频繁|页面走丢了|(?:访问|要找|查找)的?(?:页面|内容).{0,6}(?:不存在|无法|删除|失效)|加载失败|登录状态已?失效|错误码|错误代码|^\W*错误\s*[:：]?\s*\d{3}|点击重试|\d{1,4}秒后返回|请求编号|完成验证后继续"
    r"|(?:页面|数据|接口|服务|网络|连接|系统|内容|会话|程序)[,，]?(?:加载失败|出现异常|发生异常|出错了|开小差|已下线|响应超时|连接超时|不存在|暂时无法访问|暂不可用|无响应|崩溃)"
    r"|^\W*\{\s*\"(?:code|error|msg|status|errno)\"",
    re.I,
)
_SCRIPT = r"java\s*script|\bjs\b|(?<![a-z])js(?![a-z])|脚本|\bscript(?:s|ing)?\b|\bcookies?\b"
_TURN_ON = r"enable|activate|allow|turn(?:ed)?\s+(?:\w+\s+)?on|disabled|\bneeds?\b|require|blocked|启用|开启|打开|允许|运行|拦截|不支持|禁用|关闭"
NOTICE = re.compile(rf"(?:{_SCRIPT})[\s\S]{{0,60}}?(?:{_TURN_ON})|(?:{_TURN_ON})[\s\S]{{0,40}}?(?:{_SCRIPT})|<noscript", re.I)
#: A notice speaks of the reader's page, not of how to do something.
ADVICE = re.compile(r"的话|的时候|手机上|(?<!需)要开(?!启)|就行|就好|助手|if you want|on (?:your|the) phone", re.I)

FILLER = re.compile(
    r"(?:请在此|在这里|此处|请在这里|请于此处)(?:填写|粘贴|录入|补充|输入|插入|编辑|添加)|默认文案|占位(?:符|文)|回复内容\(样例\)|\(样例\)|(?<![a-z])(?:tbd|todo|fixme)(?![a-z])|待补充|待填写|placeholder|text goes here|回复模板|客服x+[,，]|关于x+问题|asdf|qwer(?:ty)?\b|样例文本|示例文字",
    re.I,
)
REPEATED = re.compile(r"([^\W\d_]{2,6}?)\1{2,}")
#: Letters of one row of the keyboard only, struck at random.
MASHED = re.compile(r"^[\s,.;；，]*(?:[asdfghjkl][\s,.;；，]*){6,}$|^\W*(?:[qwertyuiop]\W*){9,}$|^\W*(?:[zxcvbnm]\W*){6,}$", re.I)
RUNS = re.compile(r"^\W*(?:([a-z])\1{2,}(?!\1)\W*){2,}$", re.I)
#: Word starts of the customary filler text.
LOREM = ("lorem", "ipsum", "dolor", "amet", "consec", "adipis", "eiusmod", "tempor", "incidid", "labore", "aliqua", "magna", "elit", "sit", "sed", "enim", "minim", "veniam")

_BLANKS = re.compile(r"\s+")
_WORDS = re.compile(r"[A-Za-z]+")
_INTERESTING = re.compile(r"[\[\]{}<>#@%$_【《(]|[xX]{2}|null|undefined|NaN|None|:[a-z_]{3,20}:")


def gram_codes(texts: list[str], size: int) -> np.ndarray:
    """Bucket of each character n-gram of the texts, joined by a line break."""
    codes = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(codes) < size:
        return np.array([], np.int64)
    out = np.full(len(codes) - size + 1, size, np.uint64)
    for i in range(size):
        out = (out ^ codes[i : i + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return (out % np.uint64(BUCKETS)).astype(np.int64)


def strong_names(text: str) -> list[str]:
    """Names in the unmistakable markers of a text."""
    out = []
    for m in STRONG.finditer(text):
        name = next((g for g in m.groups() if g), "").strip().lower()
        if name and not name.isdigit():
            out.append(name)
    return out


def anchors(texts: DataFrame) -> tuple[np.ndarray, list[str]]:
    """Sketch of n-gram counts and the variable names, over all rows of `text`."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fold, total, names = Fold(), np.zeros(BUCKETS, np.int64), set()
        for pdf in batches:
            shown = [_BLANKS.sub("", fold(t)) for t in pdf["text"]]
            for size in (ANCHOR, ANCHOR + 1):
                total += np.bincount(gram_codes(shown, size), minlength=BUCKETS)
            for t in shown:
                if _INTERESTING.search(t):
                    names.update(strong_names(t))
        yield sketch.blocks(total).assign(name=None)
        if names:
            yield pd.DataFrame({"slice": -1, "block": None, "name": list(names)})

    parts = cut(texts.select("text").where("text is not null").mapInPandas(count, f"{sketch.SCHEMA}, name string"))
    names = [r.name for r in parts.where("name is not null").select("name").distinct().orderBy("name").collect()]
    return sketch.total(parts.where("name is null"), BUCKETS), names


#: Rows that can hold an unmistakable marker, for Spark.
MARKERS = r"\{|\$|<[#%]|@@|__|\[\[|%[A-Z]|:[a-z_]{3,20}:"


def marker_names(texts: DataFrame) -> list[str]:
    """The variable names alone, from all rows of `text`."""

    def collect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fold, names = Fold(), set()
        for pdf in batches:
            for t in pdf["text"]:
                names.update(strong_names(_BLANKS.sub("", fold(t))))
        if names:
            yield pd.DataFrame({"name": list(names)})

    width = "translate(text, '｛｝＄＜＞＃％＠＿［］：', '{}$<>#%@_[]:')"
    rows = texts.select("text").where(F.expr(width).rlike(MARKERS))
    found = rows.mapInPandas(collect, "name string").distinct()
    return [r.name for r in found.orderBy("name").collect()]


class Residue:
    """Tells whether a text is residue, and of which sort."""

    def __init__(self, counts: np.ndarray, names: list[str]):
        self.fold, self.counts, self.names = Fold(), counts, set(names)
        self.kind = lru_cache(100_000)(self._kind)

    def _count(self, gram: str) -> int:
        return int(self.counts[gram_codes([gram], len(gram))[0]])

    def slot(self, text: str, start: int, end: int) -> bool:
        """Whether text[start:end] stands where records usually have other text."""
        shares = []
        left, right = text[max(0, start - ANCHOR) : start], text[end : end + ANCHOR]
        for anchor, joined in ((left, left + text[start]), (right, text[end - 1] + right)):
            if len(anchor) == ANCHOR and (n := self._count(anchor)) >= SEEN:
                shares.append(self._count(joined) / n)
        return len(shares) == 2 and min(shares) < OPEN and max(shares) < FIXED

    def _marked(self, text: str) -> bool:
        if STRONG.search(text):
            return True
        for m in WEAK.finditer(text):
            name = next(g for g in m.groups() if g).strip().lower()
            if name in MASKS:
                continue
            if name in self.names or FILL_IN.search(name) or self.slot(text, *m.span()):
                return True
        return False

    def _kind(self, text: str | None) -> str | None:
        """placeholder, filler, error or script; None for ordinary text."""
        if not text or not text.strip():
            return None
        shown = self.fold(text)
        tight = _BLANKS.sub("", shown)
        if _INTERESTING.search(tight) and self._marked(tight):
            return "placeholder"
        if ERRORS.search(shown) or ERRORS.search(tight):
            return "error"
        if NOTICE.search(shown) and not ADVICE.search(tight):
            return "script"
        if FILLER.search(tight):
            return "filler"
        letters = "".join(filter(str.isalpha, tight)).lower()
        if len(letters) >= 6 and REPEATED.search(letters) or RUNS.search(shown) or MASHED.search(shown):
            return "filler"
        words = _WORDS.findall(shown.lower())
        if len(words) >= 3 and sum(w.startswith(LOREM) for w in words) > 0.6 * len(words):
            return "filler"
        return None


def residue(records: DataFrame) -> DataFrame:
    """`record_kind, record_id, sort` of the rows of `record_kind, record_id,
    text` that are residue; the rest is what may be kept."""
    send = records.sparkSession.sparkContext.broadcast(anchors(records))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tell = Residue(*send.value)
        for pdf in batches:
            kinds = pd.Series([tell.kind(t) for t in pdf["text"]], index=pdf.index, dtype=object)
            hit = kinds.notna()
            if not hit.any():
                continue
            yield pd.DataFrame({"record_kind": pdf["record_kind"][hit], "record_id": pdf["record_id"][hit], "sort": kinds[hit]})

    rows = records.select("record_kind", "record_id", "text").where("text is not null")
    return rows.mapInPandas(run, "record_kind string, record_id long, sort string")


def reply_records(candidate: DataFrame, repair_group: DataFrame) -> DataFrame:
    """Replies of both tables in one form."""
    one = candidate.select(F.lit("candidate").alias("record_kind"), F.col("line_no").alias("record_id"), F.col("response").alias("text"))
    return one.unionByName(repair_group.select(F.lit("repair_group").alias("record_kind"), F.col("repair_id").alias("record_id"), F.col("chosen").alias("text")))


def without_residue(records: DataFrame, found: DataFrame) -> DataFrame:
    """The rows that are left when residue is left out."""
    return records.join(found, ["record_kind", "record_id"], "left_anti")
