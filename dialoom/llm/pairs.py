"""Problem 7: defective replies of prompt and response pairs.

A multi-label linear classifier on hashed n-grams and pair features decides about
every pair. It is fitted on pairs of adjacent turns inside contexts, taken as
sound, and on synthetic defects made of them: cut off, copied from the question,
swapped for replies in another language, refused. Thresholds are calibrated on
held-out pairs for precision. Corpus statistics (how often texts end with some
units, and how often so with a closing mark, over all turns and all replies) are
pair features, as are wording, containment and language. Three exact checks
follow: a copy gives back four fifths of the question, languages are known and
differ, a cut does not end with a whole name, number or address. Replies without
letter or figure are empty.

Defined cases: a null reply is empty; a null or empty context has no question,
so neither copy nor language is told; residue (problem 4) is left out; a field
has one defect, in the order empty, copy, language, refusal, truncated; an empty
table gives no rows; repeated rows are each reported."""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from dialoom.llm import sketch
from dialoom.llm.forms import Fold, simple
from dialoom.llm.privacy import ADDRESS, EMAIL, ID18, ID9, PAPER, PHONE, STREET
from dialoom.llm.residue import Residue, anchors, marker_names, reply_records

#: Pairs that the classifier is fitted on (a bounded sample, by hash of the key).
TRAIN_PAIRS = 4000
#: Hash buckets of the n-grams and of the sketches of endings (powers of two).
HASHED, ENDINGS = 1 << 15, 1 << 19
LABELS = ("truncated", "refusal", "copy", "language")
#: An ending is usual from this share on.
USUAL = 0.03
#: Precision that a threshold must reach on held-out pairs.
PRECISION = 0.99

#: Least and largest threshold: what is less likely than not is no finding.
LEAST, MOST = 0.5, 0.95
#: Scale of the pair features, in the order of `Reader.signs`.
WEIGHTS = np.array([1, 1, 2, 2, 2, 1, 1, 2, 2, 4, 1, 1, 2, 2, 2.0])

UNIT = re.compile(r"[㐀-鿿぀-ヿ가-힣]|[a-zÀ-ɏḀ-ỿЀ-ӿ]+(?:'[a-z]+)?|[฀-๿]+|\d+(?:[.,:]\d+)*")
_LETTER = re.compile(r"[^\W_]")
#: Marks and blanks at the end of a text; what tells how it ends lies in its last characters.
_TRAIL = " \t\r\n\v\f。.…!?！？~,，、;；:：-–—"
_LAST = 200

#: Frequent function words of some languages in Latin letters.
WORDS = {
    "en": "the is are and you your we our to of for it this that with have will not can be on in by at from as if please order thanks waiting hello yes",
    "fr": "le la les des du un une nous vous votre est sont dans sous pour avec pas que qui cet cette ce en oui sera demain colis jours merci",
    "de": "der die das ein eine und ist sind nicht wir sie uns ihr ihre noch vom zum mit für morgen bitte dieser diese geht ja haben wird auf",
    "es": "el los las una unos por para con que no es son en le su sus este esta sí mañana tenemos días gracias del varios",
    "it": "il lo gli della di che per non è sono con una questo grazie domani abbiamo giorni",
    "pt": "o os uma não é são com para por este esta obrigado amanhã temos dias seu sua você",
}
_WORD_LANGUAGE: dict[str, list[str]] = {}
for _name, _words in WORDS.items():
    for _w in _words.split():
        _WORD_LANGUAGE.setdefault(_w, []).append(_name)
_VIETNAMESE = re.compile(r"[ạảấầẩẫậắằẳẵặẹẻẽếềểễệỉịọỏốồổỗộớờởỡợụủứừửữựỳỵỷỹđơư]")
#: Product names and codes, order tags and addresses say nothing about language.
_NAMES = re.compile(
    r"[A-ZÀ-ÞĐ][A-Za-zÀ-ɏ'’-]{0,30}(?: Co)?\s?[A-Z]{2}-?\d+[A-Za-z]*|[㐀-鿿]{0,8}[A-Za-z]{2}-\d+[A-Za-z]*|[A-ZÀ-ÞĐ][A-Za-zÀ-ɏ'’-]{2,30}(?: Co)?(?=[㐀-鿿])|(?<![A-Za-z0-9.+_-])[A-Za-z0-9.+_-]{1,64}\s?@\s?[A-Za-z0-9.-]+|单号是|编号|订单尾号|我的订单|订单|就是\s*\w*那一单|\border\b|\b[A-Z]{2}\d{6,}\b"
)
_SPLIT = re.compile(r"[㐀-鿿]|[぀-ヿ]|[가-힣]|[Ѐ-ӿ]+|[฀-๿]|[A-Za-zÀ-ɏḀ-ỿ]+(?:'[a-z]+)?")

#: Wording of refusals, for the synthetic ones and to verify.
_CAN_NOT = "无法 不能 不便 拒绝 无权 没有权限 没办法 不予 恕不 恕我不 不作 只能拒绝 暂不支持 超出 不在 无可 不提供".split()
_ANSWER = "回答 作答 答复 回应 回复 讨论 谈论 评论 解答 帮助 提供 判断 继续 奉告 完成 协助 服务范围".split()
REFUSAL = re.compile(
    rf"(?:{'|'.join(_CAN_NOT)}).{{0,12}}?(?:{'|'.join(_ANSWER)})|(?:请求|问题|话题|内容).{{0,8}}(?:只能拒绝|拒绝|不予)|无可奉告|(?:限制|敏感|违规)内容|恕不回复|语言(?:程序|模型)"
)
REFUSAL_LATIN = re.compile(
    r"(?:can(?:no|')t|cannot|not able to|unable to|won't|must decline|have to decline|refuse to)\b.{0,30}\b(?:help|assist|answer|respond|discuss|provide|comply|request|topic|comment)|as an? (?:ai|assistant|language model)",
    re.I,
)
#: A shop's own negative answer speaks of goods, prices, orders: a feature against refusals.
_SHOP = re.compile(r"价格|退货|退款|发票|专票|普票|门店|快递|发货|折扣|券|尺码|颜色|补发|库存|运费|包裹|refund|parcel|price|stock|ship|voucher", re.I)
_PARTICLES = set("哦哈呢啦哟噢嘛")
_CLOSED = re.compile(r"(?:[哦哈呢啦吗吧呀啊嘛哟噢぀-ヿ가-힣฀-๿]|[。!?！？]|(?<!\.)\.)[\s~～…)」』”\"']*$")
#: The number of a list that does not follow.
_LISTED = re.compile(r"[:：]\s*\d{1,2}\.$")
_OPEN = re.compile(r"[-–—,，、:：(（「『“]\s*$|[:：]\s*\d{1,2}\.\s*$|(?:^|[\s,，。])先?把[㐀-鿿]{1,4}\W*$")
_BRACKETS = ("(（「『“‘[【《<", ")）」』”’]】》>")
_NAME_END = re.compile(r"(?:我叫|收件人写?|收件人[:：=]|名字是|name is)\s*\S{2,20}$|那一单\W*$|(?:店名叫|下就送)[㐀-鿿]{2,12}$|[A-Za-z]{0,2}\d{7,}\W*$", re.I)
#: Three characters before a comma or closing mark inside a text: a phrase may end so.
_BLANK_END = re.compile(r"([㐀-鿿])([㐀-鿿])([㐀-鿿])(?= [^\s…。,，])")
_PHRASE_END = re.compile(r"([㐀-鿿])([㐀-鿿])([㐀-鿿])(?=[,，。!?！？][^\s…。,，])")
_FRAMES = ["{}", "{}", "{} {}", "{}\n{}", "您的问题是“{}”", "您是问：{}", "用户：{}", "You asked: {}", "买家：{}", "问：{}", "{}呢"]
#: Sentences for swapped languages; written for this purpose.
_FOREIGN = (
    "We will check the stock and answer you later today.|Your parcel left our store this morning.|You may return it within two weeks.",
    "Nous allons vérifier le stock et vous répondre.|Votre commande est partie ce matin.|Vous pouvez le renvoyer sous deux semaines.",
    "Wir prüfen den Bestand und melden uns bei Ihnen.|Ihre Bestellung ist heute früh raus.|Sie können es noch zurückgeben.",
    "Vamos a mirar las existencias y le respondemos.|Su pedido salió esta mañana.|Puede devolverlo en unos días.",
    "Мы проверим наличие и ответим вам сегодня.|Ваша посылка уже в пути.",
    "在庫を確認してからご連絡いたします。|本日中に発送します。",
    "재고를 확인하고 답변드리겠습니다.|오늘 발송해 드립니다.",
    "เราจะตรวจสอบสต็อกและตอบกลับค่ะ",
    "Chúng tôi sẽ kiểm tra kho và trả lời bạn.",
    "我们查一下库存再回复您。|您的包裹今天早上已经发出了。|两周之内都可以退回来。",
)
_GOODS = ("Orvano静音水壶HK-4318", "竹纤维挂钩AB-1020S", "Lumen oak plate NT-77")
_REFUSED = ("{a}{b}{c}{d}", ["抱歉，", "对不起，", "不好意思，", "很遗憾，", "非常抱歉，", ""], ["这个问题", "您的请求", "该话题", "这类内容", "您问的这些", "此类提问", "相关内容"])
_REFUSED_END = ["。", "", "，请谅解。", "，换个话题吧。", "。祝您生活愉快。", "。还有别的想聊吗？"]
_REFUSED_PLAIN = [
    "作为智能助手，我不能提供这方面的内容", "我只是一个语言程序，无法判断", "暂不支持回答该问题，请谅解", "您的问题涉及限制内容，我不能继续", "无可奉告", "不在我的服务范围内，恕不回复",
    "I'm sorry, but I can't help with that.", "As an assistant I am not able to answer this.", "I cannot discuss this topic.", "I must decline to respond to this request.", "I am unable to assist with your request.",
]


def is_open(shown: str) -> bool:
    """Whether a text ends inside brackets, or on a mark that goes on."""
    start = max(map(shown.rfind, _BRACKETS[0]))
    return start > max(map(shown.rfind, _BRACKETS[1])) or _OPEN.search(shown[-_LAST:]) is not None


def units_of(shown: str) -> list[str]:
    """Characters of Han, kana and Hangul, words of other scripts, "0" for figures."""
    return [u if u > ":" else "0" for u in UNIT.findall(shown.lower())]


def ending(units: list[str], size: int) -> int:
    """Bucket of the last units."""
    return crc32(" ".join(units[-size:]).encode("utf-8", "surrogatepass")) % ENDINGS


def last_units(shown: str) -> tuple[list[str], bool]:
    """The last units before closing marks and particles, and whether there are any
    such marks. They lie within the last characters, blanks and marks aside."""
    text = shown.rstrip()[-_LAST:]
    closed = bool(_CLOSED.search(text)) and not _LISTED.search(text)
    units = units_of(text[-160:])
    while units and units[-1] in _PARTICLES:
        units.pop()
    return units, closed


#: Sizes, units and greetings that all languages write so.
_UNITS = {"xs", "xl", "xxl", "xxxl", "cm", "mm", "ml", "kg", "km", "pro", "hi", "ok", "qq", "app", "id"}
_HAN = re.compile(r"[㐀-鿿]")
_OTHER = re.compile(r"[぀-ヿ가-힣Ѐ-ӿ฀-๿]")


@lru_cache(50_000)
def language(shown: str) -> str | None:
    """Language of a text apart from names and codes; None if it has too little."""
    if not _OTHER.search(shown) and len(_HAN.findall(shown)) * 2 > len(shown):
        return "zh"
    counts = {"han": 0, "kana": 0, "hangul": 0, "cyrillic": 0, "thai": 0}
    words = []
    for u in _SPLIT.findall(_NAMES.sub(" ", shown)):
        c = u[0]
        if "㐀" <= c <= "鿿":
            counts["han"] += 1
        elif "぀" <= c <= "ヿ":
            counts["kana"] += 1
        elif "가" <= c <= "힣":
            counts["hangul"] += 1
        elif "Ѐ" <= c <= "ӿ":
            counts["cyrillic"] += 1
        elif "฀" <= c <= "๿":
            counts["thai"] += 1
        elif len(u) > 1 and u.lower() not in _UNITS:
            words.append(u.lower())
    han = counts["han"]
    if counts["kana"] >= 3 and counts["kana"] * 4 > han:
        return "ja"
    for script, least in (("hangul", 3), ("thai", 5), ("cyrillic", 2)):
        if counts[script] >= least and counts[script] > han / 2:
            return script
    if len(words) >= 2 and len(words) * 2 > han:
        if _VIETNAMESE.search(" ".join(words)) and sum(bool(_VIETNAMESE.search(w)) for w in words) * 4 >= len(words):
            return "vi"
        votes: dict[str, float] = {}
        for w in words:
            for name in _WORD_LANGUAGE.get(w, ()):
                votes[name] = votes.get(name, 0) + 1 / len(_WORD_LANGUAGE[w])
        if not votes:
            return "latin" if len(words) >= 3 else None
        return max(sorted(votes), key=votes.get)
    return "zh" if han >= 2 else None


def differs(asked: str | None, reply: str | None) -> bool:
    """Whether both languages are known and are not the same."""
    if not asked or not reply or asked == reply:
        return False
    return "latin" not in (asked, reply) or bool({asked, reply} & {"zh", "ja", "hangul", "thai", "cyrillic"})


def overlap(asked: list[str], reply: list[str]) -> tuple[float, float]:
    """Shares of the question's and of the reply's bigrams that the other has."""
    if len(asked) < 2 or len(reply) < 2:
        same = asked == reply and bool(asked)
        return float(same), float(same)
    a, b = set(zip(asked, asked[1:])), set(zip(reply, reply[1:]))
    both = len(a & b)
    return both / len(a), both / len(b)


class _Hashes(dict):
    """Hash of each unit, computed once."""

    def __missing__(self, unit: str) -> int:
        if len(self) > 500_000:
            self.clear()
        got = self[unit] = crc32(unit.encode("utf-8", "surrogatepass"))
        return got


_HASH = _Hashes().__getitem__


@dataclass
class Example:
    """What the classifier sees of a pair: hashes of its units, its endings, the pair
    features."""

    low: list[int]
    ends: list[int]
    signs: list[float]


def gathered(examples: list[Example]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed n-grams of all examples, the example of each, and how many each has."""
    low = np.array(list(chain.from_iterable(x.low for x in examples)), np.int64)
    row = np.repeat(np.arange(len(examples)), [len(x.low) for x in examples])
    inside = row[1:] == row[:-1]
    pairs = ((low[:-1] * 31 + low[1:]) % HASHED)[inside]
    ends = np.array([x.ends for x in examples], np.int64) * 7 % HASHED
    rows = np.concatenate([row, row[1:][inside], np.repeat(np.arange(len(examples)), ends.shape[1])])
    return np.concatenate([low % HASHED, pairs, ends.ravel()]), rows, np.bincount(rows, minlength=len(examples))


class Reader:
    """Features of a pair; `ends` holds three sketches of endings: of turns, of
    closed texts, of all texts."""

    def __init__(self, ends: np.ndarray):
        self.fold, self.ends = Fold(), ends
        self.asked = lru_cache(30_000)(self._asked)

    def _asked(self, text: str) -> tuple[list[str], str | None]:
        shown = self.fold(text)
        return units_of(shown), language(shown)

    def known_end(self, shown: str) -> float:
        """1 for a closed text; else how usual it is that texts end so: the larger
        share of turns, and of closed texts, among all with this ending."""
        text = shown.rstrip()[-_LAST:]
        if _CLOSED.search(text) and not _LISTED.search(text):
            return 1.0
        units = last_units(shown)[0]
        if not units:
            return 0.0
        turns, marked, every = (float(x) for x in self.ends[:, ending(units, 3)])
        return max(turns if turns >= 2 else 0.0, marked) / (every + 1.0)

    def signs(self, asked: str, shown: str, units: list[str]) -> list[float]:
        """The pair features; the checks look at them too."""
        question, spoken = self.asked(asked)
        refused = (REFUSAL.search(shown) or REFUSAL_LATIN.search(shown)) is not None
        of_asked, of_reply = overlap(question, units) if 0.6 * len(question) <= len(units) else (0.0, 0.0)
        end = self.known_end(shown)
        # How a text ends matters where its ending is unusual; elsewhere nothing is searched.
        named = private = 0.0
        if end < USUAL:
            text = shown.rstrip(_TRAIL)
            named = float(_NAME_END.search(text[-_LAST:]) is not None)
            private = float(any(m.end() >= len(text) for p in (EMAIL, PHONE, ID18, ID9, PAPER, STREET, ADDRESS) for m in p.finditer(text)))
        return [
            1.0, min(1.0, end * 5), float(end < USUAL), float(is_open(shown)), float(refused), of_asked, of_reply, float(of_asked > 0.85), float(of_asked > 0.85 and of_reply > 0.4),
            float(differs(spoken, language(shown))), float(shown != shown.rstrip(_TRAIL)), min(len(units), 60) / 60, named, private, float(_SHOP.search(shown) is not None),
        ]

    def example(self, asked: str | None, shown: str) -> Example:
        units = units_of(shown)
        return Example(list(map(_HASH, units)), [ending(units, n) for n in (1, 2)], self.signs(asked or "", shown, units))


@dataclass
class Model:
    weights: np.ndarray
    dense: np.ndarray
    thresholds: np.ndarray

    def scores(self, examples: list[Example]) -> np.ndarray:
        """Probability of each label for each example."""
        if not examples:
            return np.zeros((0, len(LABELS)))
        idx, rows, sizes = gathered(examples)
        z = np.array([x.signs for x in examples]) * WEIGHTS @ self.dense
        for k in range(len(LABELS)):
            z[:, k] += np.bincount(rows, weights=self.weights[idx, k], minlength=len(examples)) / np.sqrt(sizes)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(examples: list[Example], labels: np.ndarray, epochs: int = 80, rate: float = 0.3) -> Model:
    """Logistic regression for all labels at once (Adagrad over the whole set);
    every fifth example is held out to calibrate the thresholds."""
    held = np.arange(len(examples)) % 5 == 0
    train = [e for e, h in zip(examples, held) if not h]
    y = labels[~held]
    idx, row, size = gathered(train)
    scale = 1 / np.sqrt(size)
    dense = np.array([e.signs for e in train]) * WEIGHTS
    w, v = np.zeros((HASHED, len(LABELS))), np.zeros((dense.shape[1], len(LABELS)))
    gw, gv = np.full_like(w, 1e-6), np.full_like(v, 1e-6)
    for _ in range(epochs):
        part = w[idx] * scale[row][:, None]
        z = dense @ v
        for k in range(len(LABELS)):
            z[:, k] += np.bincount(row, weights=part[:, k], minlength=len(train))
        err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(train)
        dv = dense.T @ err + 1e-6 * v
        for k in range(len(LABELS)):
            dw = np.bincount(idx, weights=(err[:, k] * scale)[row], minlength=HASHED) + 1e-6 * w[:, k]
            gw[:, k] += dw**2
            w[:, k] -= rate * dw / np.sqrt(gw[:, k])
        gv += dv**2
        v -= rate * dv / np.sqrt(gv)
    model = Model(w.astype(np.float32), v, np.full(len(LABELS), 0.5))
    if held.any():
        p, t = model.scores([e for e, h in zip(examples, held) if h]), labels[held]
        for k in range(len(LABELS)):
            order = np.argsort(-p[:, k])
            right = np.cumsum(t[order, k]) / np.arange(1, len(order) + 1)
            good = np.flatnonzero(right >= PRECISION)
            model.thresholds[k] = np.clip(p[order[good[-1]], k] if len(good) else MOST, LEAST, MOST)
    return model


def _cut(text: str, rnd: random.Random) -> str | None:
    """The text broken off between two letters or figures."""
    spots = [i for i in range(max(3, len(text) // 5), len(text)) if text[i - 1].isalnum() and text[i].isalnum()]
    return text[: rnd.choice(spots)] if spots else None


def _refused(rnd: random.Random) -> str:
    if rnd.random() < 0.3:
        return rnd.choice(_REFUSED_PLAIN)
    verb = rnd.choice(["无法", "不能", "不便", "拒绝", "无权", "没有权限", "没办法", "不予", "恕我不作"]) + rnd.choice(["回答", "作答", "回应", "讨论", "谈论", "评论", "解答", "提供任何帮助"])
    return rnd.choice(_REFUSED[1]) + rnd.choice(_REFUSED[2]) + rnd.choice(["", "我"]) + verb + rnd.choice(_REFUSED_END)


def synthesize(pairs: list[tuple[str, str]], seed: int = 11) -> list[tuple[str, str, int]]:
    """(question, reply, label) with label -1 for sound pairs."""
    rnd = random.Random(seed)
    out = []
    spoken: dict[str, list[str]] = {}
    for _, reply in pairs:
        spoken.setdefault(language(reply) or "", []).append(reply)
    spoken.pop("", None)
    for asked, reply in pairs:
        out.append((asked, reply, -1))
        cut = _cut(reply, rnd)
        if cut:
            out.append((asked, cut, 0))
        if rnd.random() < 0.5:
            out.append((asked, _refused(rnd), 1))
        copy = asked
        if rnd.random() < 0.3 and len(asked) > 8:
            i = rnd.randrange(len(asked))
            copy = asked[:i] + asked[i + 1 :]
        frame = rnd.choice(_FRAMES)
        out.append((asked, frame.format(*[copy] * frame.count("{}")), 2))
        foreign = rnd.choice(rnd.choice(_FOREIGN).split("|"))
        others = [name for name in sorted(spoken) if differs(language(asked), name)]
        if others and rnd.random() < 0.5:  # a sound reply to someone else
            foreign = rnd.choice(spoken[rnd.choice(others)])
        elif rnd.random() < 0.25:  # names say nothing about the language
            foreign = f"{rnd.choice(_GOODS)} - {foreign}"
        if differs(language(asked), language(foreign)):
            out.append((asked, foreign, 3))
    return out


def field_records(candidate: DataFrame, repair_group: DataFrame) -> DataFrame:
    """`record_kind, record_id, field, reply, asked` of both tables."""
    last = F.when(F.size("context") > 0, F.element_at("context", -1))
    one = candidate.select(F.lit("candidate").alias("record_kind"), F.col("line_no").alias("record_id"), F.lit("response").alias("field"), F.col("response").alias("reply"), last.alias("asked"))
    pair = F.explode(F.array(F.struct(F.lit("chosen").alias("field"), F.col("chosen").alias("reply")), F.struct(F.lit("rejected").alias("field"), F.col("rejected").alias("reply"))))
    two = repair_group.select(F.lit("repair_group").alias("record_kind"), F.col("repair_id").alias("record_id"), last.alias("asked"), pair.alias("x"))
    return one.unionByName(two.select("record_kind", "record_id", "x.field", "x.reply", "asked"))


def count_endings(turns: DataFrame, replies: DataFrame) -> np.ndarray:
    """Sketches of how texts end, over all turns and all replies."""
    both = turns.select(F.col("text"), F.lit(True).alias("turn")).unionByName(replies.select("text", F.lit(False).alias("turn")))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((3, ENDINGS), np.int64)
        for pdf in batches:
            for text, turn in zip(pdf["text"], pdf["turn"]):
                shown = simple(text)
                # A single blank stands between phrases; more of them may stand anywhere.
                for m in _PHRASE_END.findall(shown) + (_BLANK_END.findall(shown) if shown.count(" ") == 1 else []):
                    i = crc32(" ".join(m).encode()) % ENDINGS
                    total[2, i] += 1
                    total[1, i] += 1
                units, closed = last_units(shown)
                if units:
                    i = ending(units, 3)
                    total[2, i] += 1
                    total[1, i] += closed
                    total[0, i] += turn
        yield sketch.blocks(total.ravel())

    out = sketch.total(both.where("text is not null").mapInPandas(count, sketch.SCHEMA), 3 * ENDINGS)
    return np.minimum(out, 2**31 - 1).astype(np.int32).reshape(3, ENDINGS)


def train(candidate: DataFrame, ends: np.ndarray, key: str = "line_no") -> Model:
    """The classifier, from TRAIN_PAIRS pairs of turns inside contexts."""
    inner = candidate.where(F.size("context") >= 3).select(F.element_at("context", -3).alias("asked"), F.element_at("context", -2).alias("reply"), F.xxhash64(key).alias("h"))
    inner = inner.where("length(trim(asked)) > 1 and length(trim(reply)) > 1").orderBy("h", "asked", "reply").limit(TRAIN_PAIRS)
    pairs = [(r.asked, r.reply) for r in inner.collect()]
    if not pairs:
        return Model(np.zeros((HASHED, len(LABELS)), np.float32), np.zeros((len(WEIGHTS), len(LABELS))), np.full(len(LABELS), 2.0))
    reader, rows = Reader(ends), synthesize(pairs)
    labels = np.zeros((len(rows), len(LABELS)))
    for i, (_, _, k) in enumerate(rows):
        if k >= 0:
            labels[i, k] = 1
    return fit([reader.example(a, reader.fold(b)) for a, b, _ in rows], labels)


class Judge:
    """The defects of fields."""

    def __init__(self, model: Model, ends: np.ndarray, residue: Residue):
        self.model, self.reader, self.residue = model, Reader(ends), residue

    def defects(self, pairs: list[tuple[str | None, str | None]]) -> list[str | None]:
        """The defect of each (question, reply), or None."""
        out: list[str | None] = [None] * len(pairs)
        places, examples = [], []
        for i, (asked, reply) in enumerate(pairs):
            shown = self.reader.fold(reply)
            if not _LETTER.search(shown):
                out[i] = "empty"
                continue
            places.append(i)
            examples.append(self.reader.example(asked, shown))
        over = self.model.scores(examples) >= self.model.thresholds
        for n in np.flatnonzero(over.any(axis=1)):
            i, x = places[n], examples[n]
            names = {name for name, hit in zip(LABELS, over[n]) if hit and self.checked(name, x)}
            if names and not self.residue.kind(pairs[i][1]):
                out[i] = next(name for name in ("copy", "language", "refusal", "truncated") if name in names)
        return out

    @staticmethod
    def checked(name: str, x: Example) -> bool:
        """The exact checks; a refusal has none."""
        if name == "copy":
            return x.signs[5] > 0.8
        if name == "language":
            return x.signs[9] > 0
        return name != "truncated" or x.signs[3] > 0 or not (x.signs[12] or x.signs[13])


def defects(candidate: DataFrame, repair_group: DataFrame) -> DataFrame:
    """`record_kind, record_id, field, defect`."""
    records = field_records(candidate, repair_group)
    turns = candidate.select(F.explode("context").alias("text"))
    ends = count_endings(turns, records.select(F.col("reply").alias("text")))
    model = train(candidate, ends)
    # Residue as problem 4 tells it, from the same records; rejected replies add their names.
    counts, names = anchors(reply_records(candidate, repair_group))
    names = sorted({*names, *marker_names(records.where("field = 'rejected'").select(F.col("reply").alias("text")))})
    counts = np.minimum(counts, 2**31 - 1).astype(np.int32)
    send = candidate.sparkSession.sparkContext.broadcast((model, ends, counts, names))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, ends, counts, names = send.value
        judge = Judge(model, ends, Residue(counts, names))
        for pdf in batches:
            found = pd.Series(judge.defects(list(zip(pdf["asked"], pdf["reply"]))), index=pdf.index, dtype=object)
            hit = found.notna()
            if not hit.any():
                continue
            yield pd.DataFrame({"record_kind": pdf["record_kind"][hit], "record_id": pdf["record_id"][hit], "field": pdf["field"][hit], "defect": found[hit]})

    return records.mapInPandas(run, "record_kind string, record_id long, field string, defect string")
