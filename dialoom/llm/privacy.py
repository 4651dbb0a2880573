"""Problem 5: personal data in free text, replaced by typed placeholders.

Information-theoretic sanitisation. A first pass over the corpus collects spans
that are personal beyond doubt (check digits, fixed formats, fields named for a
recipient) and counts how terms go together with them: characters of names, and
the words before an identity number. The disclosure of a term is
log2(P(term | protected) / P(term)); terms above the threshold are taken as
personal wherever they stand and are replaced by a placeholder for their kind.

Defined cases: null texts and turns stay null and have no finding; masks of the
project (<PHONE>, ...) are none; text is read whole, in visible form, with or
without blanks between its characters; repeated rows are each reported; an empty
table gives no rows; further columns are ignored."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from dialoom.llm.forms import Fold

#: Bits of disclosure from which a character belongs to names, and a context to
#: identity numbers; a term must have been seen so often with a protected span.
NAME_BITS, CONTEXT_BITS, SEEN = 3.0, 3.0, 2
#: Letters of the context of a number.
CONTEXT = 3
PLACEHOLDERS = {"email": "<EMAIL>", "phone": "<PHONE>", "idnum": "<IDNUM>", "address": "<ADDRESS>", "name": "<NAME>"}

_AT = r"(?:\s{0,2}@\s{0,2}|\s?[\(\[]at[\)\]]\s?)"
EMAIL = re.compile(
    rf"(?<![A-Za-z0-9._+-])[A-Za-z0-9][A-Za-z0-9._+-]{{0,63}}(?:{_AT}(?:[A-Za-z0-9-]+(?:\.|\s+dot\s+|[\(\[]dot[\)\]]))+[A-Za-z]+|\s+at\s+(?:[A-Za-z0-9-]+\s+dot\s+)+[A-Za-z]+)", re.I
)
PHONE = re.compile(
    r"(?<![A-Za-z\d.@_-])(?:(?:\(?\+?86\)?[\s-]?)?1[3-9]\d[\s-]?\d{4}[\s-]?\d{4}(?!\d)"
    r"|(?:\(\+\d{1,3}\)|\+\d{1,3})[\s-]?\(?\d{2,5}\)?[\s-]?\d{3,4}(?:[\s-]?\d{2,4})?(?!\d)|\(\d{3}\)\s?\d{3,4}-\d{4}(?!\d)|0\d{2,3}-\d{7,8}(?![\d-])"
    r"|[一幺][三四五六七八九][零〇一二三四五六七八九幺]{9}(?![零〇一二三四五六七八九]))"
)
ID18 = re.compile(r"(?<![A-Za-z\d])\d{6}[\s-]?(?:19|20)\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])[\s-]?\d{3}[\dXx](?![A-Za-z\d])")
ID9 = re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])", re.A)
PAPER = re.compile(r"(?<![A-Za-z\d-])[A-Z]{1,2}\d{7,8}(?![A-Za-z\d-])", re.I)
_WEIGHTS, _CHECKS = (7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2), "10X98765432"

_AREA = r"(?:[一-鿿]{2,3}省)?(?:[一-鿿]{2,4}市)?(?:[一-鿿]{2,3}[区县镇])?"
_UNIT = r"\d{1,3}(?:栋|幢|座|号楼)(?:\d{1,2}单元)?\d{0,5}室?|\d{1,2}单元\d{1,5}室?|\d{1,3}-\d{1,2}-\d{2,5}(?![\d-]|[cm]?m)"
_STREET = r"[一-鿿]{1,6}?(?:大道|路|街|巷|弄|胡同)\d{1,5}弄?号"
ADDRESS = re.compile(rf"(?:{_AREA}{_STREET}(?:[一-鿿]{{0,8}}(?:{_UNIT}))?|[一-鿿]{{1,8}}(?:\d{{1,3}}(?:栋|幢|座|号楼)(?:\d{{1,2}}单元)?\d{{1,5}}室?|(?<=[苑园里馆区府庭城湾村舍楼邸居])\d{{1,3}}-\d{{1,2}}-\d{{2,5}}(?![\d-]|[cm]?m))(?:,?{_AREA}{_STREET})?)")
_LEAD = re.compile(r"(?:地址)?(?:现?在?住|改?送到|寄到?|改?为|是|核对一下)?")
_ADDRESS_HINT = re.compile(r"[路街巷道弄同]\d{1,5}弄?号|\d(?:栋|幢|座|号楼|单元)|[苑园里馆区府庭城湾村舍楼邸居]\d{1,3}-\d{1,2}-\d")
STREET = re.compile(
    r"(?:\bflat \d{1,4},\s*)?\b\d{1,4},? (?:[A-Za-z][a-z]+ ){1,3}(?:street|lane|road|avenue|court|hill|boulevard)\b(?:,\s*[A-Za-z]+(?: [A-Z][a-z]+)?)?(?: [A-Z]\d{1,2} \d[A-Z]{2})?|\bflat \d{1,4}, \d{1,4} (?:[A-Za-z]+ ){1,3}[A-Za-z]+"
    r"|\b\d{1,4} (?:[A-Z][a-z]+ ){1,3}(?:Way|Drive|Close|Place|Terrace|Square|Row|Crescent|St|Rd|Ave)\b",
    re.I,
)
_ENGLISH = re.compile(r"\d,? [A-Za-z]+ [A-Za-z]+")
_STRICT_STREET = re.compile(r"(?:way|drive|close|place|terrace|square|row|crescent|st|rd|ave)$", re.I)

_HAN = "[一-鿿]"
#: Fields and phrases whose content is a name beyond doubt.
SURE_NAME = re.compile(rf"(?:收件人|收货人|联系人)[:=]({_HAN}{{2,4}})(?=[\n;|/,。]|$)|登记在({_HAN}{{2,4}})名下|签收的是({_HAN}{{2,4}})本人|我叫({_HAN}{{2,4}})(?=[,。!?~\n]|$)")
_ENGLISH_NAME = re.compile(r"\b(?:my name is|i am called|name:)\s+([A-Za-z][\w'’-]+(?:\s+[A-Za-z][\w'’-]+){1,2})", re.I)
_HINT = re.compile(r"@|\b[aA][tT]\b|\d{3}[\d\s-]{5}|\d-\d|[零〇一二三四五六七八九幺]{9}|[nN][aA][mM][eE]|[cC][aA][lL][lL][eE][dD]|fl|FL|Fl|fL|\d,? [A-Za-z]+ [A-Za-z]+|[A-Za-z]\d{7}")
_SPACES = re.compile(r"[ \t　]+")
_HAN_SPACE = re.compile(rf"(?<={_HAN})[ \t]+(?=[\w(+])|(?<=[\w)])[ \t]+(?={_HAN})")


def valid_id(text: str) -> bool:
    """Check digit of an 18-figure identity number."""
    s = re.sub(r"[\s-]", "", text)
    return _CHECKS[sum(int(a) * b for a, b in zip(s, _WEIGHTS)) % 11] == s[17].upper()


def context_of(text: str, start: int) -> str:
    """The last letters before a place, without blanks and marks."""
    return "".join(c for c in text[max(0, start - 12) : start] if c.isalpha())[-CONTEXT:].lower()


def collect(texts: list[str]) -> dict[str, Counter]:
    """Counts of terms, and of terms with protected spans, in shown texts."""
    chars, inside, first, pairs, contexts, near = Counter(), Counter(), Counter(), Counter(), Counter(), Counter()
    chars.update("".join(texts))
    for text in texts:
        tight = _SPACES.sub("", text)
        if "收" in tight or "叫" in tight or "名下" in tight or "联系人" in tight:
            for m in SURE_NAME.finditer(tight):
                name = next(g for g in m.groups() if g)
                inside.update(name)
                first[name[0]] += 1
                if len(name) == 4:
                    pairs[name[:2]] += 1
        for m in _NUMBER.finditer(text) if _LONG.search(text) else ():
            term = context_of(text, m.start())
            contexts[term] += 1
            if ID18.fullmatch(m.group()) and valid_id(m.group()) or ID9.fullmatch(m.group()):
                near[term] += 1
    han = Counter({c: n for c, n in chars.items() if "一" <= c <= "鿿"})
    return {"char": han, "inside": inside, "first": first, "pair": pairs, "context": contexts, "near": near}


_NUMBER = re.compile(rf"{ID18.pattern}|(?<![\w-])\d{{3}}-\d{{2}}-\d{{4}}(?![\w-])|(?<![A-Za-z\d-])[A-Za-z]{{0,2}}\d{{7,18}}(?![A-Za-z\d-])")


_LONG = re.compile(r"\d{6}|\d-\d\d-\d")


class Disclosure:
    """Terms that disclose a protected entity, from corpus counts."""

    def __init__(self, counts: dict[str, dict[str, int]]):
        char, inside, first, pair = (counts.get(k, {}) for k in ("char", "inside", "first", "pair"))
        total, held = sum(char.values()) or 1, sum(inside.values()) or 1
        bits = {c: math.log2(n / held) - math.log2(max(char.get(c, 0), n) / total) for c, n in inside.items() if n >= SEEN}
        given = "".join(sorted(c for c, b in bits.items() if b >= NAME_BITS))
        names = sorted(c for c, n in first.items() if n >= SEEN and bits.get(c, 0) >= NAME_BITS)
        double = sorted(p for p, n in pair.items() if n >= SEEN and p[0] not in names or n >= SEEN and p[1] not in given)
        heads = "|".join(map(re.escape, double + names))
        # Compound surnames may be made of common characters: the pair is the term.
        self.given = set(given)
        self.name = re.compile(rf"(?:{heads})[{given}]{{1,3}}") if heads and given else None
        context, near = counts.get("context", {}), counts.get("near", {})
        every, protected = sum(context.values()) or 1, sum(near.values()) or 1
        self.contexts = {t for t, n in near.items() if t and n >= SEEN and math.log2(n / protected) - math.log2(context[t] / every) >= CONTEXT_BITS}


class Finder:
    """Personal data in one text."""

    def __init__(self, disclosure: Disclosure):
        self.fold, self.terms = Fold(), disclosure
        self.kinds = lru_cache(60_000)(lambda text: tuple(sorted({k for k, _, _ in self.spans(self.fold(text))})))

    def spans(self, shown: str) -> list[tuple[str, int, int]]:
        """(kind, start, end) in a text in visible form."""
        out: list[tuple[str, int, int]] = []
        tight, at = shown, None
        if " " in shown or "\t" in shown or "\n" in shown:
            keep = [i for i, c in enumerate(shown) if not c.isspace()]
            if len(keep) < len(shown):
                tight, at = "".join([shown[i] for i in keep]), keep
        if _HINT.search(shown):
            if "@" in shown or " at " in shown.lower() or "[at" in shown or "(at" in shown:
                out += [("email", *m.span()) for m in EMAIL.finditer(shown)]
            out += [("phone", *m.span()) for m in PHONE.finditer(shown)]
            for m in ID18.finditer(shown):
                if valid_id(m.group()):
                    out.append(("idnum", *m.span()))
            out += [("idnum", *m.span()) for m in ID9.finditer(shown)]
            for m in PAPER.finditer(shown) if self.terms.contexts else ():
                if context_of(shown, m.start()) in self.terms.contexts:
                    out.append(("idnum", *m.span()))
            for m in STREET.finditer(shown) if _ENGLISH.search(shown) else ():
                if not _STRICT_STREET.search(m.group()) or m.group()[0].isdigit() and re.search(r"\d [A-Z]", m.group()):
                    out.append(("address", *m.span()))
            out += [("name", *m.span(1)) for m in _ENGLISH_NAME.finditer(shown)]
        if _ADDRESS_HINT.search(tight):
            for m in ADDRESS.finditer(tight):
                lead = _LEAD.match(m.group()).end()
                out.append(("address", *self._back((m.start() + lead, m.end()), at)))
        if self.terms.name is not None:
            out += [("name", *self._back(m.span(), at)) for m in self.terms.name.finditer(tight)]
        if "收" in tight or "联系人" in tight or "名下" in tight or "我叫" in tight:
            # Line breaks end a field, so only the other blanks are left out here.
            line, back = _SPACES.sub("", shown) if at else shown, None
            for m in SURE_NAME.finditer(line):
                # Someone may also be called for ("我叫他来拿"); a given name ends in its characters.
                if m.group().startswith("我叫") and m.group()[-1] not in self.terms.given:
                    continue
                if back is None and len(line) < len(shown):
                    back = [i for i, c in enumerate(shown) if not _SPACES.match(c)]
                out.append(("name", *self._back(m.span(m.lastindex), back)))
        return out

    @staticmethod
    def _back(span: tuple[int, int], at: list[int] | None) -> tuple[int, int]:
        return span if at is None else (at[span[0]], at[span[1] - 1] + 1)

    def mask(self, text: str | None) -> str | None:
        """The text in visible form with a placeholder for each span."""
        if not text:
            return text
        shown = self.fold(text)
        spans = sorted(self.spans(shown), key=lambda s: (s[1], -s[2]))
        if not spans:
            return text
        out, last = [], 0
        for kind, start, end in spans:
            if start >= last:
                out += [shown[last:start], PLACEHOLDERS[kind]]
                last = end
            elif end > last:
                last = end
        return "".join(out) + shown[last:]


def disclosure_counts(df: DataFrame, context: str = "context", response: str = "response") -> dict[str, dict[str, int]]:
    """Term counts over the whole corpus. Terms are characters, pairs of them and
    contexts of CONTEXT letters; those never seen with a protected span are not
    sent to the driver, so the result is bounded by the alphabet of names."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fold, total = Fold(), {}
        for pdf in batches:
            texts = [t for turns in pdf[context] if turns is not None for t in turns if t] + [t for t in pdf[response] if t]
            for kind, counts in collect([fold(t) for t in texts]).items():
                total.setdefault(kind, Counter()).update(counts)
        for kind, counts in total.items():
            if counts:
                yield pd.DataFrame({"kind": kind, "term": list(counts), "n": list(counts.values())})

    parts = df.select(context, response).mapInPandas(run, "kind string, term string, n long")
    sums = parts.groupBy("kind", "term").agg(F.sum("n").alias("n"))
    out: dict[str, dict[str, int]] = {}
    every = 0
    sums = sums.persist()
    for r in sums.where("kind <> 'context'").collect():
        out.setdefault(r.kind, {})[r.term] = r.n
    every = sums.where("kind = 'context'").agg(F.sum("n")).first()[0] or 0
    known = [t for t in out.get("near", {})]
    out["context"] = {r.term: r.n for r in sums.where(F.col("kind") == "context").where(F.col("term").isin(known)).collect()} if known else {}
    out["context"][""] = max(0, every - sum(out["context"].values()))
    sums.unpersist()
    return out


def _finder(counts) -> Finder:
    return Finder(Disclosure(counts))


def personal_data(df: DataFrame, key: str = "line_no", context: str = "context", response: str = "response") -> DataFrame:
    """`key, turn_no, kind`: each kind of personal data in each turn (from 0) and
    in the response (-1)."""
    send = df.sparkSession.sparkContext.broadcast(disclosure_counts(df, context, response))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find = _finder(send.value).kinds
        for pdf in batches:
            keys, turns_, kinds = [], [], []
            for k, turns, reply in zip(pdf[key], pdf[context], pdf[response]):
                for i, t in [*enumerate(turns if turns is not None else []), (-1, reply)]:
                    if t:
                        for kind in find(t):
                            keys.append(k)
                            turns_.append(i)
                            kinds.append(kind)
            if keys:
                yield pd.DataFrame({key: keys, "turn_no": turns_, "kind": kinds})

    return df.select(key, context, response).mapInPandas(run, f"{key} long, turn_no int, kind string")


def sanitize(df: DataFrame, key: str = "line_no", context: str = "context", response: str = "response") -> DataFrame:
    """`key, context, response` with typed placeholders."""
    send = df.sparkSession.sparkContext.broadcast(disclosure_counts(df, context, response))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mask = _finder(send.value).mask
        for pdf in batches:
            pdf[context] = [None if turns is None else [mask(t) for t in turns] for turns in pdf[context]]
            pdf[response] = [mask(t) for t in pdf[response]]
            yield pdf

    return df.select(key, context, response).mapInPandas(run, f"{key} long, {context} array<string>, {response} string")
