"""What a reader sees: one visible form per text.

`Fold` deletes ignorable characters, undoes width, block and composition
variants and resolves look-alike letters; it keeps everything that is visible
(case, blanks, accents, circled or raised figures)."""

from __future__ import annotations

import math
import re
import sys
import unicodedata
from functools import lru_cache

#: Letters of one shape in Latin, Greek and Cyrillic (the Unicode
#: confusables data lists them); "." where a script has none.
LOOKALIKES = (
    "AΑА BΒВ C.С EΕЕ HΗН IΙІ J.Ј KΚК MΜМ NΝ. OΟО PΡР S.Ѕ TΤТ XΧХ YΥҮ ZΖ. "
    "a.а c.с e.е h.һ i.і j.ј oοо p.р q.ԛ s.ѕ vν. w.ԝ x.х y.у d.ԁ "
    ".ΓГ .ΠП .ΦФ .ΛЛ .κк"
).split()
SCRIPTS = ("latin", "greek", "cyrillic")

#: Further letters with the shape of another (first of each pair is kept).
SAME_SHAPE = {"Ð": "Đ", "Ɖ": "Đ", "ɡ": "g", "ϲ": "c", "Ϲ": "C", "Ӏ": "I", "ӏ": "l", "ո": "n", "օ": "o", "Օ": "O", "Ꭺ": "A", "Ꭲ": "T", "ℓ": "l"}

#: Radicals of the supplement that have the shape of a unified ideograph.
RADICALS = {
    "⺁": "厂", "⺇": "几", "⺌": "小", "⺎": "兀", "⺐": "尢", "⺓": "幺", "⺕": "彐", "⺖": "忄", "⺗": "心", "⺘": "扌", "⺙": "攵", "⺝": "月",
    "⺟": "母", "⺠": "民", "⺡": "氵", "⺢": "氺", "⺣": "灬", "⺨": "犭", "⺩": "王", "⺪": "疋", "⺫": "目", "⺬": "示", "⺭": "礻", "⺮": "竹",
    "⺯": "糹", "⺰": "纟", "⺱": "罒", "⺶": "羊", "⺷": "羋", "⺹": "耂", "⺺": "肀", "⺼": "月", "⺽": "臼", "⺾": "艹", "⻁": "虎", "⻂": "衤",
    "⻃": "覀", "⻄": "西", "⻅": "见", "⻆": "角", "⻈": "讠", "⻉": "贝", "⻋": "车", "⻌": "辶", "⻍": "辶", "⻎": "辶", "⻏": "阝", "⻐": "钅",
    "⻑": "長", "⻒": "镸", "⻓": "长", "⻔": "门", "⻖": "阝", "⻘": "青", "⻙": "韦", "⻚": "页", "⻛": "风", "⻜": "飞", "⻝": "食", "⻟": "飠",
    "⻠": "饣", "⻢": "马", "⻣": "骨", "⻤": "鬼", "⻥": "鱼", "⻦": "鸟", "⻧": "卤", "⻨": "麦", "⻩": "黄", "⻪": "黾", "⻫": "斉", "⻬": "齐",
    "⻭": "歯", "⻮": "齿", "⻯": "竜", "⻰": "龙", "⻱": "龜", "⻲": "亀", "⻳": "龟",
}

_KEPT_CONTROLS = "\t\n\r\v\f\x85"
_IGNORED = [0x00AD, 0x034F, 0x061C, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, 0xFEFF, *range(0x180B, 0x1810), *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2070), *range(0xFE00, 0xFE10), *range(0xE0000, 0xE1000)]


def _digraph(ch: str) -> bool:
    """A letter that is two Latin letters side by side, like the digraphs of Croatian."""
    plain = unicodedata.normalize("NFKD", ch)
    letters = [c for c in plain if c.isalpha()]
    return len(letters) == 2 and "LATIN" in unicodedata.name(ch, "") and all("LATIN" in unicodedata.name(c, "") for c in letters)


def _simple_map() -> dict[int, str | None]:
    """Per code point: deleted, a plain blank, or the same shape elsewhere."""
    out: dict[int, str | None] = {}
    for code in range(sys.maxunicode + 1):
        if 0xD800 <= code < 0xE000 or 0x20000 <= code < 0x2F800 or 0x3400 <= code < 0xA000 or 0xAC00 <= code < 0xD7A4 or 0x30000 <= code < 0xE0000:
            continue
        ch = chr(code)
        kind = unicodedata.category(ch)
        if kind == "Zs":
            out[code] = " "
        elif kind in ("Zl", "Zp") or ch == "\x85":
            out[code] = "\n"
        elif kind in ("Cf", "Cc") and ch not in _KEPT_CONTROLS:
            out[code] = None
        else:
            tag, _, rest = unicodedata.decomposition(ch).partition(" ")
            if tag in ("<wide>", "<narrow>"):
                out[code] = unicodedata.normalize("NFKC", ch)
            elif tag == "<compat>" and (0x2E80 <= code < 0x2FE0 or unicodedata.name(ch, "").startswith(("LATIN SMALL LIGATURE", "LATIN CAPITAL LIGATURE", "ROMAN NUMERAL", "SMALL ROMAN NUMERAL")) or _digraph(ch)):
                # Radicals, and letters that are written as several plain ones.
                out[code] = unicodedata.normalize("NFKC", ch)
            elif 0xF900 <= code < 0xFB00 or 0x2F800 <= code < 0x2FA20:
                out[code] = unicodedata.normalize("NFC", ch)
            elif code in (0x2010, 0x2011):
                out[code] = "-"
    out.update((code, None) for code in _IGNORED)
    out.update((ord(a), b) for a, b in (SAME_SHAPE | RADICALS).items())
    out[0xFFE3], out[0xFF5E], out[0x301C] = "¯", "~", "~"
    out[0x20] = " "
    return {a: b for a, b in out.items() if b != chr(a)}


SIMPLE = _simple_map()


def _char_class(codes: list[int]) -> str:
    """A pattern class of code points, neighbours as ranges."""
    out, start = [], None
    for code, after in zip(codes, [*codes[1:], -1]):
        start = code if start is None else start
        if after != code + 1:
            out.append(re.escape(chr(start)) + ("-" + re.escape(chr(code)) if code > start else ""))
            start = None
    return f"[{''.join(out)}]"


_MAPPED = re.compile(_char_class(sorted(SIMPLE)))
_BY_CHAR = {chr(code): to or "" for code, to in SIMPLE.items()}


def simple(text: str) -> str:
    """`text` under the per-character map. Few characters of a text are mapped, so
    looking for them is faster than asking for each."""
    return _MAPPED.sub(lambda m: _BY_CHAR[m.group()], text)

_LETTERS = "A-Za-zªºÀ-ɏɐ-ʯ̀-ͯͰ-ԯᲀ-᲏ᴀ-ᶿḀ-῿Ⱡ-ⱿꙀ-ꚟ꜠-ꟿµ"
TOKEN = re.compile(f"[{_LETTERS}]+")
#: Anything that needs more than the per-character map: marks, letters beyond plain Latin, jamo.
_COMPOSE = re.compile("[ª-ͯͰ-ԯ֐-႟ᄀ-ᇿᲀ-᲏ᴀ-῿Ⱡ-Ɀ〪-゚Ꙁ-ꟿ⃐-⃿KÅΩ\U00011000-\U00011fff]")
_NEWLINE = re.compile("\r\n?")

_CLASS = {ch: "".join(group) for group in LOOKALIKES for ch in group if ch != "."}
_SCRIPT: dict[str, int] = {}


def script_of(ch: str) -> int:
    """0 Latin, 1 Greek, 2 Cyrillic, -1 a mark or other."""
    got = _SCRIPT.get(ch)
    if got is None:
        name = unicodedata.name(ch, "")
        got = 0 if name.startswith("LATIN") or ch in "ªº" else 1 if name.startswith("GREEK") or ch == "µ" else 2 if name.startswith("CYRILLIC") else -1
        _SCRIPT[ch] = got
    return got


def bigrams_of(token: str) -> tuple[int, list[str]] | None:
    """Script and bigrams (with edges) of a token of one script; None if mixed."""
    letters = [c for c in token if script_of(c) >= 0]
    kinds = {script_of(c) for c in letters}
    if len(kinds) != 1:
        return None
    text = "^" + "".join(letters) + "$"
    return kinds.pop(), [text[i : i + 2] for i in range(len(text) - 1)]


class Fold:
    """Visible forms under character bigram scores.

    `counts` maps (script, bigram) to its count in the corpus. For a token the
    lattice holds, per position, the letters of the same shape in each script;
    Viterbi picks the path with the best bigram score, where leaving a script
    inside a token costs more than any score can win back. The lattice is built
    from shapes alone, so two tokens that look alike get the same path."""

    SWITCH = -60.0
    CONTEXT = 6.0

    def __init__(self, counts: dict[tuple[int, str], int] | None = None):
        counts = counts or {}
        self.totals = [1.0, 1.0, 1.0]
        first: dict[tuple[int, str], int] = {}
        for (script, gram), n in counts.items():
            first[script, gram[0]] = first.get((script, gram[0]), 0) + n
            if gram[0] == "^":
                self.totals[script] += n
        self.logs = {key: math.log((n + 0.1) / (first[key[0], key[1][0]] + 8.0)) for key, n in counts.items()}
        self.floor = {key: math.log(0.1 / (n + 8.0)) for key, n in first.items()}
        self.prior = [math.log(n / sum(self.totals)) for n in self.totals]
        self.resolve = lru_cache(200_000)(self._resolve)

    def _log(self, script: int, a: str, b: str) -> float:
        got = self.logs.get((script, a + b))
        return got if got is not None else self.floor.get((script, a), -5.0)

    def _resolve(self, shape: str, lean: tuple[int, int, int]) -> str:
        """Best letters for a token given in shape form (NFD); `lean` counts the
        tokens of each script in the same text that leave no choice."""
        spots = [i for i, ch in enumerate(shape) if ch in _CLASS or script_of(ch) >= 0]
        if not spots:
            return shape
        seen = sum(lean) + 1.5
        start = [self.prior[s] + self.CONTEXT * math.log((lean[s] + 0.5) / seen) for s in range(3)]
        paths: dict[int, tuple[float, str, str]] = {}
        for k, i in enumerate(spots):
            group = _CLASS.get(shape[i])
            options = [(s, c) for s, c in enumerate(group) if c != "."] if group else [(script_of(shape[i]), shape[i])]
            now: dict[int, tuple[float, str, str]] = {}
            for s, c in options:
                if k == 0:
                    now[s] = (start[s] + self._log(s, "^", c), c, c)
                    continue
                best = None
                for t, (score, path, last) in paths.items():
                    value = score + (self._log(s, last, c) if s == t else self.SWITCH)
                    if best is None or value > best[0]:
                        best = (value, path + c, c)
                now[s] = best
            paths = now
        score, path, _ = max(((v + self._log(s, last, "$"), path, s) for s, (v, path, last) in paths.items()), key=lambda x: (x[0], -x[2]))
        out = list(shape)
        for i, ch in zip(spots, path):
            out[i] = ch
        return "".join(out)

    def __call__(self, text: str | None) -> str:
        """The visible form; a null text counts as empty."""
        if not text:
            return ""
        out = text if text.isascii() and "\r" not in text and not _CONTROL.search(text) else _NEWLINE.sub("\n", simple(text))
        # Without a letter beyond plain Latin there is no reading but the Latin one.
        if not _COMPOSE.search(out):
            return out
        out = simple(unicodedata.normalize("NFD", out))
        lean = self._lean(TOKEN.findall(out))
        return unicodedata.normalize("NFC", TOKEN.sub(lambda m: self._token(m.group(), lean), out))

    def _lean(self, tokens: list[str]) -> tuple[int, int, int]:
        """How many tokens only Latin, Greek or Cyrillic can write, up to 3 each."""
        lean = [0, 0, 0]
        for token in tokens:
            known = _forced(token)
            if known >= 0:
                lean[known] = min(3, lean[known] + 1)
        return tuple(lean)

    def _token(self, token: str, lean: tuple[int, int, int]) -> str:
        # A text that no word ties to another script is read as Latin.
        shape = _shape(token)
        return self.resolve(shape, lean) if lean[1] or lean[2] else _latin(shape)


_CONTROL = re.compile("[\x00-\x08\x0e-\x1f\x7f]")


@lru_cache(200_000)
def _shape(token: str) -> str:
    """The token with each look-alike replaced by the first letter of its group."""
    return "".join(_first(_CLASS[c]) if c in _CLASS else c for c in token)


@lru_cache(200_000)
def _latin(shape: str) -> str:
    """Latin letters where the shape has them."""
    return "".join(_CLASS[c][0] if c in _CLASS and _CLASS[c][0] != "." else c for c in shape)


def _first(group: str) -> str:
    return next(c for c in group if c != ".")


@lru_cache(200_000)
def _forced(token: str) -> int:
    """The only script that can write the whole token, or -1."""
    able = {0, 1, 2}
    for ch in token:
        group = _CLASS.get(ch)
        if group:
            able &= {s for s, c in enumerate(group) if c != "."}
        elif script_of(ch) >= 0:
            able &= {script_of(ch)}
    return able.pop() if len(able) == 1 else -1
