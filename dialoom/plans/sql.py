"""SQL texts of the cleaning expressions, for checking them in another engine.

Each function takes a SQL expression and returns one. The other engine's patterns
have no look-around and no letters of all scripts in \\w, so classes are spelled out."""

from __future__ import annotations

from dialoom.functions.clean import AGENT_WORDS, EDGE, SPACE, TEMPLATE_STOPS, USER_WORDS
from dialoom.functions.rules import DEFAULT, Pack

#: The space class with the vertical tab, which \s has in one engine only.
WS = SPACE.replace("[\\s", "[\\s\\x{0b}")
#: Characters of words in all scripts.
WORD = r"\p{L}\p{Nl}\p{M}\p{Nd}\p{Pc}\x{200c}\x{200d}"
HAN = "[\\x{4e00}-\\x{9fff}]"


def q(text: str) -> str:
    """A literal."""
    return "'" + text.replace("'", "''") + "'"


def sub(x: str, pattern: str, by: str) -> str:
    return f"regexp_replace({x}, {q(pattern)}, {q(by)}, 'g')"


def strip(x: str) -> str:
    return sub(x, f"^{WS}+|{WS}+$", "")


def squeeze(x: str) -> str:
    return sub(x, "[ \\t]+", " ")


def mask_numbers(x: str) -> str:
    for digits, mask in (("1\\p{Nd}{10}", "<PHONE>"), ("\\p{Nd}{8,}", "<ID>")):
        # Twice: neighbours share the character between them.
        for _ in range(2):
            x = sub(x, f"(^|[^{WORD}]){digits}($|[^{WORD}])", f"\\1{mask}\\2")
    return x


def plain_spaces(x: str) -> str:
    return f"translate({x}, {q(chr(0x3000) + chr(0xA0))}, '  ')"


def plain_marks(x: str) -> str:
    return f"replace(replace(translate({x}, '“”‘’—–', {q(chr(34) * 2 + chr(39) * 2 + '--')}), '…', '...'), '\\', '')"


def normalize(x: str) -> str:
    return strip(sub(squeeze(mask_numbers(plain_marks(plain_spaces(strip(x))))), "([，。！？；、,.!?;:]){2,}", "\\1"))


def join_han(x: str) -> str:
    """A fold over the parts; the last part of what is joined is what follows its last blank."""
    last = "regexp_extract(acc, '[^ ]*$')"
    han = lambda e: f"regexp_matches({e}, {q(HAN)})"
    number = lambda e: f"regexp_matches({e}, '^\\p{{Nd}}+$')"
    glue = f"(({han(last)} AND ({han('p')} OR {number('p')})) OR ({number(last)} AND {han('p')}))"
    parts = f"list_filter(regexp_split_to_array({x}, {q(WS + '+')}), lambda e: e <> '')"
    return f"CASE WHEN len({parts}) = 0 THEN {x} ELSE list_reduce({parts}, lambda acc, p: CASE WHEN {glue} THEN acc || p ELSE acc || ' ' || p END) END"


def clean_turn(x: str) -> str:
    return strip(squeeze(join_han(normalize(x))))


def mask_key(x: str) -> str:
    return sub(sub(clean_turn(x), "20[12][0-9]年?", "<YEAR>"), "\\p{Nd}+", "<NUM>")


def template_key(x: str) -> str:
    out = mask_key(x)
    for word in (*TEMPLATE_STOPS, " "):
        out = f"replace({out}, {q(word)}, '')"
    return strip(sub(out, "[，。！？；：、,.!?;:'\"~～]", ""))


def newlines(x: str) -> str:
    return sub(x, "\\r\\n?", "\\n").replace(q("\\n"), "chr(10)")


def by_line(x: str, change, keep_empty: bool = False) -> str:
    lines = f"list_transform(string_split({x}, chr(10)), lambda l: {change('l')})"
    return f"array_to_string({lines if keep_empty else f'list_filter({lines}, lambda e: e <> {q(str())})'}, chr(10))"


def repair_clean(x: str) -> str:
    text = f"replace({newlines(f'coalesce({x}, {q(str())})')}, chr(65279), '')"
    text = squeeze(f"replace({mask_numbers(plain_spaces(text))}, '\\', '')")
    speaker = f"^({'|'.join(USER_WORDS + AGENT_WORDS)}){WS}*[：:]{WS}*"
    return strip(by_line(text, lambda l: sub(strip(l), speaker, "")))  # noqa: E741


def compact(x: str) -> str:
    return f"replace({repair_clean(x)}, ' ', '')"


def repair_key(x: str) -> str:
    return sub(compact(x), "\\p{Nd}+", "<NUM>")


def light_clean(x: str) -> str:
    text = f"replace(replace({newlines(f'coalesce({x}, {q(str())})')}, chr(65279), ''), ':', '：')"
    text = by_line(text, strip, keep_empty=True)
    text = f"regexp_replace({text}, '\\n{{3,}}', chr(10) || chr(10), 'g')"
    return strip(sub(text, "[ \\x{3000}]{2,}", " "))


def plain_text(x: str) -> str:
    return strip(newlines(f"coalesce({x}, '')"))


def any_of(x: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({x}, {q(w)})" for w in words) + ")" if words else "false"


def hits(x: str, words: tuple[str, ...]) -> str:
    return "(" + " + ".join(f"contains({x}, {q(w)})::INT" for w in words) + ")" if words else "0"


def found(x: str, words: tuple[str, ...]) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN contains({x}, {q(w)}) THEN {q(w)} END" for w in words) + "], lambda e: e IS NOT NULL)"


def tight(x: str) -> str:
    return f"replace({x}, ' ', '')"


def question_strength(x: str, pack: Pack = DEFAULT) -> str:
    return f"(regexp_matches({tight(x)}, '[?？]')::INT + {hits(tight(x), pack.questions)})"


def low_info(x: str, pack: Pack = DEFAULT) -> str:
    text = tight(x)
    return f"({text} IN ({', '.join(map(q, pack.low_info))}) OR length({text}) <= 4 OR (length({text}) <= 8 AND NOT {any_of(text, pack.actions)}))"


def garbage(x: str) -> str:
    text = tight(x)
    return f"({text} = '' OR {text} IN ('<ID>', '<PHONE>', '<NUM>', '<YEAR>') OR regexp_matches({text}, '^[^\\p{{L}}\\p{{Nl}}\\p{{M}}\\p{{Nd}}\\x{{200c}}\\x{{200d}}]+$') OR (regexp_matches({text}, '[A-Za-z]{{2,}}') AND NOT regexp_matches({text}, {q(HAN)})))"


def first_category(kinds, test) -> str:
    return "CASE " + " ".join(f"WHEN {test(words)} THEN {q(name)}" for name, words in kinds) + " ELSE 'other' END"


def tokens(x: str, pack: Pack = DEFAULT) -> str:
    text = f"lower({mask_key(x)})"
    runs = f"regexp_extract_all({text}, '[\\x{{4e00}}-\\x{{9fff}}]{{2,}}|[a-z]{{2,}}|<[a-z]+>')"
    stop = ", ".join(map(q, pack.stop))
    return f"list_filter(list_distinct(list_concat({found(text, pack.topics)}, {runs})), lambda e: e NOT IN ({stop}))"


def keyword_overlap(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) > 0 AND len({b}) > 0 THEN len(list_intersect({a}, {b})) / least(len({a}), len({b}))::DOUBLE ELSE 0 END"


def exact_edge(x: str) -> str:
    return sub(x, f"^{EDGE}+|{EDGE}+$", "")


def clean_output(x: str, most: int = 56) -> str:
    from dialoom.functions.clean import OUTPUT_MARKERS

    text = plain_text(x)
    for marker in OUTPUT_MARKERS:
        text = f"split_part({text}, {q(marker)}, 1)"
    text = strip(sub(strip(text), "(?is)(?:^|\\s)(?:user|assistant|system)\\s*[\\n:：].*$", ""))
    text = sub(text, "[\\x{0e00}-\\x{0e7f}\\x{10000}-\\x{10ffff}]", "")
    text = strip(sub(sub(text, "[A-Za-z]{4,}", ""), f"{WS}+", " "))
    return sub(f"left({text}, {most})", f"{WS}+$", "")


def without_masks(x: str) -> str:
    text = sub(repair_clean(x), f"(?i)(?:一个{WS}*)?<ID>|<PHONE>", "")
    for before in ("一个", "不同", "每个"):
        text = sub(text, f"(?i){before}{WS}*ID", f"{before}账号")
    for _ in range(2):
        text = sub(text, f"(?i)(^|[^{WORD}])ID($|[^{WORD}])", "\\1账号\\2")
    return strip(exact_edge(sub(text, f"{WS}{{2,}}", " ")))


def normalize_masked_first(x: str) -> str:
    return strip(plain_marks(mask_numbers(plain_spaces(strip(x)))))


def mark_spacing(x: str) -> str:
    text = sub(strip(x), f"{WS}*:{WS}*", "：")
    text = sub(text, f"{WS}+([，。！？；：、）】》〉])", "\\1")
    text = sub(text, f"([（【《〈]){WS}+", "\\1")
    text = sub(text, f"([0-9]){WS}*-{WS}*([0-9])", "\\1-\\2")
    return strip(sub(text, " +", " "))


def role_prefix(x: str) -> str:
    text, out = strip(x), "CASE"
    for words, name in ((USER_WORDS, "用户："), (AGENT_WORDS, "客服：")):
        pattern = f"^({'|'.join(words)}){WS}*[：:]"
        out += f" WHEN regexp_matches({text}, {q(pattern)}) THEN {q(name)} || {strip(sub(text, pattern + WS + '*', ''))}"
    return out + f" ELSE {text} END"


def clean_document(x: str) -> str:
    text = newlines(normalize_masked_first(x))
    text = f"regexp_replace({text}, '\\n{{3,}}', chr(10) || chr(10), 'g')"
    steps = f"list_filter(list_transform(string_split({text}, chr(10)), lambda l: {mark_spacing('l')}), lambda l: l <> '')"
    joined = f"list_transform({steps}, lambda l: {join_han('l')})"
    return strip(f"array_to_string(list_filter(list_transform({joined}, lambda l: {role_prefix('l')}), lambda l: l <> ''), chr(10))")
