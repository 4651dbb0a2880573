"""Text cleaning as column expressions; everything stays in generated code.

Patterns carry (?U) where letters, digits or blanks of all scripts count."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Blanks of all kinds, the ones Python strips; U+001C-U+001F are not in \s.
SPACE = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: The same one by one.
BLANKS = "\t\n\x0b\x0c\r \x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
#: Blanks at the end. The look-behind keeps long runs inside a text linear.
TRAILING = f"(?<!{SPACE}){SPACE}+$"
#: Marks at the edges of a reply.
EDGE = r"[ ，。！？；!?,;]"
#: Particles and greetings that a template key leaves out, in this order.
TEMPLATE_STOPS = ("亲亲", "亲", "哦", "呢", "呀", "哈", "啦", "哟", "呐", "客官", "小二", "您好", "你好")
#: Where a generated text is cut off.
OUTPUT_MARKERS = ("<|im_end|>", "<|im_start|>user", "<|im_start|>assistant", "<|im_start|>system", "\nuser\n", "\nassistant\n", "\nsystem\n", "</s>", "<|endoftext|>")
#: Names of the two speakers.
USER_WORDS, AGENT_WORDS = ("用户", "买家", "顾客"), ("客服", "商家", "店主", "掌柜", "小二", "卖家")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(c: Column, body) -> Column:
    """`body` of a value that is evaluated once, however often `body` names it.
    Without it a plan grows with each use of a long expression."""
    return F.transform(F.array(c), body).getItem(0)


def strip(c: Column | str) -> Column:
    """Without blanks of any kind at both ends."""
    return F.btrim(col(c), F.lit(BLANKS))


def squeeze(c: Column) -> Column:
    return F.regexp_replace(c, "[ \t]+", " ")


def mask_numbers(c: Column) -> Column:
    """Phone numbers and other long numbers that stand alone as masks."""
    return F.regexp_replace(F.regexp_replace(c, r"(?U)\b1\d{10}\b", "<PHONE>"), r"(?U)\b\d{8,}\b", "<ID>")


def plain_marks(c: Column) -> Column:
    """Typographic quotes, dashes and ellipses in plain form, no backslashes."""
    return F.replace(F.replace(F.translate(c, "“”‘’—–", "\"\"''--"), F.lit("…"), F.lit("...")), F.lit("\\"), F.lit(""))


def plain_spaces(c: Column) -> Column:
    return F.translate(c, "　 ", "  ")


def normalize(c: Column | str) -> Column:
    """Cleaning of the selector: marks, masks, blanks, then runs of punctuation
    as their last mark."""
    out = mask_numbers(plain_marks(plain_spaces(strip(c))))
    return strip(F.regexp_replace(squeeze(out), "[，。！？；、,.!?;:]+(?=[，。！？；、,.!?;:])", ""))


def normalize_masked_first(c: Column | str) -> Column:
    """Cleaning of the converter: masks before marks, blanks as they are."""
    return strip(plain_marks(mask_numbers(plain_spaces(strip(c)))))


def join_han(c: Column) -> Column:
    """Blanks between Han text and Han text or numbers removed: a fold from the
    left, as the left side is what has been joined so far."""
    han = lambda x: x.rlike("[一-鿿]")
    number = lambda x: x.rlike(r"(?U)^\d+$")
    state = F.struct(F.lit("").alias("done"), F.lit("").alias("last"))

    def step(s: Column, x: Column) -> Column:
        def joined(glue: Column) -> Column:
            first = s["last"] == ""
            done = F.when(first | glue, s["done"]).otherwise(F.concat(s["done"], s["last"], F.lit(" ")))
            return F.struct(done.alias("done"), F.when(glue & ~first, F.concat(s["last"], x)).otherwise(x).alias("last"))

        return let((han(s["last"]) & (han(x) | number(x))) | (number(s["last"]) & han(x)), joined)

    def folded(text: Column) -> Column:
        parts = F.filter(F.split(text, f"{SPACE}+"), lambda x: x != "")
        return F.aggregate(parts, state, step, lambda s: F.concat(s["done"], s["last"]))

    # Most texts have no blank inside, and need no fold.
    return let(c, lambda t: F.when(t.rlike(SPACE), folded(t)).otherwise(t))


#: What cleaning of a turn can change: blanks, marks with a plain form, two marks
#: in a row, eight figures in a row. Most turns have none of it.
CHANGES = SPACE[:-1] + r"“”‘’—–…\\]|[，。！？；、,.!?;:]{2}|\p{Nd}{8}"


def clean_turn(c: Column | str) -> Column:
    """A turn as the selector compares it."""
    return let(col(c), lambda t: F.when(t.rlike(CHANGES), strip(squeeze(join_han(normalize(t))))).otherwise(t))


def mask_key(c: Column | str) -> Column:
    """A turn with years and numbers masked, for grouping."""
    masked = lambda t: F.regexp_replace(F.regexp_replace(t, "20[12][0-9]年?", "<YEAR>"), r"(?U)\d+", "<NUM>")
    return let(clean_turn(c), lambda t: F.when(t.rlike(r"\p{Nd}"), masked(t)).otherwise(t))


def template_key(c: Column | str) -> Column:
    """What replies of one template have in common. The deletions go one after
    the other: one may make the next possible."""
    return template_of(mask_key(c))


def template_of(out: Column) -> Column:
    """The template key of a masked text."""
    for word in (*TEMPLATE_STOPS, " "):
        out = F.replace(out, F.lit(word), F.lit(""))
    return strip(F.regexp_replace(out, "[，。！？；：、,.!?;:'\"~～]", ""))


def role_prefix(c: Column | str) -> Column:
    """A leading speaker in one of two standard forms."""
    rest = lambda t, words: strip(F.regexp_replace(t, f"^({'|'.join(words)}){SPACE}*[：:]{SPACE}*", ""))
    is_ = lambda t, words: t.rlike(f"^({'|'.join(words)}){SPACE}*[：:]")
    return let(strip(c), lambda t: F.when(is_(t, USER_WORDS), F.concat(F.lit("用户："), rest(t, USER_WORDS))).when(is_(t, AGENT_WORDS), F.concat(F.lit("客服："), rest(t, AGENT_WORDS))).otherwise(t))


def mark_spacing(c: Column | str) -> Column:
    """Full-width colons, no blanks inside brackets and before marks."""
    out = F.regexp_replace(strip(c), f"(?<!{SPACE}){SPACE}*:{SPACE}*", "：")
    out = F.regexp_replace(out, f"(?<!{SPACE}){SPACE}+([，。！？；：、）】》〉])", "$1")
    out = F.regexp_replace(out, f"([（【《〈]){SPACE}+", "$1")
    out = F.regexp_replace(out, f"(\\d){SPACE}*-{SPACE}*(\\d)", "$1-$2")
    return strip(F.regexp_replace(out, " +", " "))


def newlines(c: Column) -> Column:
    return F.regexp_replace(c, "\r\n?", "\n")


def by_line(c: Column, change, keep_empty: bool = False) -> Column:
    """Each line changed on its own; empty results left out."""
    lines = F.transform(F.split(c, "\n"), change)
    return F.array_join(lines if keep_empty else F.filter(lines, lambda x: x != ""), "\n")


def clean_document(c: Column | str) -> Column:
    """Multi-line cleaning of the converter."""
    text = F.regexp_replace(newlines(normalize_masked_first(c)), "\n{3,}", "\n\n")
    return strip(by_line(text, lambda x: F.when(strip(x) == "", "").otherwise(role_prefix(join_han(mark_spacing(strip(x)))))))


def without_task(c: Column | str, task: str = "请根据下面的电商客服历史对话[，,]生成下一句合适的客服回复。") -> Column:
    """Without the fixed instruction at the start."""
    return strip(F.regexp_replace(light_clean(c), f"^{SPACE}*{task}{SPACE}*", ""))


def without_agent(c: Column | str) -> Column:
    """Without one leading agent marker."""
    return strip(F.regexp_replace(strip(c), "^客服[：:]", ""))


def light_clean(c: Column | str) -> Column:
    """Line ends, full-width colons, stripped lines; null counts as empty."""
    text = F.replace(F.replace(newlines(F.coalesce(col(c), F.lit(""))), F.lit("\ufeff"), F.lit("")), F.lit(":"), F.lit("："))
    text = F.regexp_replace(by_line(text, strip, keep_empty=True), "\n{3,}", "\n\n")
    return strip(F.regexp_replace(text, "[ 　]{2,}", " "))


def repair_clean(c: Column | str) -> Column:
    """Cleaning of the repair job: masks, no speakers, no empty lines; null counts
    as empty."""
    text = F.replace(newlines(F.coalesce(col(c), F.lit(""))), F.lit("\ufeff"), F.lit(""))
    text = squeeze(F.replace(mask_numbers(plain_spaces(text)), F.lit("\\"), F.lit("")))
    speaker = f"^({'|'.join(USER_WORDS + AGENT_WORDS)}){SPACE}*[：:]{SPACE}*"
    return strip(by_line(text, lambda x: F.regexp_replace(strip(x), speaker, "")))


def compact(c: Column | str) -> Column:
    return F.replace(repair_clean(c), F.lit(" "), F.lit(""))


def repair_key(c: Column | str) -> Column:
    return F.regexp_replace(compact(c), r"(?U)\d+", "<NUM>")


def without_masks(c: Column | str) -> Column:
    """A reply without masks, with account wording in place of "ID"."""
    text = F.regexp_replace(repair_clean(c), f"(?i)(?:一个{SPACE}*)?<ID>|<PHONE>", "")
    for before in ("一个", "不同", "每个"):
        text = F.regexp_replace(text, f"(?i){before}{SPACE}*ID", f"{before}账号")
    text = F.regexp_replace(text, r"(?iU)\bID\b", "账号")
    text = F.regexp_replace(text, f"{SPACE}{{2,}}", " ")
    return strip(F.regexp_replace(text, f"^{EDGE}+|{EDGE}+$", ""))


def context_key(c: Column | str, clean=repair_clean, glue: str = "\n") -> Column:
    return F.array_join(F.transform(col(c), clean), glue)


def masked_context(c: Column | str) -> Column:
    """The grouping key of a context."""
    return context_key(c, mask_key, " || ")


def plain_text(c: Column | str) -> Column:
    """Line ends and edges only; null counts as empty; no NUL characters."""
    return strip(F.replace(newlines(F.coalesce(col(c), F.lit(""))), F.lit("\u0000"), F.lit("")))


def clean_output(c: Column | str, most: int = 56) -> Column:
    """A generated text cut at the first marker of a next turn, without astral
    characters, Thai and long Latin words, at most `most` characters (0: all)."""
    text = plain_text(c)
    for marker in OUTPUT_MARKERS:
        text = F.substring_index(text, marker, 1)
    text = strip(F.regexp_replace(strip(text), r"(?is)(?:^|\s)(?:user|assistant|system)\s*[\n:：].*$", ""))
    text = F.regexp_replace(text, r"[\x{0e00}-\x{0e7f}\x{10000}-\x{10ffff}]", "")
    text = strip(F.regexp_replace(F.regexp_replace(text, "[A-Za-z]{4,}", ""), f"{SPACE}+", " "))
    return F.regexp_replace(F.left(text, F.lit(most)), TRAILING, "") if most else text


def trim_tail(c: Column | str, repeated: str = "(请核对一下收货地址[，。！ ]*){2,}", tail: str = "[，。！ ]*请(您)?核对一下收货地址.*$") -> Column:
    """struct(text, issues): repeated or trailing boilerplate cut off; the
    original where nothing would be left."""
    edge = "[ ，。！？；、,.!?;:'\"~～]"
    bare = lambda t: F.regexp_replace(t, f"^{edge}+|{edge}+$", "")

    def trimmed(x: Column) -> Column:
        polite = strip(squeeze(bare(F.regexp_replace(x["cut"], "(好的|嗯嗯|恩恩|哦哦|亲亲){2,}$", ""))))
        issues = F.array(F.when(x["once"] != x["original"], F.lit("dedup_address_tail")), F.when(x["cut"] != bare(x["once"]), F.lit("trim_address_tail")))
        return F.struct(F.when(polite == "", x["original"]).otherwise(polite).alias("text"), F.filter(issues, lambda i: i.isNotNull()).alias("issues"))

    first = let(strip(c), lambda t: F.struct(t.alias("original"), F.regexp_replace(t, repeated, "请核对一下收货地址").alias("once")))
    return let(let(first, lambda x: F.struct(x["original"].alias("original"), x["once"].alias("once"), bare(F.regexp_replace(x["once"], tail, "")).alias("cut"))), trimmed)


def cell(c: Column | str, most: int = 120) -> Column:
    """Text for a table cell: one line, pipes escaped, cut with an ellipsis."""
    text = F.replace(strip(F.regexp_replace(F.coalesce(col(c).cast("string"), F.lit("")), f"{SPACE}+", " ")), F.lit("|"), F.lit("\\|"))
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most - 3)), F.lit("..."))).otherwise(text)


def optional_path(c: Column | str) -> Column:
    """A path, or null for the usual words for none."""
    text = strip(c)
    return F.when(F.lower(text).isin("", "none", "null", "base", "no_adapter"), None).otherwise(text)
