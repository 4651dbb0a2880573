"""Tests of single texts as boolean columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from dialoom.functions.clean import col, compact, let, mask_key, strip
from dialoom.functions.rules import DEFAULT, Pack, any_of, hits, pattern

HAN = "[一-鿿]"
CLAUSE_MARKS = "[，。！？；!?;,]"
MASKS = ("<ID>", "<PHONE>", "<NUM>", "<YEAR>")


def tight(c: Column | str) -> Column:
    """Without blanks: a word broken by a blank is still that word."""
    return F.replace(col(c), F.lit(" "), F.lit(""))


def question_strength(c: Column | str, pack: Pack = DEFAULT) -> Column:
    """1 for a question mark, and 1 for each question word."""
    return let(tight(c), lambda t: t.rlike("[?？]").cast("int") + hits(t, pack.questions))


def has_blocked(c: Column | str, pack: Pack = DEFAULT) -> Column:
    return col(c).rlike(f"(?iu){pattern(pack.blocked)}")


def is_garbage(c: Column | str) -> Column:
    """Empty, a lone mask, marks only, or Latin text without Han."""
    return let(tight(c), lambda t: (t == "") | t.isin(*MASKS) | t.rlike(r"(?U)^[\W_]+$") | (t.rlike("[A-Za-z]{2,}") & ~t.rlike(HAN)))


def is_low_info(c: Column | str, pack: Pack = DEFAULT) -> Column:
    """In the list of empty replies, up to 4 characters, or up to 8 without an action."""
    return let(tight(c), lambda t: t.isin(*pack.low_info) | (F.length(t) <= 4) | ((F.length(t) <= 8) & ~any_of(t, pack.actions)))


def has_dated_campaign(c: Column | str, pack: Pack = DEFAULT) -> Column:
    return any_of(tight(c), pack.temporal)


def has_soft_template(c: Column | str, pack: Pack = DEFAULT) -> Column:
    return any_of(tight(c), pack.soft)


def has_role_leak(c: Column | str) -> Column:
    """Tokens or speakers of another turn."""
    text = col(c)
    return F.lower(text).contains("<|im_") | text.rlike("(?im)^\\s*(user|assistant|system)\\b") | text.rlike("(?m)^\\s*(用户|客服|买家|卖家)\\s*[：:]")


def has_other_script(c: Column | str) -> Column:
    return col(c).rlike("[؀-ۿ฀-๿Ѐ-ӿ가-힯]")


def clause_count(c: Column | str) -> Column:
    return F.size(F.filter(F.split(tight(c), "[，。！？；!?;]"), lambda x: x != ""))


def unasked_topics(asked: Column | str, reply: Column | str, pack: Pack = DEFAULT) -> Column:
    """Topics that the reply brings up and the question does not."""

    def flags(x: Column) -> Column:
        tests = [F.when(any_of(x["reply"], own) & ~any_of(x["asked"], wide), F.lit(name)) for name, own, wide in pack.expansions]
        return F.filter(F.array(*tests), lambda t: t.isNotNull())

    return let(F.struct(tight(asked).alias("asked"), tight(reply).alias("reply")), flags)


def is_pitch(c: Column | str, pack: Pack = DEFAULT) -> Column:
    return any_of(tight(c), pack.pitch)


def has_shop_name(c: Column | str, pack: Pack = DEFAULT) -> Column:
    return any_of(tight(c), pack.shop_names)


def store_specific(c: Column | str, pack: Pack = DEFAULT) -> Column:
    """Which of shop_name, operation, policy a text has."""
    kinds = (("shop_name", pack.shop_names), ("operation", pack.operations), ("policy", pack.policies))
    return let(tight(c), lambda t: F.filter(F.array(*[F.when(any_of(t, words), F.lit(name)) for name, words in kinds]), lambda x: x.isNotNull()))


def incomplete_start(context: Column | str, pack: Pack = DEFAULT) -> Column:
    """The first of two or more turns starts in the middle of something."""
    weak = let(tight(F.try_element_at(col(context), F.lit(1))), lambda t: t.rlike(f"^({pattern(pack.incomplete)})") | is_low_info(t, pack))
    return (F.size(col(context)) >= 2) & F.coalesce(weak, F.lit(True))


def is_fragment(c: Column | str, pack: Pack = DEFAULT) -> Column:
    full = f"^(?:{'|'.join(pack.fragments)})$"
    return let(tight(c), lambda t: (F.length(t) <= 3) | t.rlike(full) | ((F.length(t) <= 8) & ~any_of(t, pack.complete)))


def is_generic(c: Column | str, pack: Pack = DEFAULT, masked: Column | None = None) -> Column:
    return (mask_key(c) if masked is None else masked).rlike(f"(?iu)^(?:{'|'.join(pack.generic)})")


def overcommits(c: Column | str, pack: Pack = DEFAULT) -> Column:
    return any_of(tight(c), pack.overcommit)


def has_hard_risk(c: Column | str, pack: Pack = DEFAULT) -> Column:
    return any_of(tight(c), pack.hard_risk)


def promises_refund(c: Column | str, pack: Pack = DEFAULT) -> Column:
    return any_of(tight(c), pack.refund_promise)


def promises_time(c: Column | str, pack: Pack = DEFAULT, masked: Column | None = None) -> Column:
    return (mask_key(c) if masked is None else masked).rlike("|".join(pack.time_promise))


def high_risk_hits(c: Column | str, pack: Pack = DEFAULT) -> Column:
    return let(tight(c), lambda t: hits(t, pack.high_risk))


def keep_reason(context: Column | str, reply: Column | str, least_turns: int = 1, least_chars: int = 6, pack: Pack = DEFAULT) -> Column:
    """First reason to drop a row, or "ok"."""
    text = strip(reply)
    bad = let(text, lambda t: t.isin("", "<ID>", "<PHONE>") | any_of(t, pack.blocked))
    return (
        F.when(F.size(F.coalesce(col(context), F.array().cast("array<string>"))) < least_turns, "too_few_turns")
        .when(F.coalesce(F.length(text), F.lit(0)) < least_chars, "too_short")
        .when(bad, "bad_reply")
        .when(is_low_info(text, pack), "low_info")
        .otherwise("ok")
    )


def has_any(c: Column | str, words: tuple[str, ...]) -> Column:
    """A word of the list in the compact text."""
    return any_of(compact(c), words)


def is_bad(c: Column | str, pack: Pack = DEFAULT) -> Column:
    """Empty, a lone mask, or a way to meet elsewhere."""
    return let(compact(c), lambda t: (t == "") | t.isin(*MASKS) | any_of(t, pack.contact))


def valid_sample(instruction: Column | str, input_: Column | str, output: Column | str) -> Column:
    """Reason against an instruction sample, or "ok"."""
    missing = col(instruction).isNull() | col(input_).isNull() | col(output).isNull()
    return F.when(missing, "missing_key").when(strip(input_) == "", "empty_input").when(strip(output) == "", "empty_output").otherwise("ok")


def mentions(columns: list[str], word: str) -> Column:
    """A word in any of the columns, whatever its case."""
    return F.lower(F.concat_ws(" ", *columns)).contains(word.lower())


def valid_pair(chosen: Column | str, rejected: Column | str) -> Column:
    a, b = strip(F.coalesce(col(chosen), F.lit(""))), strip(F.coalesce(col(rejected), F.lit("")))
    return (a != "") & (b != "") & (a != b)


