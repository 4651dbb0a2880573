"""Scores and categories of contexts and replies as column expressions.

Modes are parameters: strict tightens the terms, generic rejects shop-specific
rows, sft adds the rejects for supervised targets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from dialoom.functions import predicates as P
from dialoom.functions.clean import col, compact, let, mask_key, strip, trim_tail
from dialoom.functions.rules import DEFAULT, Pack, any_of, found, hits

REJECTED = -999.0
#: Fixed value: the request at the end of a reply that costs points where it stays.
TAIL = "请核对一下收货地址"


@dataclass(frozen=True)
class Mode:
    strict: bool = False
    generic: bool = False
    sft: bool = False

    def of(self, default: float, strict: float) -> float:
        return strict if self.strict else default


NORMAL = Mode()


def overlap_tokens(c: Column | str, pack: Pack = DEFAULT) -> Column:
    """Set of topic words, runs of Han or Latin letters and masks, without stop words."""
    return tokens_of(mask_key(c), pack)


def tokens_of(masked: Column, pack: Pack = DEFAULT) -> Column:
    runs = lambda t: F.regexp_extract_all(t, F.lit("[一-鿿]{2,}|[a-z]{2,}|<[a-z]+>"), F.lit(0))
    stop = F.array(*[F.lit(w) for w in pack.stop])
    return let(F.lower(masked), lambda t: F.array_except(F.array_distinct(F.concat(found(t, pack.topics), runs(t))), stop))


def overlap_of(a: Column, b: Column) -> Column:
    """Overlap coefficient of two sets; 0 if one is empty."""

    def share(x: Column) -> Column:
        least = F.least(F.size(x["a"]), F.size(x["b"]))
        return F.when(least > 0, F.size(F.array_intersect(x["a"], x["b"])) / least).otherwise(F.lit(0.0))

    return let(F.struct(a.alias("a"), b.alias("b")), share)


def keyword_overlap(a: Column | str, b: Column | str, pack: Pack = DEFAULT) -> Column:
    return overlap_of(overlap_tokens(a, pack), overlap_tokens(b, pack))


def relevance(asked: Column | str, reply: Column | str, pack: Pack = DEFAULT, masks: tuple[Column, Column] | None = None) -> Column:
    a, b = masks or (mask_key(asked), mask_key(reply))
    parts = F.struct(hits(P.tight(reply), pack.actions).alias("actions"), overlap_of(tokens_of(a, pack), tokens_of(b, pack)).alias("overlap"))

    def total(x: Column) -> Column:
        score = 5.0 * x["overlap"] + 0.35 * F.least(x["actions"], F.lit(4)) + F.when(any_of(col(reply), pack.helpful), 0.6).otherwise(0.0)
        return score + F.when((P.question_strength(asked, pack) >= 2) & (x["actions"] > 0), 0.4).otherwise(0.0)

    return let(parts, total)


def context_score(context: Column | str, mode: Mode = NORMAL, pack: Pack = DEFAULT) -> Column:
    """struct(score, issues) of a context."""
    turns = col(context)
    n, last = F.size(turns), F.element_at(turns, -1)
    strength, distinct = P.question_strength(last, pack), F.size(F.array_distinct(turns)) / n
    weak = let(P.tight(last), lambda t: (F.length(t) <= 3) | t.rlike(f"^(?:{'|'.join(pack.weak_asked)})$"))
    score = 0.5 * F.least(n, F.lit(8)) + F.when(n % 2 == 1, 1.0).otherwise(-0.8) + F.when(strength > 0, 1.2).otherwise(-1.8)
    score = score + F.when(weak, -2.2).otherwise(0.0) + 0.8 * distinct + F.when(distinct < 0.6, -0.8).otherwise(0.0)
    reject = F.coalesce(n, F.lit(0)) <= 0
    if mode.generic:
        reject = reject | F.exists(turns, lambda t: F.size(P.store_specific(t, pack)) > 0) | P.incomplete_start(turns, pack)
    issues = F.array(F.when(n % 2 == 0, F.lit("even_turn_context")), F.when(strength == 0, F.lit("weak_last_user_query")), F.when(weak, F.lit("very_weak_last_user_query")), F.when(distinct < 0.6, F.lit("repetitive_context")))
    return F.struct(F.when(reject, REJECTED).otherwise(score).alias("score"), F.filter(issues, lambda x: x.isNotNull()).alias("issues"))


def category(asked: Column | str, reply: Column | str, pack: Pack = DEFAULT) -> Column:
    """First category whose words occur in the reply or the question."""

    def first(x: Column) -> Column:
        out = None
        for name, words in pack.categories:
            test = any_of(x["reply"], words) | any_of(x["asked"], words)
            out = F.when(test, name) if out is None else out.when(test, name)
        return out.otherwise("other") if out is not None else F.lit("other")

    return let(F.struct(P.tight(asked).alias("asked"), P.tight(reply).alias("reply")), first)


def repair_category(asked: Column | str, pack: Pack = DEFAULT) -> Column:
    """First category whose words occur in the compact question."""

    def first(text: Column) -> Column:
        out = None
        for name, words in pack.repair_categories:
            test = any_of(text, words)
            out = F.when(test, name) if out is None else out.when(test, name)
        return out.otherwise("other") if out is not None else F.lit("other")

    return let(compact(asked), first)


#: Most characters and points of each band of length.
BANDS = ((14, 1.8), (28, 3.4), (42, 3.0), (60, 1.8), (80, 0.5))
STRICT_BANDS = ((12, 2.2), (22, 3.8), (32, 3.0), (40, 1.5), (52, 0.2), (70, -1.8))


def _bands(size: Column, mode: Mode) -> Column:
    out = None
    for most, value in STRICT_BANDS if mode.strict else BANDS:
        out = F.when(size <= most, value) if out is None else out.when(size <= most, value)
    return out.otherwise(mode.of(-2.5, -4.0))


#: Points of each category, default and strict.
_CATEGORY_TERMS = {"product_info": (-0.2, -0.6), "after_sale": (0.8, 0.8), "price_activity": (-0.8, -1.4), "courier_info": (-1.0, -1.6), "shipping_sla": (-1.0, -1.6), "other": (0.5, 0.4)}


def _parts(text: Column, trims: Column, asked: Column, asked_mask: Column | None) -> Column:
    """What the signs of a reply are told from, each once."""
    return F.struct(text.alias("text"), trims.alias("trims"), mask_key(text).alias("mask"), asked.alias("asked"), (mask_key(asked) if asked_mask is None else asked_mask).alias("asked_mask"))


def positive_score(context: Column | str, reply: Column | str, mode: Mode = NORMAL, pack: Pack = DEFAULT, asked_mask: Column | None = None) -> Column:
    """struct(score, issues, text, rejected) of a good reply; `rejected` names the
    first reason for the score REJECTED. `asked_mask` is the mask key of the last
    turn, where it is known."""
    turns = col(context)

    def signs(t: Column) -> Column:
        text, asked, mask = t["text"], t["asked"], t["mask"]
        values = {
            "text": text, "trims": t["trims"], "mask": mask, "size": F.length(P.tight(text)), "tail": P.tight(text).contains(TAIL), "clauses": P.clause_count(text), "unasked": F.size(P.unasked_topics(asked, text, pack)), "risky": P.high_risk_hits(text, pack),
            "kind": category(asked, text, pack), "close": relevance(asked, text, pack, (t["asked_mask"], mask)), "dated": P.has_dated_campaign(text, pack), "soft": P.has_soft_template(text, pack), "generic": P.is_generic(text, pack, mask), "pitch": P.is_pitch(text, pack), "over": P.overcommits(text, pack),
        }
        return F.struct(*[v.alias(n) for n, v in values.items()])

    trimmed = let(trim_tail(reply), lambda t: _parts(t["text"], t["issues"], F.element_at(turns, -1), asked_mask))
    return let(let(trimmed, signs), lambda x: _positive(x, turns, mode, pack))


def _positive(x: Column, turns: Column, mode: Mode, pack: Pack) -> Column:
    text, size, clauses, unasked, risky, kind, close = (x[n] for n in ("text", "size", "clauses", "unasked", "risky", "kind", "close"))
    dated, soft, generic, pitch, over = (x[n] for n in ("dated", "soft", "generic", "pitch", "over"))
    heavy = risky >= (2 if mode.strict else 3)
    rejects = [
        (P.is_garbage(text), "garbage"), (P.has_role_leak(text), "role_leak"), (P.has_other_script(text), "other_script"), (P.has_blocked(text, pack), "blocked"),
        *([(F.size(P.store_specific(text, pack)) > 0, "store_specific")] if mode.generic else []),
        (P.is_low_info(text, pack), "low_info"), (F.array_contains(turns, text), "copied"), (P.is_fragment(text, pack), "fragment"),
        *([(generic, "generic_template"), (over, "overcommits"), (P.has_hard_risk(text, pack), "hard_risk"), (P.promises_refund(text, pack), "refund_promise"), (P.promises_time(text, pack, x["mask"]), "time_promise"), (dated, "dated")] if mode.sft else []),
        (size < 6, "too_short"),
        *([(kind.isin("courier_info", "shipping_sla") & P.promises_time(text, pack, x["mask"]), "shipping_template")] if mode.sft else []),
        *([((unasked >= 3) & (size > 20), "unasked_topics")] if mode.strict else []),
        *([(pitch, "pitch")] if mode.sft else []),
        *([((clauses >= 6) & ((unasked > 0) | heavy), "overlong")] if mode.strict else []),
    ]
    reason = F.coalesce(*[F.when(test, F.lit(name)) for test, name in rejects])
    score = _bands(size, mode) + close + F.when(close < 0.6, -3.0).when(close < 1.2, -1.3).otherwise(0.0)
    score = score + F.when(dated, mode.of(-2.5, -3.2)).otherwise(0.0) + F.when(soft, mode.of(-1.8, -2.6)).otherwise(0.0)
    if mode.strict:
        score = score + F.when((clauses >= 4) & (size > 28), -1.8).otherwise(0.0) + F.when(clauses >= 6, -2.6).otherwise(0.0)
    else:
        score = score + F.when((clauses >= 6) & (size > 40), -1.2).otherwise(0.0)
    score = score + F.when(generic, mode.of(-3.0, -4.0)).otherwise(0.0) + risky * mode.of(-0.7, -1.0) + F.when(over, mode.of(-3.0, -4.0)).otherwise(0.0)
    score = score + F.when(x["tail"], mode.of(-2.5, -3.0)).otherwise(0.0)
    term = None
    for name, values in _CATEGORY_TERMS.items():
        term = F.when(kind == name, mode.of(*values)) if term is None else term.when(kind == name, mode.of(*values))
    score = score + term.otherwise(0.0) + F.when(unasked >= 2, mode.of(-2.2, -3.6)).otherwise(F.when((unasked == 1) & (size > 24), -1.2).otherwise(0.0) if mode.strict else F.lit(0.0))
    score = score + (F.when(pitch & (unasked >= 1), -2.6).when(pitch & (size > 28), -1.2).otherwise(0.0) if mode.strict else F.when(pitch & (unasked >= 1), -1.3).otherwise(0.0))
    score = score + F.when(any_of(P.tight(text), pack.helpful), 0.4).otherwise(0.0)
    many = ((clauses >= 4) & (size > 28), clauses >= 6) if mode.strict else ((clauses >= 6) & (size > 40),)
    minor = (unasked >= 2) | ((unasked == 1) & (size > 24)) if mode.strict else unasked >= 2
    pushy = pitch & ((unasked >= 1) | (size > 28)) if mode.strict else pitch & (unasked >= 1)
    tests = (
        (dated, "dated"), (soft, "soft_template"), (size > mode.of(60, 40), "long"), (close < 1.2, "low_overlap"), *[(m, "many_clauses") for m in many], (generic, "generic_template"), (heavy, "template_heavy"),
        (over, "overcommits"), (x["tail"], "address_tail"), (minor, "unasked_topic"), (pushy, "pitch"),
    )
    flags = F.array(*[F.when(test, F.lit(name)) for test, name in tests])
    issues = F.concat(x["trims"], F.filter(flags, lambda x: x.isNotNull()))
    return F.struct(F.when(reason.isNotNull(), REJECTED).otherwise(score).alias("score"), issues.alias("issues"), text.alias("text"), reason.alias("rejected"))


def negative_score(context: Column | str, reply: Column | str, chosen: Column | str, mode: Mode = NORMAL, pack: Pack = DEFAULT, asked_mask: Column | None = None) -> Column:
    """struct(score, issues, text) of a worse reply next to the chosen one; its
    tail is trimmed too, and `text` is what is left."""
    turns = col(context)
    trimmed = let(trim_tail(reply), lambda t: _parts(t["text"], t["issues"], F.element_at(turns, -1), asked_mask))
    return let(trimmed, lambda t: _negative(t, turns, chosen, mode, pack))


def _negative(x: Column, turns: Column, chosen: Column | str, mode: Mode, pack: Pack) -> Column:
    text, trims, asked = x["text"], x["trims"], x["asked"]
    tight, best = P.tight(text), P.tight(chosen)
    copied, blocked, near = F.array_contains(turns, text), P.has_blocked(text, pack), overlap_of(tokens_of(x["asked_mask"], pack), tokens_of(x["mask"], pack)) > 0.15
    generic, soft, dated, unasked = P.is_generic(text, pack, x["mask"]), P.has_soft_template(text, pack), P.has_dated_campaign(text, pack), F.size(P.unasked_topics(asked, text, pack)) >= 1
    pitch, fragment = P.is_pitch(text, pack), P.is_fragment(text, pack)
    reject = P.is_garbage(text) | P.has_role_leak(text) | P.has_other_script(text) | (tight == best) | (F.length(text) < 2) | tight.isin(*pack.low_info) | (F.length(tight) <= 4)
    terms = ((copied, -1.0, "copied"), (blocked, -1.0, "blocked"), (near, 0.8, None), (generic, 0.5, None), (soft, 0.5, None), (dated, 0.3, None), (unasked, mode.of(0.4, 0.6), None), (pitch, 0.4, None), (fragment, -0.5, "fragmented"))
    score = F.lit(1.0)
    for test, value, _ in terms:
        score = score + F.when(test, value).otherwise(0.0)
    issues = F.concat(trims, F.filter(F.array(*[F.when(test, F.lit(name)) for test, _, name in terms if name]), lambda x: x.isNotNull()))
    return F.struct(F.when(F.coalesce(reject, F.lit(True)), REJECTED).otherwise(score).alias("score"), issues.alias("issues"), text.alias("text"))


def keywords(c: Column | str, pack: Pack = DEFAULT) -> Column:
    """Action words in the compact text."""
    return let(compact(c), lambda t: found(t, pack.actions))


def keyword_score(a: Column | str, b: Column | str, pack: Pack = DEFAULT) -> Column:
    return overlap_of(keywords(a, pack), keywords(b, pack))


def occurrences(c: Column, word: str) -> Column:
    return ((F.length(c) - F.length(F.replace(c, F.lit(word), F.lit("")))) / len(word)).cast("int")


def record_risk(asked: Column | str, reply: Column | str, pack: Pack = DEFAULT) -> Column:
    """Risk of an instruction row: terms of the reply and, apart from them, of the
    input, with the additions of `risk_score`."""
    score = risk_score(reply, None, pack)
    text = F.coalesce(col(asked), F.lit(""))
    for word, weight in pack.input_risks:
        score = score + F.when(text.contains(word), weight).otherwise(0.0)
    return score


def risk_score(reply: Column | str, context: Column | str | None = None, pack: Pack = DEFAULT) -> Column:
    """Weighted risky words in the reply (and context), longer replies and
    repeated addresses of the buyer."""
    text = F.coalesce(col(reply), F.lit(""))
    whole = text if context is None else F.concat_ws("\n", F.array_join(F.coalesce(col(context), F.array().cast("array<string>")), "\n"), text)
    score = F.lit(0.0)
    for word, weight in pack.risks:
        score = score + F.when(whole.contains(word), weight).otherwise(0.0)
    return score + F.when(F.length(text) > 24, 0.8).otherwise(0.0) + F.when(occurrences(text, "亲") >= 4, 0.5).otherwise(0.0)
