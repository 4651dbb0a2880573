"""Repair of preference pairs: clauses of replies scored, kept or rewritten."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from dialoom.functions import predicates as P
from dialoom.functions.clean import EDGE, col, compact, context_key, let, repair_clean, repair_key, without_masks
from dialoom.functions.rules import DEFAULT, Pack, any_of, found
from dialoom.functions.scoring import keyword_score, overlap_of, repair_category

#: Characters and clauses that a repaired reply may keep.
BUDGET, CLAUSES = 34, 2


def split_clauses(c: Column | str) -> Column:
    """Clauses in order, equal ones (in compact form) once."""
    parts = F.transform(F.split(repair_clean(c), "[，。！？；!?,;\n]"), lambda x: F.regexp_replace(x, f"^{EDGE}+|{EDGE}+$", ""))
    tight = lambda x: F.replace(x, F.lit(" "), F.lit(""))
    first = lambda xs: let(F.transform(xs, tight), lambda keys: F.filter(xs, lambda x, i: F.array_position(keys, tight(x)) == i + 1))
    return let(F.filter(parts, lambda x: x != ""), first)


def _category_words(kind: Column, pack: Pack, text: Column) -> Column:
    test = F.lit(False)
    for name, words in pack.repair_categories:
        test = test | ((kind == name) & any_of(text, words))
    return test


def _question(asked: Column, pack: Pack, body) -> Column:
    """`body` of a question's action words and whether it asks about time."""
    parts = lambda t: F.struct(found(t, pack.actions).alias("words"), any_of(t, ("几", "多久", "什么时候", "发货", "到货")).alias("timely"))
    return let(let(compact(asked), parts), body)


def positive_clauses(asked: Column, kind: Column, reply: Column, pack: Pack = DEFAULT) -> Column:
    """array<struct(score, text, i)> of the reply's clauses, best first."""
    return _question(asked, pack, lambda q: _positive_clauses(q, kind, reply, pack))


def _positive_clauses(q: Column, kind: Column, reply: Column, pack: Pack) -> Column:

    def score(x: Column) -> Column:
        size, tight = F.length(x), F.replace(x, F.lit(" "), F.lit(""))
        timely = q["timely"] | kind.isin("shipping")
        s = F.when(P.is_low_info(x, pack), -5.0).otherwise(0.0) + F.when(any_of(tight, pack.contact), -12.0).otherwise(0.0) + F.when(x.rlike("<(ID|PHONE|NUM|YEAR)>"), -7.0).otherwise(0.0)
        s = s + F.when(any_of(tight, pack.store), -3.5).otherwise(0.0) + F.when(any_of(tight, pack.promise) & ~timely, -2.0).otherwise(0.0)
        s = s + F.when(any_of(tight, pack.risky) & ~kind.isin("refund", "shipping", "address"), -2.0).otherwise(0.0) + 8.0 * overlap_of(q["words"], found(tight, pack.actions))
        s = s + F.when(any_of(tight, pack.actions), 2.0).otherwise(0.0) + F.when(_category_words(kind, pack, tight), 2.0).otherwise(0.0)
        return s + F.when((size >= 6) & (size <= 26), 2.0).when(size <= 40, 1.0).otherwise(-1.5)

    scored = F.transform(split_clauses(reply), lambda x, i: F.struct(score(x).alias("score"), (-F.length(x)).alias("short"), (-i).alias("early"), x.alias("text")))
    return F.reverse(F.array_sort(scored))


def repaired_positive(asked: Column, kind: Column, reply: Column, pack: Pack = DEFAULT) -> Column:
    """struct(text, issues, score): up to CLAUSES clauses with a score above 0
    inside BUDGET characters, in the order of their scores; text is null if
    nothing can be saved."""
    zero = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(0).alias("size"))

    def take(s: Column, x: Column) -> Column:
        n = F.size(s["kept"])
        fits = (x["score"] > 0) & (n < CLAUSES) & ((n == 0) | (s["size"] + F.length(x["text"]) <= BUDGET))
        return F.struct(F.when(fits, F.concat(s["kept"], F.array(x["text"]))).otherwise(s["kept"]).alias("kept"), F.when(fits, s["size"] + F.length(x["text"])).otherwise(s["size"]).alias("size"))

    def choose(clauses: Column) -> Column:
        best = F.try_element_at(clauses, F.lit(1))
        chosen = let(F.aggregate(clauses, zero, take, lambda s: s["kept"]), lambda kept: F.when(F.size(kept) > 0, kept).when(best["score"] >= 0, F.array(best["text"])).otherwise(F.array().cast("array<string>")))
        return F.struct(F.coalesce(best["score"], F.lit(0.0)).alias("best"), chosen.alias("chosen"))

    def finish(x: Column) -> Column:
        text, whole, none = x["text"], x["whole"], x["none"]
        flags = F.array(F.when(F.replace(text, F.lit(" "), F.lit("")) != whole, F.lit("trimmed_positive")), F.when(any_of(whole, pack.store), F.lit("store_specific_positive")), F.when(any_of(whole, pack.promise), F.lit("time_promise_positive")))
        bad = none | P.is_low_info(text, pack) | P.is_bad(text, pack)
        issues = F.when(none, F.array(F.lit("positive_not_salvageable"))).otherwise(F.filter(flags, lambda i: i.isNotNull()))
        return F.struct(F.when(~F.coalesce(bad, F.lit(True)), text).alias("text"), issues.alias("issues"), (x["best"] + F.length(text) / 10.0).alias("score"))

    picked = let(positive_clauses(asked, kind, reply, pack), choose)
    parts = let(picked, lambda p: F.struct(without_masks(F.array_join(p["chosen"], "，")).alias("text"), compact(reply).alias("whole"), (F.size(p["chosen"]) == 0).alias("none"), p["best"].alias("best")))
    return let(parts, finish)


def template_pick(asked: Column, kind: Column, pack: Pack = DEFAULT) -> Column:
    """A negative template: md5 of the compact question modulo their number."""

    def pick(number: Column) -> Column:
        out = None
        for name, texts in sorted(pack.negatives.items()):
            value = F.element_at(F.array(*[F.lit(t) for t in texts]), (number % len(texts) + 1).cast("int"))
            out = F.when(kind == name, value) if out is None else out.when(kind == name, value)
        return out

    return let(F.conv(F.substring(F.md5(compact(asked)), 1, 8), 16, 10).cast("long"), pick)


def needs_rewrite(asked: Column, rejected: Column, pack: Pack = DEFAULT) -> Column:
    near = keyword_score(asked, rejected, pack) >= 0.12
    return P.is_low_info(rejected, pack) | let(compact(rejected), lambda t: (t == "") | t.isin(*P.MASKS) | (~near & ~any_of(t, pack.contact + pack.risky)) | (F.length(t) <= 6))


def repaired_negative(asked: Column, kind: Column, rejected: Column, chosen: Column, pack: Pack = DEFAULT) -> Column:
    """struct(text, issues, score): the riskiest clause on the topic, or a template
    where the reply says too little; text is null if it stays like the chosen one."""

    def score(x: Column, q: Column) -> Column:
        size, tight = F.length(x), F.replace(x, F.lit(" "), F.lit(""))
        s = F.when(P.is_low_info(x, pack), -5.0).otherwise(0.0) + F.when(any_of(tight, pack.contact), 4.5).otherwise(0.0) + F.when(any_of(tight, pack.risky + pack.promise), 3.0).otherwise(0.0)
        s = s + 6.0 * overlap_of(q["words"], found(tight, pack.actions)) + F.when(_category_words(kind, pack, tight), 1.5).otherwise(0.0)
        return s + F.when(size < 6, -1.0).when(size <= 28, 1.0).otherwise(0.0)

    scored = _question(asked, pack, lambda q: F.transform(split_clauses(rejected), lambda x, i: F.struct(score(x, q).alias("score"), (-F.length(x)).alias("short"), (-i).alias("early"), x.alias("text"))))
    best = let(F.reverse(F.array_sort(scored)), lambda c: F.try_element_at(c, F.lit(1)))
    state = let(best, lambda b: F.struct((b["score"] > 0).alias("found"), F.when(b["score"] > 0, b["text"]).otherwise(repair_clean(rejected)).alias("cut")))
    state = let(state, lambda x: F.struct(x["found"].alias("found"), x["cut"].alias("cut"), (needs_rewrite(asked, x["cut"], pack) | (compact(x["cut"]) == compact(chosen))).alias("rewrite")))
    state = let(state, lambda x: F.struct(x["found"].alias("found"), x["rewrite"].alias("rewrite"), F.when(x["rewrite"], template_pick(asked, kind, pack)).otherwise(x["cut"]).alias("text")))
    state = let(state, lambda x: F.struct(x["found"].alias("found"), x["rewrite"].alias("rewrite"), x["text"].alias("text"), compact(x["text"]).alias("tight")))

    def finish(x: Column) -> Column:
        text, tight, rewrite = x["text"], x["tight"], x["rewrite"]
        bad = (tight == compact(chosen)) | P.is_low_info(text, pack) | (F.length(tight) < 6)
        value = 6.0 * keyword_score(asked, text, pack) + F.when(any_of(tight, pack.contact), 4.0).otherwise(0.0) + F.when(any_of(tight, pack.risky + pack.promise), 3.0).otherwise(0.0) + F.when(any_of(tight, pack.actions), 1.0).otherwise(0.0) + F.when(rewrite, 2.0).otherwise(0.0)
        issues = F.filter(F.array(F.when(rewrite, F.lit("rewritten_negative")), F.when(~rewrite & F.coalesce(x["found"], F.lit(False)), F.lit("trimmed_negative"))), lambda i: i.isNotNull())
        return F.struct(F.when(~F.coalesce(bad, F.lit(True)), text).alias("text"), issues.alias("issues"), value.alias("score"))

    return let(state, finish)


def repair_pairs(df: DataFrame, context: str = "context", chosen: str = "chosen", rejected: str = "rejected", pack: Pack = DEFAULT) -> DataFrame:
    """Both sides repaired; rows where one cannot be saved are dropped; the score
    gains both parts; issues are joined."""
    asked = repair_clean(F.element_at(col(context), -1))
    base = df.where(F.size(context) > 0).withColumn("_asked", asked).withColumn("repair_category", repair_category(F.col("_asked"), pack))
    asked_, kind = F.col("_asked"), F.col("repair_category")
    # Generators evaluate a side once; a filter on it would do so again.
    saved = lambda c: F.explode(F.filter(F.array(c), lambda x: x["text"].isNotNull()))
    base = base.select("*", saved(repaired_positive(asked_, kind, F.col(chosen), pack)).alias("_good"))
    base = base.select("*", saved(repaired_negative(asked_, kind, F.col(rejected), F.col("_good.text"), pack)).alias("_bad"))
    out = base.withColumns({"repaired_chosen": F.col("_good.text"), "repaired_rejected": F.col("_bad.text")})
    issues = F.array_distinct(F.concat(F.coalesce("issues", F.array().cast("array<string>")) if "issues" in df.columns else F.array().cast("array<string>"), "_good.issues", "_bad.issues"))
    score = (F.coalesce("score", F.lit(0.0)) if "score" in df.columns else F.lit(0.0)) + F.col("_good.score") + F.col("_bad.score")
    return out.withColumn("repair_issues", issues).withColumn("repair_score", score).drop("_asked", "_good", "_bad")


#: Columns of `with_keys` that tell a pair from others.
SAME = ("context_key", "template", "rejected_key")


def with_keys(df: DataFrame) -> DataFrame:
    """Repaired pairs with what the selection compares: reply and question with
    masked figures, the context, the rejected reply."""
    return df.withColumns({"template": repair_key("repaired_chosen"), "asked_key": repair_key(F.element_at("context", -1)), "rejected_key": repair_key("repaired_rejected"), "context_key": context_key("context")})


def order(last: list[Column]) -> list[Column]:
    """Rank of repaired pairs: score, hand-made ones, the shorter reply, then `last`."""
    return [F.desc("repair_score"), F.desc(F.coalesce(F.col("source") == "manual_round2", F.lit(False))), F.asc(F.length(compact("repaired_chosen"))), *last]


def distributions(df: DataFrame, category: str = "category", source: str = "source", issues: str = "issues", n: int = 100) -> DataFrame:
    """`kind, value, n`: categories, sources and the n most frequent issues."""
    simple = [df.groupBy(F.lit(k).alias("kind"), F.coalesce(F.col(k), F.lit("")).alias("value")).agg(F.count("*").alias("n")) for k in (category, source)]
    each = df.select(F.explode(issues).alias("value")).groupBy(F.lit("issue").alias("kind"), "value").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(n)
    return simple[0].unionByName(simple[1]).unionByName(each)
