"""Grouping of candidates, best pairs per context, runs, deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from dialoom.functions import predicates as P
from dialoom.functions.clean import clean_turn, mask_key, strip, template_key, template_of
from dialoom.functions.rules import DEFAULT, Pack
from dialoom.functions.scoring import NORMAL, REJECTED, Mode, category, context_score, negative_score, positive_score
from dialoom.session import cut

#: Issues of a context that keep its reply from being the best of its group.
BLOCKING = ("very_weak_last_user_query",)
#: A weak question needs a better reply.
WEAK_LEAST = 4.8


def candidates(df: DataFrame, mode: Mode = NORMAL, pack: Pack = DEFAULT) -> DataFrame:
    """Rows `line_no, label, turns, reply` with keys, scores and categories. Blank
    turns are left out; a good reply goes on without its boilerplate tail, and
    keys, template and category are those of the trimmed text. A reply of label 0
    keeps the context's score only: it is scored, and trimmed, when it is compared
    with a chosen one."""
    # Generators keep steps apart: each text is cleaned once, each reply scored
    # once, though several columns and filters use the results.
    blank = lambda t: F.coalesce(strip(t), F.lit("")) == ""
    turns = F.transform(F.filter(F.coalesce("context", F.array().cast("array<string>")), lambda t: ~blank(t)), clean_turn)
    texts = F.filter(F.array(F.struct(turns.alias("turns"), clean_turn(F.coalesce("response", F.lit(""))).alias("reply"))), lambda x: (F.size(x["turns"]) > 0) & (x["reply"] != ""))
    base = df.select("line_no", "label", F.explode(texts).alias("_t")).select("line_no", "label", "_t.*").withColumns({"asked": F.element_at("turns", -1), "_masks": F.transform("turns", mask_key)})
    scores = F.array(F.struct(context_score("turns", mode, pack).alias("context"), F.when(F.col("label") == 1, positive_score("turns", "reply", mode, pack, F.element_at("_masks", -1))).alias("reply")))
    base = base.select("*", F.explode(scores).alias("_s")).select("line_no", "label", "turns", "asked", F.element_at("_masks", -1).alias("asked_key"), F.array_join("_masks", " || ").alias("context_key"), F.coalesce("_s.reply.text", "reply").alias("reply"), F.col("_s.context").alias("_context"), F.col("_s.reply").alias("_reply"))
    base = base.select("*", F.explode(F.array(mask_key("reply"))).alias("response_key")).withColumn("template", template_of(F.col("response_key")))
    out = base.withColumn("pair_key", pair_key("asked_key", "reply")).withColumn("category", category("asked", "reply", pack))
    score = F.when(F.col("_context.score") <= REJECTED, REJECTED).when(F.col("label") != 1, F.col("_context.score")).when(F.col("_reply.score") <= REJECTED, REJECTED).otherwise(F.col("_context.score") + F.col("_reply.score"))
    issues = F.concat("_context.issues", F.coalesce("_reply.issues", F.array().cast("array<string>")))
    return out.withColumn("score", score).withColumn("issues", issues).drop("_context", "_reply")


def pair_key(asked_key: str, reply: str) -> Column:
    """What pairs of one question and one reply have in common: the template form
    of both together."""
    return template_key(F.concat(asked_key, F.lit(" || "), reply))


def _best(score: str, issues: str, reply: str, line: str) -> Column:
    """An order for max_by: score, fewer issues, shorter reply, earlier line."""
    return F.struct(F.col(score).alias("a"), (-F.size(issues)).alias("b"), (-F.length(reply)).alias("c"), (-F.col(line)).alias("d"))


def best_positive(cands: DataFrame, pack: Pack = DEFAULT) -> DataFrame:
    """The best reply of each context, dropped if it is not good enough; the
    runner-up takes no place. `first_line` is the first line of the context. The
    best line is found by an aggregate that combines before it shuffles, so a
    context with very many lines makes no large task; only then its row is read."""
    good = F.when(F.col("label") == 1, F.col("line_no"))
    order = F.when(F.col("label") == 1, _best("score", "issues", "reply", "line_no"))
    top = cands.groupBy("context_key").agg(F.max_by(good, order).alias("line_no"), F.min("line_no").alias("first_line")).where("line_no is not null")
    rows = cands.where("label = 1").join(top.select("line_no", "first_line"), "line_no")
    blocked = F.arrays_overlap("issues", F.array(*[F.lit(x) for x in BLOCKING]))
    weak = F.array_contains("issues", "weak_last_user_query") & (F.col("score") < WEAK_LEAST)
    return rows.where((F.col("score") >= 0) & ~blocked & ~weak)


def best_pairs(cands: DataFrame, mode: Mode = NORMAL, pack: Pack = DEFAULT) -> DataFrame:
    """One row per context with an accepted positive and a negative: the pair's
    score is pos + max(0, 0.15 neg). Negatives are scored after the join, so only
    for contexts that have a positive. Equal negatives of a context are one before
    the join (a score depends on the text; fewer issues, then the earlier line
    decide), and the best is found by an aggregate that combines early."""
    pos = best_positive(cands, pack).select(
        "context_key", F.col("turns").alias("context"), F.col("reply").alias("chosen"), F.col("score").alias("pos_score"), F.col("issues").alias("chosen_issues"), F.col("line_no").alias("pos_line_no"), "first_line", "category", "template", "pair_key", "asked", "asked_key"
    )
    neg = cands.where("label = 0").groupBy("context_key", F.col("reply").alias("rejected")).agg(F.min(F.struct(F.size("issues").alias("n"), F.col("line_no").alias("line"), "issues")).alias("own"))
    scored = F.filter(F.array(negative_score("context", "rejected", "chosen", mode, pack, F.col("asked_key"))), lambda x: x["score"] > REJECTED)
    both = pos.join(neg, "context_key").select("context_key", "pos_line_no", "own", F.explode(scored).alias("_neg"))
    both = both.select("pos_line_no", F.col("_neg.text").alias("rejected"), F.col("_neg.score").alias("neg_score"), F.concat("own.issues", "_neg.issues").alias("rejected_issues"), F.col("own.line").alias("neg_line_no"))
    fields = F.struct("rejected", "neg_score", "rejected_issues", "neg_line_no")
    best = both.groupBy("pos_line_no").agg(F.max_by(fields, _best("neg_score", "rejected_issues", "rejected", "neg_line_no")).alias("_neg"))
    out = pos.join(best, "pos_line_no").select("*", "_neg.*").drop("_neg")
    return out.withColumn("score", F.col("pos_score") + F.greatest(F.lit(0.0), 0.15 * F.col("neg_score")))


def pair_order() -> list[Column]:
    """Rank of pairs: score, longer context, shorter reply, earlier context."""
    return [F.desc("score"), F.desc(F.size("context")), F.length("chosen"), F.asc("first_line")]


def group_stats(cands: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row: groups, those without positive or negative, kept and rejected ones."""
    sides = cands.groupBy("context_key").agg(F.max((F.col("label") == 1).cast("int")).alias("p"), F.max((F.col("label") == 0).cast("int")).alias("n"))
    total = sides.agg(F.count("*").alias("context_groups"), F.count_if(F.col("p") == 0).alias("no_positive"), F.count_if((F.col("p") == 1) & (F.col("n") == 0)).alias("no_negative"))
    return total.join(F.broadcast(pairs.agg(F.count("*").alias("kept")))).withColumn("rejected", F.expr("context_groups - no_positive - no_negative - kept"))


def label_counts(df: DataFrame, label: str = "label") -> DataFrame:
    """Counters of a scan in one aggregate."""
    return df.agg(F.count("*").alias("total_lines"), F.count_if(F.col(label).isNull()).alias("parse_failed"), F.count_if(F.col(label) == 0).alias("label_0"), F.count_if(F.col(label) == 1).alias("label_1"))


def last_write_pairs(df: DataFrame, key: list[Column | str], order: str = "line_no", label: str = "label", reply: str = "response") -> DataFrame:
    """Chosen and rejected of each key: the last row of each label counts;
    incomplete and equal pairs are left out."""
    last = lambda v: F.max_by(F.when(F.col(label) == v, F.col(reply)), F.when(F.col(label) == v, F.col(order)))
    pairs = df.groupBy(*key).agg(F.min(order).alias("first_line"), last(1).alias("chosen"), last(0).alias("rejected"))
    return pairs.where(P.valid_pair("chosen", "rejected"))


def run_ids(df: DataFrame, key: Column, order: str, within: list[str] | None = None) -> DataFrame:
    """`run_id`: neighbours in `order` with one key are a run; keys that come again
    later make a new run, and numbers start from 1 in each `within`. Rows are sorted
    and numbered inside range partitions; the last row of a partition and the number
    of its runs are all that the next ones need, so a file of any size is no single
    task."""
    names = [*(within or []), order]
    rows = df.withColumn("_key", F.struct(*[F.col(c) for c in within or []], key.alias("_run"))).repartitionByRange(max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *names).sortWithinPartitions(*names)
    rows = cut(rows.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    window, across = W.partitionBy("_part").orderBy("_at"), W.orderBy("_part")
    changed = F.coalesce((~F.col("_key").eqNullSafe(F.lag("_key").over(window))) & (F.row_number().over(window) > 1), F.lit(False)).cast("long")
    rows = cut(rows.withColumn("_change", changed).withColumn("_runs", F.sum("_change").over(window.rowsBetween(W.unboundedPreceding, 0))).drop("_change"))
    ends = rows.groupBy("_part").agg(F.min_by("_key", "_at").alias("head"), F.max_by("_key", "_at").alias("tail"), F.max("_runs").alias("n"))
    ends = ends.withColumn("fresh", (~F.col("head").eqNullSafe(F.lag("tail").over(across))).cast("long"))
    ends = ends.withColumn("_start", F.sum("fresh").over(across.rowsBetween(W.unboundedPreceding, 0)) + F.coalesce(F.sum("n").over(across.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    out = rows.join(F.broadcast(ends.select("_part", "_start")), "_part").withColumn("run_id", F.col("_start") + F.col("_runs"))
    if within:
        first = out.groupBy(*within).agg(F.min("run_id").alias("_first")).select(F.struct(*within).alias("_group"), "_first")
        out = out.join(first, F.struct(*[out[c] for c in within]).eqNullSafe(first["_group"])).withColumn("run_id", F.col("run_id") - F.col("_first") + 1)
    return out.select(*df.columns, "run_id")


def run_groups(df: DataFrame, key: Column, order: str = "line_no", within: list[str] | None = None) -> DataFrame:
    """One row per run: key, bounds, size and the last reply of each label."""
    runs = run_ids(df.withColumn("_run_key", key), F.col("_run_key"), order, within)
    last = lambda v: F.max_by(F.when(F.col("label") == v, F.col("response")), F.when(F.col("label") == v, F.col(order)))
    return runs.groupBy(*(within or []), "run_id", "_run_key").agg(F.min(order).alias("first_line"), F.max(order).alias("last_line"), F.count("*").alias("rows"), last(1).alias("chosen"), last(0).alias("rejected")).withColumnRenamed("_run_key", "run_key")


def context_lines(df: DataFrame, order: str = "line_no") -> DataFrame:
    """Lines of each context in file order, contexts by first line."""
    lines = F.transform(F.sort_array(F.collect_list(F.struct(order, "label", "response"))), lambda x: F.concat_ws("\t", x["label"].cast("string"), x["response"]))
    return df.groupBy("context").agg(F.min(order).alias("first_line"), lines.alias("lines"), F.coalesce(F.min_by(F.when(F.col("label") == 1, F.col("response")), F.when(F.col("label") == 1, F.col(order))), F.lit("")).alias("positive"))


def exact_first(df: DataFrame, keys: list[Column], order: str) -> DataFrame:
    """The first row of each set of equal keys. Aggregates before it shuffles
    whole rows: only the smallest `order` of each key is joined back, so `order`
    must tell rows apart."""
    digest = F.sha2(F.to_json(F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)])), 256)
    first = df.groupBy(digest.alias("_d")).agg(F.min(order).alias(order))
    return df.join(first.select(order), order, "left_semi")
