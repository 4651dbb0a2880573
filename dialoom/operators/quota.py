"""Selection under caps: each accepted row uses one place of each of its keys.

A row is accepted if none of its keys is at its cap, in rank order, so a row
that one cap rejects uses no place of another. `accepted` walks a narrow stream
of the best WALK_ROWS rows; what is left over loses, in parallel, every row with
a key that is full by then (counters only grow, so such a row can never be
accepted), and the best of the rest are walked next. A category that can not be
filled therefore never sends the table through one task. Which cap dropped a row
follows from the ranks at which keys became full."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from dialoom.session import cut

#: Ranks that are walked at first; four times as many each time they are too few.
WALK_ROWS = 200_000
#: Shares of categories by mode; other categories have no cap.
SHARES = {
    "sft": {"product_info": 0.26, "after_sale": 0.26, "price_activity": 0.08, "courier_info": 0.06, "shipping_sla": 0.06, "other": 0.28},
    "generic": {"product_info": 0.28, "after_sale": 0.32, "price_activity": 0.04, "courier_info": 0.03, "shipping_sla": 0.03, "other": 0.30},
    "strict": {"product_info": 0.20, "after_sale": 0.28, "price_activity": 0.08, "courier_info": 0.06, "shipping_sla": 0.06, "other": 0.32},
    "default": {"product_info": 0.26, "after_sale": 0.24, "price_activity": 0.10, "courier_info": 0.08, "shipping_sla": 0.08, "other": 0.24},
}
#: Shares of the repair job's categories.
REPAIR_SHARES = {"address": 0.14, "refund": 0.23, "shipping": 0.20, "promo": 0.14, "product": 0.16, "other": 0.25}


def category_caps(top_k: int, strict: bool = False, generic: bool = False, sft: bool = False, shares: dict[str, dict[str, float]] = SHARES) -> dict[str, int]:
    """Places of each category: share of k, cut to whole; sft before generic before strict."""
    mode = "sft" if sft else "generic" if generic else "strict" if strict else "default"
    return {name: int(top_k * share) for name, share in shares[mode].items()}


def ranked(df: DataFrame, order: list[Column]) -> DataFrame:
    """`rank` from 1 by a global order. One sorted pass numbers the rows inside
    range partitions and adds the sizes of the partitions before; no task gets
    the whole table."""
    if not df.columns:
        return df
    rows = cut(df.repartitionByRange(max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    local = F.row_number().over(W.partitionBy("_part").orderBy("_at"))
    return rows.withColumn("_local", local).join(F.broadcast(before.select("_part", "_before")), "_part").withColumn("rank", F.col("_before") + F.col("_local")).drop("_part", "_at", "_local", "_before")


def _walk(keys: list[str], caps: list[str], stop: int | None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        used: list[Counter] = [Counter() for _ in keys]
        taken = 0
        for pdf in batches:
            out = []
            for rank, held, *row in zip(pdf["rank"], pdf["held"], *[pdf[k] for k in keys], *[pdf[c] for c in caps]):
                if stop is not None and taken >= stop:
                    break
                names, limits = row[: len(keys)], row[len(keys) :]
                if held or not any(not pd.isna(m) and counter[n] >= m for counter, n, m in zip(used, names, limits)):
                    taken += 1
                    for counter, n in zip(used, names):
                        counter[n] += 1
                    if not held:
                        out.append(rank)
            yield pd.DataFrame({"rank": pd.Series(out, dtype="int64")})

    return run


def _limit(category: str, caps: dict[str, int], rest: int) -> Column:
    """A category's cap; `rest` for those without one."""
    out = F.lit(float(rest))
    for name, cap in sorted(caps.items()):
        out = F.when(F.col(category) == name, float(cap)).otherwise(out)
    return out


def _full(rows: DataFrame, keys: list[str], caps: list[str], i: int) -> DataFrame:
    """Values of key i that are full, and the rank of the row that filled them."""
    place = F.row_number().over(W.partitionBy(keys[i]).orderBy("rank"))
    return rows.select(keys[i], caps[i], "rank", place.alias("_n")).where(F.col("_n") >= F.col(caps[i])).groupBy(keys[i]).agg(F.min("rank").alias(f"_full{i}"))


def accepted(df: DataFrame, keys: list[str], caps: list[str], stop: int, held: DataFrame | None = None) -> DataFrame:
    """`rank, keys, caps` of the accepted rows, `stop` at most. `caps` are columns
    with the cap of a row's key (null: none), the same for equal keys. `held` are
    rows that use places from the start (and count for `stop`); they come back too.
    What is kept between walks is bounded by `stop`."""
    narrow = lambda d: d.select("rank", *[F.coalesce(F.col(k).cast("string"), F.lit("")).alias(k) for k in keys], *[F.col(c).cast("double").alias(c) for c in caps])
    done = narrow(held) if held is not None else narrow(df).where("false")
    possible = reduce(lambda a, c: a & (F.col(c).isNull() | (F.col(c) > 0)), caps, F.lit(True))
    state = narrow(df).where(possible).withColumn("_at", F.col("rank"))
    while True:
        part = done.withColumn("held", F.lit(True)).unionByName(state.where(F.col("_at") <= WALK_ROWS).drop("_at").withColumn("held", F.lit(False)))
        stream = part.repartition(1).sortWithinPartitions(F.desc("held"), "rank")
        picked = stream.mapInPandas(_walk(keys, caps, stop), "rank long")
        done = cut(done.unionByName(narrow(df).join(picked, "rank", "left_semi")))
        rest = state.where(F.col("_at") > WALK_ROWS)
        if done.count() >= stop or rest.isEmpty():
            return done
        for i, k in enumerate(keys):
            rest = rest.join(_full(done, keys, caps, i).select(k), k, "left_anti")
        state = ranked(rest.drop("_at").withColumnRenamed("rank", "_old"), [F.asc("_old")]).withColumnRenamed("rank", "_at").withColumnRenamed("_old", "rank")
        if state.isEmpty():
            return done


def decide(df: DataFrame, keys: list[str], caps: list[str], done: DataFrame, stop: int) -> DataFrame:
    """`rank, drop_key` of the rows of `df` up to the last one that was looked at:
    -1 for the rows in `done`, else the number of the first full key."""
    last = done.agg(F.when(F.count("*") >= stop, F.max("rank")).alias("_last"))
    rows = df.select("rank", *[F.coalesce(F.col(k).cast("string"), F.lit("")).alias(k) for k in keys], *[F.col(c).cast("double").alias(c) for c in caps]).join(F.broadcast(last)).where("_last is null or rank <= _last")
    rows = rows.join(done.select("rank", F.lit(-1).alias("_in")), "rank", "left")
    first = F.lit(None).cast("int")
    for i, k in enumerate(keys):
        rows = rows.join(_full(done, keys, caps, i), k, "left")
        first = F.coalesce(first, F.when((F.col(f"_full{i}") < F.col("rank")) | (F.col(caps[i]) <= 0), i))
    return rows.select("rank", F.coalesce("_in", first).alias("drop_key"))


def diverse_topk(pairs: DataFrame, order: list[Column], top_k: int, caps: dict[str, int], template_cap: int = 5, question_cap: int = 2, pair_cap: int = 1, category: str = "category", template: str = "template", question: str = "asked_key", pair: str = "pair_key") -> DataFrame:
    """Two passes over pairs in rank order. Pass 1 caps category, template,
    question and pair and stops at k; pass 2 walks what pass 1 rejected with caps
    of one more and without the category. An empty or missing key counts as one
    value of its own, a missing category as "other", a category without a cap may
    take all k. Adds rank and pass_no."""
    picked, _, _ = _two_passes(pairs, order, top_k, caps, template_cap, question_cap, pair_cap, category, template, question, pair)
    return picked


def topk_counters(pairs: DataFrame, order: list[Column], top_k: int, caps: dict[str, int], template_cap: int = 5, question_cap: int = 2, pair_cap: int = 1, category: str = "category", template: str = "template", question: str = "asked_key", pair: str = "pair_key") -> DataFrame:
    """`reason, n` of a selection by `diverse_topk`: rows dropped by each cap in
    either pass up to the last accepted row, rows selected in each."""
    picked, one, two = _two_passes(pairs, order, top_k, caps, template_cap, question_cap, pair_cap, category, template, question, pair)
    names = ["drop_category", "drop_template", "drop_question", "drop_pair"]
    parts = [drop_reasons(one, names), picked.groupBy(F.concat(F.lit("selected_pass_"), F.col("pass_no").cast("string")).alias("reason")).agg(F.count("*").alias("n"))]
    if two is not None:
        parts.append(drop_reasons(two, [f"{n}_relaxed" for n in names[1:]]))
    return reduce(DataFrame.unionByName, parts)


def _two_passes(pairs: DataFrame, order: list[Column], top_k: int, caps: dict[str, int], template_cap: int, question_cap: int, pair_cap: int, category: str, template: str, question: str, pair: str) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """The selected rows, the decisions of pass 1, and those of pass 2 about what
    pass 1 rejected (none if pass 1 was enough)."""
    rows = cut(ranked(pairs, order))
    kind = F.when(F.trim(category) == "", None).otherwise(F.col(category))
    keyed = rows.select("rank", F.coalesce(kind, F.lit("other")).alias("_k0"), *[F.coalesce(k, F.lit("")).alias(f"_k{i}") for i, k in enumerate((template, question, pair), 1)])
    keyed = keyed.withColumn("_c0", _limit("_k0", caps, top_k))
    for i, cap in enumerate((template_cap, question_cap, pair_cap), 1):
        keyed = keyed.withColumn(f"_c{i}", F.lit(float(cap)))
    keyed = cut(keyed)
    keys = ["_k0", "_k1", "_k2", "_k3"]
    limits = ["_c0", "_c1", "_c2", "_c3"]
    chosen = accepted(keyed, keys, limits, top_k)
    one = decide(keyed, keys, limits, chosen, top_k)
    n = chosen.count()
    first = rows.join(chosen.select("rank"), "rank", "left_semi").withColumn("pass_no", F.lit(1))
    if n >= top_k:
        return cut(first), one, None
    # Pass 2 starts from the places that pass 1 used. Fewer than k were accepted, so
    # every row has been decided.
    for i, cap in enumerate((template_cap, question_cap, pair_cap), 1):
        keyed = keyed.withColumn(f"_c{i}", F.lit(float(cap + 1)))
    rest = keyed.join(chosen.select("rank"), "rank", "left_anti")
    # Walks count places from 1; held rows come first whatever their rank.
    held = keyed.join(chosen.select("rank"), "rank", "left_semi").withColumn("rank", -F.col("rank"))
    order_ = cut(ranked(rest.withColumnRenamed("rank", "_old"), [F.asc("_old")]))
    both = accepted(order_, keys[1:], limits[1:], top_k, held)
    two = decide(order_, keys[1:], limits[1:], both, top_k)
    more = order_.join(both.select("rank"), "rank", "left_semi").select(F.col("_old").alias("rank"))
    return cut(first.unionByName(rows.join(more, "rank", "left_semi").withColumn("pass_no", F.lit(2)))), one, two


def drop_reasons(one: DataFrame, names: list[str]) -> DataFrame:
    """`reason, n`: how many of the walked rows each cap dropped."""
    return one.where("drop_key >= 0").groupBy(F.element_at(F.array(*[F.lit(n) for n in names]), F.col("drop_key") + 1).alias("reason")).agg(F.count("*").alias("n"))


def diverse_repaired(groups: DataFrame, order: list[Column], top_k: int, caps: dict[str, int], template: str, question: str, category: str = "category", question_cap: int = 2, same: tuple[str, ...] = ()) -> DataFrame:
    """The repair job's selection: caps of template (3, 4 or 5 by k), question and
    category, then the best of the rest whatever their caps. The fill takes a pair
    (the columns `same`) once, and none that is selected already."""
    template_cap = 3 if top_k <= 5000 else 4 if top_k <= 10_000 else 5
    rows = cut(ranked(groups, order))
    keyed = rows.withColumn("_c0", F.lit(float(template_cap))).withColumn("_c1", F.lit(float(question_cap))).withColumn("_c2", _limit(category, caps, top_k))
    chosen = accepted(keyed, [template, question, category], ["_c0", "_c1", "_c2"], top_k).select("rank")
    n = chosen.count()
    if n >= top_k:
        return rows.join(chosen.withColumn("pass_no", F.lit(1)), "rank")
    # Of each pair the first rank, from one aggregate over digests of the keys.
    digest = F.sha2(F.to_json(F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(same)])), 256) if same else F.col("rank").cast("string")
    marked = rows.select("rank", digest.alias("_d")).join(chosen.withColumn("_in", F.lit(True)), "rank", "left")
    free = marked.groupBy("_d").agg(F.min("rank").alias("rank"), F.max(F.coalesce("_in", F.lit(False))).alias("_in")).where("not _in")
    fill = free.select("rank").orderBy("rank").limit(top_k - n)
    picked = chosen.withColumn("pass_no", F.lit(1)).unionByName(fill.withColumn("pass_no", F.lit(2)))
    return rows.join(picked, "rank")


def most_frequent(df: DataFrame, key: Column, n: int, name: str = "value") -> DataFrame:
    """The n most frequent values, ties by value."""
    return df.groupBy(key.alias(name)).agg(F.count("*").alias("n")).orderBy(F.desc("n"), name).limit(n)
