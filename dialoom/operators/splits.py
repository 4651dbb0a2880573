"""Splits, samples, noise and replacement, all repeatable: order comes from md5
of seed and key, never from the layout of partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from dialoom.operators.quota import ranked
from dialoom.session import cut

PATTERN = ("train", "train", "train", "dev", "test")
#: Groups whose first ranks are sent to all tasks; with more of them both sides are joined by group.
GROUPS = 100_000


def shuffle_key(key: Column | str, seed: int | str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), (F.col(key) if isinstance(key, str) else key).cast("string")))


def place_in(df: DataFrame, group: str, order: list[Column], name: str) -> DataFrame:
    """`name`: the row's place in its group, from 1, with the group's size as
    `{name}_of`. Rows are ranked over (group, order) in range partitions, so that a
    group of any size is no single task; nulls are a group."""
    rows = cut(ranked(df, [F.asc_nulls_first(group), *order]))
    first = rows.groupBy(F.col(group).alias("_group")).agg(F.min("rank").alias("_first"), F.count("*").alias(f"{name}_of"))
    out = rows.withColumnRenamed("rank", name).join(F.broadcast(first) if first.limit(GROUPS + 1).count() <= GROUPS else first, F.col(group).eqNullSafe(F.col("_group")))
    return out.withColumn(name, F.col(name) - F.col("_first") + 1).drop("_group", "_first")


def pattern_split(df: DataFrame, category: str, order: list[Column], pattern: tuple[str, ...] = PATTERN) -> DataFrame:
    """`split` by the row's place in its category, going round the pattern."""
    place = (F.col("_place") - 1) % len(pattern)
    return place_in(df, category, order, "_place").withColumn("split", F.element_at(F.array(*[F.lit(p) for p in pattern]), (place + 1).cast("int"))).drop("_place", "_place_of")


def balance_splits(df: DataFrame, sizes: dict[str, int], order: list[Column], split: str = "split") -> DataFrame:
    """Moves the last rows of splits that are too large to those too small until
    the sizes hold. The plan is made from the counts alone; the sizes must sum to
    the number of rows."""
    counts = {r[split]: r["n"] for r in df.groupBy(split).agg(F.count("*").alias("n")).collect()}
    if sum(counts.values()) != sum(sizes.values()):
        raise ValueError(f"the sizes sum to {sum(sizes.values())}, the table has {sum(counts.values())} rows")
    surplus = {s: counts.get(s, 0) - n for s, n in sizes.items() if counts.get(s, 0) > n}
    gaps = [(s, n - counts.get(s, 0)) for s, n in sizes.items() if n > counts.get(s, 0)]
    if not gaps:
        return df
    before, total = {}, 0
    for s, n in sorted(surplus.items()):
        before[s], total = total, total + n
    pick = lambda m: F.create_map(*[F.lit(x) for item in sorted(m.items()) for x in item])[F.col(split)]
    # The last row of a split has number 1; moved rows fill one gap after the other.
    back = F.col("_place_of") - F.col("_place") + 1
    at, target, end = pick(before) + back, F.lit(None).cast("string"), 0
    for s, n in gaps:
        end += n
        target = F.coalesce(target, F.when(at <= end, F.lit(s)))
    moved = back <= F.coalesce(pick(surplus), F.lit(0))
    return place_in(df, split, order, "_place").withColumn(split, F.when(moved, target).otherwise(F.col(split))).drop("_place", "_place_of")


def split_stats(df: DataFrame, split: str = "split", category: str = "category", score: str = "score", rank: str = "rank") -> DataFrame:
    """Per split: rows, mean score, bounds of the rank and a histogram of categories."""
    kind = F.coalesce(F.col(category), F.lit("")).alias("_kind")
    one = df.groupBy(split, kind).agg(F.count("*").alias("n"), F.sum(score).alias("s"), F.min(rank).alias("lo"), F.max(rank).alias("hi"))
    histogram = F.map_from_entries(F.array_sort(F.collect_list(F.struct("_kind", "n"))))
    return one.groupBy(split).agg(F.sum("n").alias("rows"), F.bround(F.sum("s") / F.sum("n"), 4).alias("mean_score"), F.min("lo").alias("min_rank"), F.max("hi").alias("max_rank"), histogram.alias("categories"))


def exact_head(df: DataFrame, key: str, n: int, seed: int | str) -> DataFrame:
    """n rows, the first by hash; ties by key. Ranked in range partitions: n may be
    a share of the table."""
    return ranked(df.withColumn("_h", shuffle_key(key, seed)), [F.asc("_h"), F.asc(key)]).where(F.col("rank") <= n).drop("_h", "rank")


def holdout(df: DataFrame, key: str, ratio: float, seed: int | str = 42) -> DataFrame:
    """`is_validation`: exactly max(1, int(rows * ratio)) rows by hash order."""
    rows = ranked(df.withColumn("_h", shuffle_key(key, seed)), [F.asc("_h"), F.asc(key)])
    n = max(1, int(df.count() * ratio))
    return rows.withColumn("is_validation", F.col("rank") <= n).drop("_h", "rank")


def add_noise(df: DataFrame, key: str, ratio: float, seed: int | str = 42, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """Chosen and rejected swapped on exactly round(rows * ratio) rows (half to
    even); stamps noise_ratio, noise_swapped, source_index (place by key from 0)."""
    n = round(df.count() * ratio)
    rows = ranked(df.withColumn("_h", shuffle_key(key, seed)), [F.asc("_h"), F.asc(key)]).withColumn("noise_swapped", F.col("rank") <= n).drop("_h", "rank")
    out = ranked(rows, [F.asc(key)]).withColumn("source_index", F.col("rank") - 1).drop("rank")
    a, b = F.when(F.col("noise_swapped"), F.col(rejected)).otherwise(F.col(chosen)), F.when(F.col("noise_swapped"), F.col(chosen)).otherwise(F.col(rejected))
    return out.withColumn("_a", a).withColumn("_b", b).withColumn(chosen, F.col("_a")).withColumn(rejected, F.col("_b")).drop("_a", "_b").withColumn("noise_ratio", F.lit(ratio))


def sample_indices(df: DataFrame, key: str, n: int, seed: int | str = 42, saved: DataFrame | None = None) -> DataFrame:
    """`key, sample_rank` of n rows; saved indices are taken instead if given, and
    must be in the table, each once."""
    if saved is None:
        return ranked(exact_head(df.select(key), key, n, seed), [shuffle_key(key, seed), F.asc(key)]).select(key, F.col("rank").alias("sample_rank"))
    checked = saved.join(df.select(F.col(key).alias("_known")), F.col(key) == F.col("_known"), "left")
    twice = F.count("*").over(W.partitionBy(key)) > 1
    problem = F.when(F.col("_known").isNull(), F.raise_error(F.lit("an index is not in the table"))).when(twice, F.raise_error(F.lit("an index is there twice"))).otherwise(F.col(key))
    return checked.withColumn(key, problem).drop("_known")


def read_indices(c: Column | str) -> Column:
    """array<bigint> of an index file in one of its shapes: an array of numbers or
    of objects, or an object with indices, source_indices, samples or results."""
    text = F.col(c) if isinstance(c, str) else c
    numbers = F.from_json(text, "array<bigint>")
    objects = lambda j, t: F.transform(F.from_json(j, f"array<struct<{t}:bigint>>"), lambda x: x[t])
    some = lambda a: F.when((F.size(a) > 0) & ~F.exists(a, lambda x: x.isNull()), a)
    inside = lambda k: F.get_json_object(text, f"$.{k}")
    shapes = [numbers, objects(text, "source_index"), objects(text, "index"), F.from_json(inside("indices"), "array<bigint>"), F.from_json(inside("source_indices"), "array<bigint>")]
    shapes += [objects(inside(k), "source_index") for k in ("samples", "results")]
    out = F.coalesce(*[some(s) for s in shapes])
    return F.when(F.size(F.array_distinct(out)) < F.size(out), F.raise_error(F.lit("an index is there twice")).cast("array<bigint>")).otherwise(out)


def replace_riskiest(df: DataFrame, key: str, risk: Column, synthetic: DataFrame) -> DataFrame:
    """The rows of the highest risk (ties: the later row) make room for as many
    synthetic ones."""
    n = synthetic.count()
    worst = cut(ranked(df.select(key, risk.alias("_risk")), [F.desc("_risk"), F.desc(key)]).where(F.col("rank") <= n).select(key))
    kept = df.join(worst, key, "left_anti")
    return kept.unionByName(synthetic, allowMissingColumns=True)


def scenarios(dialogues: DataFrame, wrappers: DataFrame) -> DataFrame:
    """Every dialogue in every wrapper; which side is sent, if any, is left to
    Catalyst."""
    return dialogues.crossJoin(wrappers)
