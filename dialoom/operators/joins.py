"""Alignments of result tables."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from dialoom.functions.clean import strip
from dialoom.functions.predicates import mentions
from dialoom.session import cut


def align(base: DataFrame, other: DataFrame, key: list[str], order: str, word: str | None = None, most: int | None = None) -> DataFrame:
    """Rows of `other` with the base row of the same key; of equal base keys the
    last counts; in the order of `other`, at most `most`."""
    fields = [c for c in base.columns if c not in key]
    last = base.groupBy(*key).agg(F.max_by(F.struct(*fields), order).alias("base"))
    out = other.join(last, key)
    if word:
        out = out.where(mentions(["prompt", "prediction", "reference"], word))
    return out.orderBy(order).limit(most) if most is not None else out


def result_key(index: str = "source_index", prompt: str = "prompt") -> Column:
    """What results are aligned by: the index if there is one, else the prompt."""
    return F.when(F.col(index).isNotNull(), F.concat(F.lit("i:"), F.col(index).cast("string"))).otherwise(F.concat(F.lit("p:"), strip(F.coalesce(prompt, F.lit("")))))


def cascade(left: DataFrame, right: DataFrame, levels: list[list[str]], left_id: str, right_id: str, complete: bool = False) -> DataFrame:
    """`left_id, right_id, level`: each left row, in the order of ids, takes the first
    right row that is free by the first key list, else by the next, and so on; no
    row is taken twice. Each level's keys hold those of the next, so rows that can
    compete share the last level's key and are streamed through one task in order;
    of a key only the right ids are kept. A null in a key matches nothing at its
    level. With `complete`, a left row without a partner makes the result empty."""
    last = levels[-1]
    if any(set(b) - set(a) for a, b in zip(levels, levels[1:])):
        raise ValueError("each level's keys must hold those of the next")
    text = lambda keys: F.when(reduce(lambda a, k: a & F.col(k).isNotNull(), keys, F.lit(True)), F.to_json(F.array(*[F.col(k).cast("string") for k in keys])))
    side = lambda df, i, n: df.select(F.lit(n).alias("side"), F.col(i).cast("string").alias("id"), F.col(i).alias("at"), *[text(k).alias(f"k{j}") for j, k in enumerate(levels)])
    key = f"k{len(levels) - 1}"
    both = side(right, right_id, 0).unionByName(side(left, left_id, 1)).where(F.col(key).isNotNull())
    names = [f"k{j}" for j in range(len(levels))]

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, free, used = None, {}, set()
        for pdf in batches:
            out = []
            for where, side_, id_, *keys in zip(pdf[key], pdf["side"], pdf["id"], *[pdf[n] for n in names]):
                if where != current:
                    current, free, used = where, {}, set()
                if side_ == 0:
                    for j, k in enumerate(keys):
                        if k is not None:
                            free.setdefault((j, k), deque()).append(id_)
                    continue
                for j, k in enumerate(keys):
                    queue = free.get((j, k), ()) if k is not None else ()
                    while queue and queue[0] in used:
                        queue.popleft()
                    if queue:
                        used.add(queue[0])
                        out.append((id_, queue.popleft(), j))
                        break
            yield pd.DataFrame(out, columns=["a", "b", "level"])

    found = both.repartition(key).sortWithinPartitions(key, "side", "at").mapInPandas(match, "a string, b string, level int")
    out = found.select(F.col("a").cast(left.schema[left_id].dataType).alias(left_id), F.col("b").cast(right.schema[right_id].dataType).alias(right_id), "level")
    if not complete:
        return out
    out = cut(out)
    return out if out.count() == left.count() else out.where("false")


def star(base: DataFrame, others: list[DataFrame], key: str) -> DataFrame:
    """Left joins of single-row tables per key."""
    return reduce(lambda a, b: a.join(b, key, "left"), others, base)


def last_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    fields = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*fields), order).alias("_last")).select(key, "_last.*")


def against_baseline(df: DataFrame, key: str, baseline: str, metrics: list[str], percent: bool = False, suffix: str = "_delta") -> DataFrame:
    """Each metric against the one row named `baseline`: difference, or percent of
    it; null where either is missing."""
    one = df.where(F.col(key) == baseline).select(*[F.col(m).alias(f"_b_{m}") for m in metrics]).limit(1)
    joined = df.join(F.broadcast(one), F.lit(True), "left")
    for m in metrics:
        difference = F.col(m) - F.col(f"_b_{m}")
        joined = joined.withColumn(m + suffix, F.when(F.col(f"_b_{m}") != 0, difference / F.col(f"_b_{m}") * 100) if percent else difference)
    return joined.drop(*[f"_b_{m}" for m in metrics])


def saving(df: DataFrame, key: str, small: str, large: str, metric: str, name: str = "saving") -> DataFrame:
    """`name`: percent of `metric` that the row `small` saves against the row `large`
    (0 in that row); null elsewhere, and where one of the two is missing or 0."""
    of = lambda run: df.agg(F.max_by(metric, F.when(F.col(key) == run, 1)).alias(f"_{'s' if run == small else 'l'}"))
    both = df.join(F.broadcast(of(small).join(of(large))))
    known = (F.col("_s") != 0) & (F.col("_l") != 0)
    value = F.when(known & (F.col(key) == small), (F.col("_l") - F.col("_s")) / F.col("_l") * 100).when(known & (F.col(key) == large), F.lit(0.0))
    return both.withColumn(name, value).drop("_s", "_l")
