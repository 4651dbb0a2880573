"""Problem 3: a sample whose category mix follows given shares.

Cube method on category indicators. Every row starts with the inclusion
probability wanted / available of its category. Flight: unresolved rows of one
category are paired and moved along the kernel direction (1, -1) of the
indicator constraints, which keeps every category sum, until at most one row of
a category is left in a partition; those go upward in merging steps and fly
again; the landing settles what remains by a last draw. The report holds the
residual imbalance.

Defined cases: a category is compared without regard to case, outer blanks and
the joining of words by "_", "-" or a blank; rows with a null or blank one are
in none (they count for the sample size only). Shares of a category without
rows are reported as unmet; an empty table gives an empty sample. Equal rows are
separate rows; further columns are kept in the sample."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from dialoom.session import cut

#: Partitions whose unresolved rows are put together in one merging step.
FAN_IN = 64


def category_key(column: str | Column) -> Column:
    """Comparison form of a category; null where there is none."""
    text = F.lower(F.regexp_replace(F.col(column) if isinstance(column, str) else column, r"(?U)^\s+|\s+$", ""))
    joined = F.regexp_replace(text, r"(?U)[\s_-]+", "_")
    return F.when(joined != "", joined)


@dataclass
class Balanced:
    sample: DataFrame
    report: DataFrame


def _uniform(keys: np.ndarray, seed: int, salt: int) -> np.ndarray:
    """Repeatable numbers in [0, 1) from row keys (splitmix64)."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + np.uint64((seed * 1_000_003 + salt) % 2**63) * np.uint64(0x9E3779B97F4A7C15)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / 2**53


def flight(keys: np.ndarray, groups: np.ndarray, chance: np.ndarray, seed: int, salt: int = 0) -> np.ndarray:
    """Inclusion probabilities after the flight: 0 or 1 but for at most one row
    of each group. Each round pairs the open rows of a group and moves each pair
    to a face of the cube; the group's sum stays as it was."""
    p = np.clip(chance.astype(np.float64), 0.0, 1.0)
    for step in range(200):
        p[p < 1e-9], p[p > 1 - 1e-9] = 0.0, 1.0
        rows = np.flatnonzero((p > 0) & (p < 1))
        order = np.lexsort((_uniform(keys[rows], seed, salt + 2 * step), groups[rows]))
        rows = rows[order]
        group = groups[rows]
        starts = np.r_[True, group[1:] != group[:-1]] if len(rows) else np.array([], bool)
        place = np.arange(len(rows)) - np.maximum.accumulate(np.where(starts, np.arange(len(rows)), 0)) if len(rows) else rows
        first = np.flatnonzero((place % 2 == 0)[:-1] & (group[1:] == group[:-1])) if len(rows) > 1 else np.array([], int)
        if not len(first):
            break
        a, b = rows[first], rows[first + 1]
        up, down = np.minimum(1 - p[a], p[b]), np.minimum(p[a], 1 - p[b])
        rise = _uniform(keys[a] ^ (keys[b] << np.int64(1)), seed, salt + 2 * step + 1) < down / (up + down)
        move = np.where(rise, up, -down)
        p[a] += move
        p[b] -= move
    p[p < 1e-9], p[p > 1 - 1e-9] = 0.0, 1.0
    return p


def _merge(seed: int, salt: int, top: bool):
    """A merging step over the unresolved rows of several partitions; the last
    one is the landing."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        p = flight(pdf["id"].to_numpy(), pdf["grp"].to_numpy(), pdf["p"].to_numpy(), seed, salt)
        if top:
            p = (_uniform(pdf["id"].to_numpy(), seed, salt + 999) < p).astype(float)
        return pdf.assign(p=p)[p > 0]

    return run


def balanced_sample(df: DataFrame, shares: DataFrame, population: str, key: str, category: str = "category", seed: int = 7) -> Balanced:
    """Sample of `df` and report against the rows of `shares` (population,
    category, target_share, min_rows, sample_rate) for `population`.

    report: population, category, available, sample_size, needed, wanted, drawn,
    imbalance (drawn - needed), met."""
    goals = shares.where(F.col("population") == population).withColumn("_key", category_key("category"))
    seen = df.select(category_key(category).alias("_key")).groupBy("_key").agg(F.count("*").alias("n"))
    seen = cut(seen)
    total = seen.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    plan = goals.join(F.broadcast(total)).join(seen.where("_key is not null"), "_key", "left")
    plan = plan.withColumn("available", F.coalesce("n", F.lit(0)).cast("long")).withColumn("sample_size", F.floor(F.col("sample_rate") * F.col("total") + 0.5).cast("long"))
    plan = plan.withColumn("needed", F.greatest(F.col("min_rows").cast("double"), F.col("target_share") * F.col("sample_size")))
    plan = plan.withColumn("wanted", F.least(F.col("available"), F.greatest(F.col("min_rows"), F.round(F.col("target_share") * F.col("sample_size")).cast("long"))))
    plan = cut(plan.select("population", "category", "_key", "available", "sample_size", "needed", "wanted"))
    # One row per category of the target table, a fixed list.
    chances = {r["_key"]: (i, r["wanted"] / r["available"]) for i, r in enumerate(plan.where("available > 0").orderBy("_key").collect())}

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, groups = [], []
        for pdf in batches:
            got = pdf["_key"].map(lambda c: chances.get(c, (-1, 0))[0]).to_numpy()
            keys.append(pdf[key].to_numpy()[got >= 0])
            groups.append(got[got >= 0])
            if sum(map(len, keys)) > 500_000:
                yield fly(keys, groups)
                keys, groups = [], []
        if keys:
            yield fly(keys, groups)

    rates = np.array([c[1] for c in sorted(chances.values())]) if chances else np.array([0.0])

    def fly(keys: list, groups: list) -> pd.DataFrame:
        k, g = np.concatenate(keys).astype(np.int64), np.concatenate(groups).astype(np.int64)
        p = flight(k, g, rates[g] if len(g) else np.array([]), seed)
        keep = p > 0
        return pd.DataFrame({"id": k[keep], "grp": g[keep], "p": p[keep], "part": TaskContext.get().partitionId()})

    schema = "id long, grp long, p double, part int"
    state = df.select(F.col(key), category_key(category).alias("_key")).where("_key is not null").mapInPandas(first, schema)
    drawn, level = cut(state), 1
    chosen = drawn.where("p = 1").select("id")
    left = drawn.where("p < 1")
    while True:
        parts = left.agg(F.max("part")).first()[0]
        if parts is None:
            break

        merged = left.withColumn("part", (F.col("part") / FAN_IN).cast("int")).groupBy("part").applyInPandas(_merge(seed, 1000 * level, parts == 0), schema)
        merged = cut(merged)
        chosen = chosen.unionByName(merged.where("p = 1").select("id"))
        left, level = merged.where("p < 1"), level + 1
    sample = df.join(chosen.withColumnRenamed("id", key), key, "left_semi")
    got = sample.groupBy(category_key(category).alias("_key")).agg(F.count("*").alias("drawn"))
    report = plan.join(got, "_key", "left").withColumn("drawn", F.coalesce("drawn", F.lit(0)))
    report = report.withColumn("imbalance", F.col("drawn") - F.col("needed")).withColumn("met", F.col("available") + 1e-9 >= F.col("needed"))
    return Balanced(sample, report.drop("_key"))
