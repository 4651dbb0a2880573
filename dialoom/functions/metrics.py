"""Overlap metrics of prediction and reference as column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from dialoom.functions.clean import SPACE, col, strip


def characters(c: Column | str) -> Column:
    """Characters of a text without blanks; none for an empty text."""
    text = F.regexp_replace(F.coalesce(col(c), F.lit("")), SPACE, "")
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ""))


def exact_match(a: Column | str, b: Column | str) -> Column:
    return (strip(F.coalesce(col(a), F.lit(""))) == strip(F.coalesce(col(b), F.lit("")))).cast("int")


def common_characters(a: Column, b: Column) -> Column:
    """Size of the intersection of two character multisets."""
    count = lambda xs, y: F.size(F.filter(xs, lambda x: x == y))
    return F.aggregate(F.array_distinct(a), F.lit(0), lambda n, y: n + F.least(count(a, y), count(b, y)))


def char_f1(a: Column | str, b: Column | str) -> Column:
    """F1 on multisets of characters; 0 without common ones."""
    x, y = characters(a), characters(b)
    return f1_of(common_characters(x, y), F.size(x), F.size(y))


def f1_of(common: Column, left: Column, right: Column) -> Column:
    p, r = common / left, common / right
    return F.when(common > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))


@F.pandas_udf(T.IntegerType())
def lcs_text(a: pd.Series, b: pd.Series) -> pd.Series:
    """Length of the longest common subsequence of two texts of any length,
    bit-parallel, in Arrow batches."""

    def one(x: str | None, y: str | None) -> int:
        if not x or not y:
            return 0
        places: dict[str, int] = {}
        for i, c in enumerate(x):
            places[c] = places.get(c, 0) | 1 << i
        full = (1 << len(x)) - 1
        row = full
        for c in y:
            hit = row & places.get(c, 0)
            row = (row + hit) & full | row & ~hit
        return len(x) - row.bit_count()

    return pd.Series([one(x, y) for x, y in zip(a, b)], dtype="int32")


def rouge_l(a: Column | str, b: Column | str, beta: float = 1.2) -> Column:
    """Character ROUGE-L; 0 if a side is empty."""
    x, y = (F.regexp_replace(F.coalesce(col(t), F.lit("")), SPACE, "") for t in (a, b))
    return rouge_of(lcs_text(x, y), F.length(x), F.length(y), beta)


def rouge_of(common: Column, left: Column, right: Column, beta: float = 1.2) -> Column:
    p, r = common / left, common / right
    return F.when((left > 0) & (right > 0), (1 + beta**2) * p * r / (r + beta**2 * p + 1e-12)).otherwise(F.lit(0.0))


def outcome(chosen: Column | str, rejected: Column | str) -> Column:
    """win, tie or loss of two log-probabilities; error if one is not finite."""
    a, b = col(chosen), col(rejected)
    finite = a.isNotNull() & b.isNotNull() & ~F.isnan(a) & ~F.isnan(b) & (F.abs(a) < float("inf")) & (F.abs(b) < float("inf"))
    return F.when(~finite, "error").when(a > b, "win").when(a == b, "tie").otherwise("loss")


def per_token(total: Column | str, tokens: Column | str) -> Column:
    return F.when(col(tokens) > 0, col(total) / col(tokens))

