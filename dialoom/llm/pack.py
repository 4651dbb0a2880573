"""Problem 9: containers of fixed capacity, filled with whole texts.

Vector best fit. An item uses tokens, one document place and attention cost (the
square of its tokens); a container has a capacity for each. Items go in order of
falling size to the open container whose residual vector has the largest
weighted dot product with the item ("dot") or the least norm after placing it
("norm"), among those with room under every constraint.

Items are packed in groups of bounded size; containers of a group that are not
full enough are opened once more and packed together with those of many groups,
so little room is lost at the borders. Only a text larger than the capacity is
cut: into full pieces, which fill containers of their own, and a rest.

Attention cost keeps a container from being filled by one long text and little
else: its capacity is ATTENTION of the square of the tokens, so an item of more
than its root's share of the tokens is over it alone. Such an item can not be cut;
it gets a container, and only items that cost nothing may join it.

Defined cases: a text without tokens (null, empty) is an item of size 0 and goes
into a container of its group; an empty table gives no containers. Repeated rows
are separate items; further columns are ignored."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from dialoom.llm.encode import RANKS, TOKENIZERS, count_tokens
from dialoom.session import cut

#: Items of a group; containers filled less than REOPEN are packed again.
GROUP_ITEMS, REOPEN = 12_000, 0.985
#: Documents that a container holds at most (each needs a border and positions of
#: its own); attention cost as a share of capacity squared. Below 1 the cost binds:
#: a batch of such containers is bounded in time, not in tokens alone.
MAX_DOCS, ATTENTION = 256, 0.85
#: Weights of the residual tokens, places and attention cost.
WEIGHTS = (1.0, 0.05, 0.25)
#: Number of container ids of one group; the upper half is for pieces of long texts,
#: more than any group has tokens.
IDS = 1 << 33


def best_fit(sizes: np.ndarray, capacity: int, max_docs: int = MAX_DOCS, attention: float = ATTENTION, rule: str = "norm") -> np.ndarray:
    """Container of each item. Each item looks at the open containers only; those
    without room for the smallest item left are closed. Items of size 0 use a place
    and nothing else, and fill what places are left at the end."""
    where = np.zeros(len(sizes), np.int64)
    order = np.argsort(-sizes, kind="stable")
    order, empty = order[sizes[order] > 0], np.flatnonzero(sizes <= 0)
    limit = attention * float(capacity) ** 2
    weights = np.array(WEIGHTS)
    left = np.empty((3, len(order)))  # residuals as shares: tokens, places, attention
    ids = np.empty(len(order), np.int64)
    opened = made = 0
    smallest = sizes[order[-1]] / capacity if len(order) else 0
    share, place, cost = sizes / capacity, 1.0 / max_docs, sizes.astype(float) ** 2 / limit
    for i in order:
        need = np.array([share[i], place, cost[i]])
        rest = left[:, :opened] - need[:, None]
        fits = np.flatnonzero((rest > -1e-12).all(axis=0)) if opened else np.array([], int)
        if len(fits):
            if rule == "dot":
                k = fits[np.argmax((weights * need) @ left[:, fits])]
            else:
                k = fits[np.argmin(weights @ rest[:, fits] ** 2)]
        else:
            k = opened
            left[:, k], ids[k] = 1.0, made
            opened, made = opened + 1, made + 1
        left[:, k] -= need
        where[i] = ids[k]
        if left[0, k] < smallest - 1e-12 or left[1, k] < place - 1e-12 or left[2, k] < smallest**2 * capacity**2 / limit - 1e-12:
            opened -= 1
            left[:, k], ids[k] = left[:, opened], ids[opened]
    if len(empty):
        places = max_docs - np.bincount(where[order], minlength=made)
        more = -(-max(0, len(empty) - int(places.sum())) // max_docs)
        where[empty] = np.repeat(np.arange(made + more), np.r_[places, np.full(more, max_docs)].astype(int))[: len(empty)]
    return where


def pack_sizes(items: DataFrame, capacities: dict[str, int], key: str = "doc_id", max_docs: int = MAX_DOCS, attention: float = ATTENTION, rule: str = "norm") -> DataFrame:
    """`pack_name, bin_id, key, piece_no, n_tokens` from `key, n_tokens`."""
    items = items.select(F.col(key).cast("long").alias("id"), F.col("n_tokens").cast("long").alias("n"))
    rows = items.count()
    if not rows or not capacities:
        return items.selectExpr("string(null) pack_name", "0L bin_id", f"id {key}", "0 piece_no", "n n_tokens").where("false")
    packs = F.create_map(*[F.lit(x) for name, size in sorted(capacities.items()) for x in (name, int(size))])
    groups = -(-rows // GROUP_ITEMS)
    first = items.withColumn("grp", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("long"))
    first = first.select("*", F.explode(F.array(*[F.lit(n) for n in sorted(capacities)])).alias("pack"))

    def packed(pdf: pd.DataFrame, base: int) -> pd.DataFrame:
        capacity = capacities[pdf["pack"].iloc[0]]
        pdf = pdf.sort_values(["n", "id", "piece"], ascending=[False, True, True], kind="stable")
        where = best_fit(pdf["n"].to_numpy(), capacity, max_docs, attention, rule)
        fill = np.bincount(where, weights=pdf["n"].to_numpy()) / capacity
        return pdf.assign(bin=base * IDS + where, full=fill[where] >= REOPEN)

    def level_one(pdf: pd.DataFrame) -> pd.DataFrame:
        capacity = capacities[pdf["pack"].iloc[0]]
        whole = (pdf["n"] // capacity).where(pdf["n"] > capacity, 0)
        rest = pdf["n"] - whole * capacity
        pdf = pdf.assign(piece=whole, n=rest)
        big = pdf[whole > 0]
        pieces = big.loc[big.index.repeat(big["piece"])].copy()
        pieces["piece"] = pieces.groupby(level=0).cumcount()
        pieces["n"] = capacity
        pdf = pdf[(pdf["n"] > 0) | (pdf["piece"] == 0)]
        base = int(pdf["grp"].iloc[0]) if len(pdf) else int(pieces["grp"].iloc[0])
        out = packed(pdf, base) if len(pdf) else pdf.assign(bin=0, full=True)
        if len(pieces):
            pieces = pieces.assign(bin=base * IDS + IDS // 2 + np.arange(len(pieces)), full=True)
            out = pd.concat([out, pieces])
        return out[["pack", "grp", "id", "piece", "n", "bin", "full"]]

    schema = "pack string, grp long, id long, piece long, n long, bin long, full boolean"
    one = cut(first.groupBy("pack", "grp").applyInPandas(level_one, schema))
    again = one.where("not full")
    left = again.groupBy("pack").count().agg(F.max("count")).first()[0] or 0
    wide = max(1, -(-left // GROUP_ITEMS))
    # Whole containers of neighbouring groups come together.
    again = again.withColumn("grp", F.pmod(F.xxhash64("bin"), F.lit(wide)) + groups)

    def level_two(pdf: pd.DataFrame) -> pd.DataFrame:
        return packed(pdf, int(pdf["grp"].iloc[0]))[["pack", "grp", "id", "piece", "n", "bin", "full"]]

    two = again.groupBy("pack", "grp").applyInPandas(level_two, schema)
    done = one.where("full").unionByName(two)
    return done.select(F.col("pack").alias("pack_name"), F.col("bin").alias("bin_id"), F.col("id").alias(key), F.col("piece").cast("int").alias("piece_no"), F.col("n").alias("n_tokens"))


def pack_texts(df: DataFrame, capacities: DataFrame, key: str = "doc_id", text: str = "text", tokenizers: str = TOKENIZERS, ranks: str = RANKS, **limits) -> DataFrame:
    """Containers for each row (pack_name, capacity_tokens) of `capacities`, a
    short list of settings."""
    sizes = {r.pack_name: r.capacity_tokens for r in capacities.collect()}
    return pack_sizes(cut(count_tokens(df, key, text, tokenizers, ranks)), sizes, key, **limits)
