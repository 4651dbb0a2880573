"""Problem 2: records that are the same but for blanks, letter case, punctuation
and the order of the fields of an order card.

Canonical records are range-partitioned and sorted; adjacent rows are then
compared by their full keys. The range also runs over the id, so a set of copies
that holds a third of all rows is spread over many tasks; the sets that cross a
border are put together from at most two runs per partition.

Defined cases: null turns and replies count as empty; a reply without any letter
or figure must agree code point for code point; empty tables give empty results;
columns other than those named take no part."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b
from sys import maxunicode

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from dialoom.llm.forms import Fold
from dialoom.session import cut

#: Deleted before comparing: punctuation, blanks, controls and these signs.
DROPPED = {i: None for i in range(maxunicode + 1) if unicodedata.category(chr(i))[0] in "PZC" and not 0xD800 <= i < 0xE000} | {ord("~"): None, ord("|"): None}

#: A named field: the start of the card or a separator, a short name, ":" or "=".
FIELD = r"(?:^|[\n;；|/\]】，,])\s*([^\s:=：;；|/\[\]【】，,。]{1,8})\s*[:=：]"
#: A card has at least so many different field names.
CARD_FIELDS = 3


def field_names(df: DataFrame, context: str = "context") -> list[str]:
    """Names of card fields, found in the corpus: all that stand in two different
    turns, told apart by their hashes. How often a turn is repeated says nothing,
    and copies of a card with another order are two turns already."""
    turns = df.select(F.explode(context).alias("t")).where(F.col("t").rlike(r"[:=：].*[:=：].*[:=：]") | F.col("t").contains("\n"))
    names = turns.select(F.xxhash64("t").alias("h"), F.expr(f"array_distinct(regexp_extract_all(t, r'{FIELD}', 1))").alias("names")).where(F.size("names") >= CARD_FIELDS + 2)
    each = names.select("h", F.explode("names").alias("name")).groupBy("name").agg(F.min("h").alias("low"), F.max("h").alias("high"))
    return sorted((r.name for r in each.where("low < high").select("name").collect()), key=lambda x: (-len(x), x))


class Canon:
    """The comparison form of a text or record."""

    def __init__(self, fold: Fold, names: list[str]):
        self.fold = fold
        plain = sorted({self.plain(n) for n in names} - {""}, key=lambda x: (-len(x), x))
        self.names = re.compile("|".join(map(re.escape, plain))) if plain else None
        self.turn = lru_cache(50_000)(self._turn)

    def plain(self, text: str) -> str:
        return self.fold(text).casefold().translate(DROPPED)

    def _turn(self, text: str | None) -> str:
        """A turn: a card is its sorted fields, anything else the plain form."""
        if not text:
            return ""
        out = self.plain(text)
        if self.names is None or len(out) < 8:
            return out
        found = [m.span() for m in self.names.finditer(out)]
        if len(found) < CARD_FIELDS or found[0][0] > 6 or len({out[a:b] for a, b in found}) < CARD_FIELDS:
            return out
        ends = [a for a, _ in found[1:]] + [len(out)]
        fields = sorted(out[a:b] + "=" + out[b:e].strip("=") for (a, b), e in zip(found, ends))
        return "\x1d".join([out[: found[0][0]], *fields])

    def record(self, context, response: str | None) -> str:
        turns = [self.turn(t) for t in context] if context is not None else []
        reply = self.plain(response or "")
        if not any(ch.isalnum() for ch in reply):
            reply = "\x1c" + (response or "")
        return "\x1f".join([*turns, "\x1e" + reply])


def canonical_records(df: DataFrame, key: str, context: str, response: str) -> DataFrame:
    """`key, hash, canon`: the comparison form and a hash to spread it evenly."""
    # Which texts get one form depends on shapes alone; scores decide its spelling only.
    send = df.sparkSession.sparkContext.broadcast(field_names(df, context))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        canon = Canon(Fold(), send.value)
        for pdf in batches:
            forms = [canon.record(c, r) for c, r in zip(pdf[context], pdf[response])]
            yield pd.DataFrame({key: pdf[key], "canon": forms})

    out = df.select(key, context, response).mapInPandas(run, f"{key} long, canon string")
    return out.select(key, F.xxhash64("canon").alias("hash"), "canon")


def copy_sets(df: DataFrame, key: str = "line_no", context: str = "context", response: str = "response", partitions: int | None = None) -> DataFrame:
    """`key, first`: every row with the smallest key of its set of copies."""
    records = cut(canonical_records(df, key, context, response))
    parts = partitions or max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = records.repartitionByRange(parts, "hash", "canon", key).sortWithinPartitions("hash", "canon", key)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        last_canon, last_first, runs, held = None, None, 0, None
        for pdf in batches:
            if not len(pdf):
                continue
            canon = pdf["canon"]
            new = (canon != canon.shift()).to_numpy(copy=True)
            new[0] = last_canon is None or canon.iloc[0] != last_canon
            first = pdf[key].where(new)
            if not new[0]:
                first.iloc[0] = last_first
            number = new.cumsum() + runs
            out = pd.DataFrame({key: pdf[key], "first": first.ffill().astype("int64"), "run": number, "part": part, "last": False})
            out["mark"] = None
            # The key of a border run lets the parts of a set find each other.
            ends = number == 1
            if ends.any():
                out.loc[ends, "mark"] = blake2b(canon.iloc[0].encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()
            last_canon, last_first, runs = canon.iloc[-1], int(out["first"].iloc[-1]), int(number[-1])
            if held is not None:
                yield held
            held = out
        if held is not None:
            tail = held["run"] == runs
            held.loc[tail, "last"] = True
            held.loc[tail, "mark"] = blake2b(last_canon.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()
            yield held

    runs = cut(ordered.mapInPandas(scan, f"{key} long, first long, run long, part int, last boolean, mark string"))
    # At most two marks per partition: the first and the last run.
    borders = runs.where("mark is not null").groupBy("mark").agg(F.min("first").alias("whole_first"))
    found = runs.join(F.broadcast(borders), "mark", "left")
    return found.select(key, F.coalesce("whole_first", "first").alias("first"))


def copies(df: DataFrame, key: str = "line_no", **columns: str) -> DataFrame:
    """`first_line_no, copy_line_no`: one row for each copy but the first."""
    return copy_sets(df, key, **columns).where(F.col(key) != F.col("first")).select(F.col("first").alias("first_line_no"), F.col(key).alias("copy_line_no"))


def collapse(df: DataFrame, key: str = "line_no", **columns: str) -> DataFrame:
    """One representative per set, the row with the smallest key, with `n_copies`
    (in place of a column of that name)."""
    counts = copy_sets(df, key, **columns).groupBy("first").agg(F.count("*").alias("n_copies"))
    return df.drop("n_copies").join(counts.withColumnRenamed("first", key), key)
