"""Problem 1: text that looks the same but is written with different characters.

Every text is brought to its visible form (forms.Fold): compatibility mapping,
deletion of ignorable characters, then Viterbi over a lattice of look-alike
letters per token, scored by character bigrams of one script that are counted
over the whole corpus.

Defined cases: a null response or turn counts as empty, a null context as one
without turns; empty tables give empty results; repeated rows stay; further
columns are ignored or, in `normalize_columns`, kept. Texts of any length are
processed whole."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from dialoom.llm.forms import TOKEN, Fold, bigrams_of
from dialoom.session import cut

#: Scores need few digits of precision: a bigram below this count says nothing.
RARE = 2


def _texts(pdf: pd.DataFrame, columns: Iterable[str]) -> Iterator[str]:
    for name in columns:
        for value in pdf[name]:
            if isinstance(value, str):
                yield value
            elif isinstance(value, (list, np.ndarray)):
                yield from (x for x in value if x)


def script_bigrams(df: DataFrame, columns: list[str]) -> dict[tuple[int, str], int]:
    """Bigram counts per script over all rows. The result is bounded by the
    square of the alphabets of three scripts, whatever the number of rows."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter = Counter()
        for pdf in batches:
            tokens = Counter(TOKEN.findall("\n".join(_texts(pdf, columns))))
            for token, n in tokens.items():
                found = bigrams_of(token)
                if found:
                    for gram in found[1]:
                        total[found[0], gram] += n
        if total:
            yield pd.DataFrame({"script": [k[0] for k in total], "gram": [k[1] for k in total], "n": list(total.values())})

    parts = df.select(*columns).mapInPandas(count, "script int, gram string, n long")
    rows = parts.groupBy("script", "gram").agg(F.sum("n").alias("n")).where(F.col("n") >= RARE).collect()
    return {(r.script, r.gram): r.n for r in rows}


def fold_for(df: DataFrame, columns: list[str]) -> dict[tuple[int, str], int]:
    """The scores that `Fold` takes, in a fixed order."""
    return dict(sorted(script_bigrams(df, columns).items()))


def normalize_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """`df` with each named string or array<string> column in visible form. A
    null stays null, in arrays too."""
    spark = df.sparkSession
    counts = spark.sparkContext.broadcast(fold_for(df, columns))
    kinds = dict(df.dtypes)
    names = df.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fold = Fold(counts.value)
        for pdf in batches:
            pdf.columns = names
            for name in columns:
                if kinds[name] == "string":
                    pdf[name] = [None if x is None else fold(x) for x in pdf[name]]
                else:
                    pdf[name] = [None if x is None else [None if t is None else fold(t) for t in x] for x in pdf[name]]
            yield pdf

    return df.mapInPandas(run, df.schema)


def _digest(parts: list[str]) -> bytes:
    """128 bits of a list of texts; lengths are included, so that borders count."""
    h = blake2b(digest_size=16)
    for p in parts:
        b = p.encode("utf-8", "surrogatepass")
        h.update(len(b).to_bytes(4, "little"))
        h.update(b)
    return h.digest()


def visible_keys(df: DataFrame, key: str, context: str = "context", response: str = "response") -> DataFrame:
    """`key, look, raw`: 128-bit digests of the visible form and of the code points."""
    counts = df.sparkSession.sparkContext.broadcast(fold_for(df, [context, response]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fold = Fold(counts.value)
        for pdf in batches:
            looks, raws = [], []
            for ctx, reply in zip(pdf[context], pdf[response]):
                turns = [x or "" for x in ctx] if ctx is not None else []
                turns.append(reply or "")
                shown = [fold(x) for x in turns]
                raw = _digest(turns)
                raws.append(raw)
                looks.append(raw if shown == turns else _digest(shown))
            yield pd.DataFrame({key: pdf[key], "look": looks, "raw": raws})

    return df.select(key, context, response).mapInPandas(run, f"{key} long, look binary, raw binary")


def look_alike_classes(df: DataFrame, key: str = "line_no", context: str = "context", response: str = "response") -> DataFrame:
    """`key, class_{key}, links` of every row that looks like another one written
    differently: the smallest key of its class, and how many rows of the class are
    not equal to it code point for code point. Nothing is spelled out, so a class
    that holds a third of all rows costs no more than its rows."""
    keys = cut(visible_keys(df, key, context, response))
    return _classes(keys, key).select(key, f"class_{key}", "links")


def _classes(keys: DataFrame, key: str) -> DataFrame:
    writings = cut(keys.groupBy("look", "raw").agg(F.count("*").alias("own"), F.min(key).alias("first")))
    classes = writings.groupBy("look").agg(F.sum("own").alias("rows"), F.min("first").alias(f"class_{key}"), F.min("raw").alias("lo"), F.max("raw").alias("hi")).where("lo < hi")
    told = writings.join(classes.select("look", "rows", f"class_{key}"), "look").select("look", "raw", f"class_{key}", (F.col("rows") - F.col("own")).alias("links"))
    return keys.join(told, ["look", "raw"])


def look_alike_pairs(df: DataFrame, key: str = "line_no", context: str = "context", response: str = "response") -> DataFrame:
    """`{key}_a < {key}_b`: every pair of rows that look the same but are not
    equal code point for code point, spelled out from the classes last: only rows
    with links take part, and writings are paired before rows, so a large set of
    exact copies makes no pairs of its own; the only growth is that of the pairs
    asked for."""
    keys = cut(visible_keys(df, key, context, response))
    rows = cut(_classes(keys, key).select(F.col(key).alias("id"), "look", "raw"))
    written = rows.select("look", "raw").distinct()
    pairs = written.withColumnRenamed("raw", "raw_a").join(written.withColumnRenamed("raw", "raw_b"), "look").where("raw_a < raw_b")
    one, two = rows.select("look", F.col("raw").alias("raw_a"), F.col("id").alias("one")), rows.select("look", F.col("raw").alias("raw_b"), F.col("id").alias("two"))
    joined = pairs.join(one, ["look", "raw_a"]).join(two, ["look", "raw_b"])
    return joined.select(F.least("one", "two").alias(f"{key}_a"), F.greatest("one", "two").alias(f"{key}_b"))
