"""Problem 6: dialogues of evaluation splits that occur in training too.

Exact prefix-filter join. Dialogues are reduced to one text each, equal texts to
one row. At most EDITS * n of n characters are edited, which changes at most
Q * EDITS * n of a text's Q-shingles; so of any subset with more shingles than
that, at most so many are absent from the other text. Of each evaluation text
the prefix of rarest shingles is indexed as a bit row; training texts probe the
rows within the length filter, first coarse, then fine bits, survivors are
checked shingle by shingle with the place filter and verified by the edit
distance. Nothing is left out: hashed bits and frequencies only decide how many
pairs are verified in vain.

Texts meet by an equi-join on bands of length, in tiles of bounded size (parts of
the evaluation texts x parts of the training texts of a band), so neither a hot
length nor a large band makes a large task. What comes out first is links between
different texts, with the rows of each text as their members; pairs of rows are
spelled out from them only where they are asked for, and reports count without.

Defined cases: null turns count as empty; records whose dialogue is empty are
the same as each other only; an empty table gives no pairs; splits and roles are
compared without case and outer blanks; a null or blank split is a split of its
own, told apart from train, and reported as null; sources may be null."""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from dialoom.llm.copies import DROPPED
from dialoom.llm.forms import Fold
from dialoom.session import cut

#: Shingle length, and the share of the longer text that may be edited.
Q, EDITS = 2, 0.2
#: The prefix is larger than the shingles that may be lost by this share of the length.
SPARE = 0.5
#: Evaluation texts in one index, and training texts that probe it, about; buckets
#: of the frequency sketch (a power of two).
BLOCK, TASK_TEXTS, SKETCH = 2048, 8192, 1 << 16
#: Ratio of lengths that a band spans: a little more than partners can differ by, so
#: that they are in one band or in neighbours.
SPAN = 1.01 / (1 - EDITS)
#: Bits of a fine and a coarse row.
FINE, COARSE = 4096, 1024


def clean_label(column: str) -> Column:
    return F.lower(F.regexp_replace(F.col(column), r"(?U)^\s+|\s+$", ""))


def dialogue_text(df: DataFrame, key: str = "msg_id", messages: str = "messages", split: str = "split", source: str = "source") -> DataFrame:
    """`key, part, split, source, digest, text`: each record's dialogue in comparison
    form; part is "train" or "eval"."""
    turns = F.filter(F.coalesce(messages, F.array().cast(df.schema[messages].dataType)), lambda m: F.coalesce(F.lower(F.regexp_replace(m["role"], r"(?U)^\s+|\s+$", "")), F.lit("")) != "system")
    joined = F.concat_ws("", F.transform(turns, lambda m: F.coalesce(m["content"], F.lit(""))))
    label = F.when(clean_label(split) != "", clean_label(split))
    origin = F.col(source) if source in df.columns else F.lit(None).cast("string")
    plain = df.select(F.col(key).alias("id"), F.when(label == "train", "train").otherwise("eval").alias("part"), label.alias("split"), origin.alias("source"), joined.alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Which texts are equal depends on shapes alone; no scores are needed.
        fold = Fold()
        for pdf in batches:
            texts = [fold(t).casefold().translate(DROPPED) for t in pdf["text"]]
            yield pdf.assign(text=texts, digest=[blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest() for t in texts])

    return plain.mapInPandas(run, "id long, part string, split string, source string, text string, digest binary").withColumnRenamed("id", key)


def shingles(text: str) -> np.ndarray:
    """A 32-bit hash of each q-shingle, in order."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(codes) < Q:
        return np.array([], np.uint32)
    out = np.zeros(len(codes) - Q + 1, np.uint64)
    for i in range(Q):
        out = (out ^ codes[i : i + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return (out >> np.uint64(32)).astype(np.uint32)


def shingle_counts(texts: DataFrame) -> np.ndarray:
    """Sketch of shingle frequencies over all texts; SKETCH numbers, whatever the size."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(SKETCH, np.int64)
        for pdf in batches:
            for t in pdf["text"]:
                total[np.unique(shingles(t) % SKETCH)] += 1
        at = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": at, "n": total[at]})

    out = np.zeros(SKETCH, np.int64)
    for row in texts.select("text").mapInPandas(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row.bucket] = row.n
    return out


def allowed(n: int, m: int) -> int:
    """Edits that two texts of these lengths may be apart."""
    return int(EDITS * max(n, m) + 1e-9)


def edit_distance(a: str, b: str, most: int) -> int:
    """Edit distance, or most + 1 if it is larger (bit-parallel over `a`)."""
    if not a or not b:
        return min(max(len(a), len(b)), most + 1)
    places: dict[str, int] = {}
    for i, ch in enumerate(a):
        places[ch] = places.get(ch, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, score, left = full, 0, len(a), len(b)
    for ch in b:
        left -= 1
        match = places.get(ch, 0) | down
        diag = (((match & up) + up) ^ up) | match
        plus, minus = down | (full & ~(diag | up)), up & diag
        score += 1 if plus & top else -1 if minus & top else 0
        if score - left > most:
            return most + 1
        plus, minus = (plus << 1 | 1) & full, minus << 1 & full
        up, down = minus | (full & ~(diag | plus)), plus & diag
    return score


def bit_row(grams: np.ndarray) -> np.ndarray:
    """FINE bits of a set of shingles as 64-bit words."""
    bits = np.zeros(FINE, bool)
    bits[grams % FINE] = True
    return np.packbits(bits, bitorder="little").view(np.uint64)


def coarse(rows: np.ndarray) -> np.ndarray:
    """COARSE bits from fine ones."""
    return np.bitwise_or.reduce(rows.reshape(*rows.shape[:-1], FINE // COARSE, COARSE // 64), axis=-2)


class Index:
    """Prefixes of a block of evaluation texts, in the order of their lengths."""

    def __init__(self, texts: list[str], counts: np.ndarray):
        self.order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
        self.texts = [texts[i] for i in self.order]
        self.sizes = np.array([len(t) for t in self.texts])
        # A longer partner has inserted characters, which cost a shingle less.
        self.lost = np.floor(Q * EDITS * self.sizes + 1e-9).astype(np.int64)
        self.prefix = []
        fine = np.zeros((len(texts), FINE // 64), np.uint64)
        for i, t in enumerate(self.texts):
            grams = shingles(t)
            want = int(self.lost[i]) + max(1, int(SPARE * len(t)))
            pick = np.argsort(counts[grams % SKETCH], kind="stable")[:want]
            self.prefix.append((pick, grams[pick]))
            fine[i] = bit_row(grams[pick])
        self.fine, self.coarse = fine, coarse(fine)

    def probe(self, text: str) -> list[tuple[int, int]]:
        """(number, distance) of the evaluation texts within reach of `text`."""
        n = len(text)
        lo = np.searchsorted(self.sizes, n * (1 - EDITS) - 1e-6)
        hi = np.searchsorted(self.sizes, n / (1 - EDITS) + 1e-6, side="right")
        if lo >= hi:
            return []
        grams = shingles(text)
        row = bit_row(grams)
        lost = self.lost[lo:hi]
        some = np.flatnonzero(np.bitwise_count(self.coarse[lo:hi] & ~coarse(row)).sum(axis=1, dtype=np.int64) <= lost)
        if len(some):
            some = some[np.bitwise_count(self.fine[lo:hi][some] & ~row).sum(axis=1, dtype=np.int64) <= lost[some]]
        out = []
        if len(some):
            order = np.argsort(grams, kind="stable")
            sorted_grams = grams[order]
            for i in some + lo:
                most = allowed(n, int(self.sizes[i]))
                places, mine = self.prefix[i]
                # The nearest place of an equal shingle must be within the edits.
                left, right = np.searchsorted(sorted_grams, mine), np.searchsorted(sorted_grams, mine, side="right")
                there = right > left
                once = there & (right - left == 1)
                away = np.abs(order[left[once]] - places[once]) > most
                if (~there).sum() + away.sum() > self.lost[i]:
                    continue
                far = edit_distance(self.texts[i], text, most)
                if far <= most:
                    out.append((self.order[i], far))
        return out


def near_texts(texts: DataFrame) -> DataFrame:
    """`digest_a` (evaluation), `digest_b` (training), `distance` for different
    texts within reach, from distinct `digest, part, text`."""
    train, held = (texts.where((F.col("part") == part) & (F.col("text") != "")) for part in ("train", "eval"))
    counts = texts.sparkSession.sparkContext.broadcast(shingle_counts(train))
    band = F.floor(F.log(F.length("text")) / math.log(SPAN)).cast("int")
    held = held.select("digest", "text", F.explode(F.array(band - 1, band, band + 1)).alias("band"))
    # Names of its own: both sides come from one table, and a cogroup tells columns by their origin.
    train = train.select(F.col("digest").alias("name"), F.col("text").alias("body"), band.alias("band"))
    # One row per band: as many as the logarithm of the longest text.
    sizes = held.groupBy("band").agg(F.count("*").alias("e")).join(train.groupBy("band").agg(F.count("*").alias("t")), "band").collect()
    if not sizes:
        return texts.selectExpr("digest digest_a", "digest digest_b", "0 distance").where("false")
    parts = lambda name, size: F.create_map(*[F.lit(x) for r in sizes for x in (r["band"], -(-r[name] // size))])[F.col("band")]
    e_parts, t_parts = parts("e", BLOCK), parts("t", TASK_TEXTS)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    held = held.where(e_parts.isNotNull()).select("*", F.pmod(F.xxhash64("digest"), e_parts).alias("e"), every(t_parts).alias("t"))
    train = train.where(e_parts.isNotNull()).select("*", F.pmod(F.xxhash64("name"), t_parts).alias("t"), every(e_parts).alias("e"))

    def join(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        a, b, d = [], [], []
        if len(left) and len(right):
            texts_, names = list(left["text"]), list(left["digest"])
            index = Index(texts_, counts.value)
            for name, text in zip(right["name"], right["body"]):
                for i, far in index.probe(text):
                    if names[i] != name:
                        a.append(names[i])
                        b.append(name)
                        d.append(far)
        return pd.DataFrame({"digest_a": a, "digest_b": b, "distance": d})

    grouped = held.groupBy("band", "e", "t").cogroup(train.groupBy("band", "e", "t"))
    return grouped.applyInPandas(join, "digest_a binary, digest_b binary, distance int")


def overlap_links(df: DataFrame, key: str = "msg_id", **columns: str) -> tuple[DataFrame, DataFrame]:
    """Records (`key, part, split, source, digest`) and links between their texts
    (`digest_a` of evaluation, `digest_b` of training, `distance`; equal texts are
    linked by 0): what overlaps, without a row for each pair of copies."""
    records = cut(dialogue_text(df, key, **columns))
    texts = cut(records.groupBy("digest", "part").agg(F.first("text").alias("text")))
    both = texts.groupBy("digest").agg(F.count("*").alias("parts")).where("parts = 2")
    same = both.select(F.col("digest").alias("digest_a"), F.col("digest").alias("digest_b"), F.lit(0).alias("distance"))
    return records.drop("text"), cut(same.unionByName(near_texts(texts)))


def split_overlaps(df: DataFrame, key: str = "msg_id", **columns: str) -> DataFrame:
    """`{key}_a < {key}_b, eval_id, train_id, distance`: every pair of a training
    record and one of another split with the same or nearly the same dialogue."""
    records, links = overlap_links(df, key, **columns)
    a = records.where("part = 'eval'").select(F.col("digest").alias("digest_a"), F.col(key).alias("eval_id"))
    b = records.where("part = 'train'").select(F.col("digest").alias("digest_b"), F.col(key).alias("train_id"))
    out = links.join(a, "digest_a").join(b, "digest_b")
    return out.select(F.least("eval_id", "train_id").alias(f"{key}_a"), F.greatest("eval_id", "train_id").alias(f"{key}_b"), "eval_id", "train_id", "distance")


def overlap_report(df: DataFrame, key: str = "msg_id", **columns: str) -> DataFrame:
    """Pairs, records and exact pairs per evaluation split and source, counted from
    the links and the numbers of rows of their texts."""
    records, links = overlap_links(df, key, **columns)
    held = records.where("part = 'eval'").groupBy(F.col("digest").alias("digest_a"), "split", "source").agg(F.count("*").alias("rows_a"))
    train = records.where("part = 'train'").groupBy(F.col("digest").alias("digest_b")).agg(F.count("*").alias("rows_b"))
    joined = cut(links.join(held, "digest_a").join(train, "digest_b"))
    total = joined.groupBy("split", "source").agg(F.sum(F.col("rows_a") * F.col("rows_b")).alias("pairs"), F.coalesce(F.sum(F.when(F.col("distance") == 0, F.col("rows_a") * F.col("rows_b"))), F.lit(0)).alias("exact_pairs"))
    once = lambda digest, rows, name: joined.select("split", "source", digest, rows).distinct().groupBy(F.col("split").alias("_s"), F.col("source").alias("_o")).agg(F.sum(rows).alias(name))
    for part in (once("digest_a", "rows_a", "eval_records"), once("digest_b", "rows_b", "train_records")):
        total = total.join(part, F.col("split").eqNullSafe(F.col("_s")) & F.col("source").eqNullSafe(F.col("_o"))).drop("_s", "_o")
    return total.select("split", "source", "pairs", "eval_records", "train_records", "exact_pairs")
