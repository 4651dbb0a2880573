"""Problems 3 and 6 against brute force."""

import random

import numpy as np
from pyspark.sql import functions as F

from dialoom.llm import balance, splits

SHARES = [("t", "a", 0.5, 2, 0.2), ("t", "big_one", 0.48, 2, 0.2), ("t", "rare", 0.02, 8, 0.2), ("t", "none", 0.0, 1, 0.2), ("other", "a", 1.0, 1, 0.1)]


def shares(spark):
    return spark.createDataFrame(SHARES, "population string, category string, target_share double, min_rows long, sample_rate double")


def test_flight_keeps_sums():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 7, 500):
        keys, groups = np.arange(n), rng.integers(0, 3, n)
        rates = np.array([0.13, 0.5, 0.9])
        p = balance.flight(keys, groups, rates[groups], 3)
        for g in range(3):
            assert abs(p[groups == g].sum() - rates[g] * (groups == g).sum()) < 1e-6
            assert ((p > 0) & (p < 1) & (groups == g)).sum() <= 1
    # Every row has its chance.
    hits = sum(balance.flight(np.arange(20), np.zeros(20, int), np.full(20, 0.25), s) == 1 for s in range(400))
    assert hits.sum() == 2000 and hits.min() > 50 and hits.max() < 160


def test_sample(spark):
    names = ["A ", "a", "Big-One", "big one", "BIG_ONE", None, " ", "rare"]
    rows = [(i, names[i % 7] if i % 50 else "rare", "k") for i in range(1, 1000)]
    df = spark.createDataFrame(rows, "id long, category string, available string").repartition(37)
    got = balance.balanced_sample(df, shares(spark), "t", "id")
    report = {r.category: r for r in got.report.collect()}
    available = {k: sum(balance_key(c) == k for _, c, _ in rows) for k in report}
    size = int(0.2 * len(rows) + 0.5)
    for k, r in report.items():
        goal = next(s for s in SHARES if s[0] == "t" and s[1] == k)
        assert r.available == available[k] and r.sample_size == size and abs(r.needed - max(goal[3], goal[2] * size)) < 1e-9
        assert r.drawn == r.wanted == min(available[k], max(goal[3], round(goal[2] * size))) and r.met == (available[k] + 1e-9 >= r.needed)
    assert got.sample.count() == sum(r.drawn for r in report.values()) and "available" in got.sample.columns
    empty = balance.balanced_sample(df.where("false"), shares(spark), "t", "id")
    assert empty.sample.count() == 0 and empty.report.where("met").count() == 0


def balance_key(c):
    return None if c is None or not c.strip() else c.strip().lower().replace("-", "_").replace(" ", "_")


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_edit_distance():
    rnd = random.Random(2)
    for _ in range(200):
        a, b = ("".join(rnd.choice("ab中") for _ in range(rnd.randint(0, 15))) for _ in range(2))
        most = rnd.randint(0, 15)
        assert splits.edit_distance(a, b, most) == min(distance(a, b), most + 1)


def test_overlaps_equal_brute_force(spark):
    rnd = random.Random(7)
    base = ["".join(rnd.choice("的是在有货发快递退款可以好吗您亲三四五") for _ in range(rnd.randint(1, 60))) for _ in range(25)]

    def edited(t, k):
        t = list(t)
        for _ in range(k):
            i, kind = rnd.randrange(len(t) + 1), rnd.random()
            t[i : i + (kind > 0.3)] = [rnd.choice("甲乙丙")] if kind < 0.7 else []
        return "".join(t)

    texts = [(b, "train") for b in base] + [(edited(b, rnd.randint(0, max(1, len(b) // 4))), rnd.choice(["dev ", "TEST"])) for b in base for _ in range(2)] + [("", "train"), ("", "test"), ("好的，好", " Train"), ("好 的好！", "generic_test"), (base[0] + "，", None), (base[0], " ")]
    rows = [(i, s, None if i % 3 else "src", [("system", "s" * i), ("user", t[: len(t) // 2]), (" Assistant", t[len(t) // 2 :] if t else None)]) for i, (t, s) in enumerate(texts)]
    df = spark.createDataFrame(rows, "msg_id long, split string, source string, messages array<struct<role:string,content:string>>")
    plain = [t.replace("，", "").replace(" ", "").replace("！", "") for t, _ in texts]
    train = [i for i, (_, s) in enumerate(texts) if (s or "").strip().lower() == "train"]
    want = {tuple(sorted((a, b))) for a in range(len(texts)) if a not in train for b in train if distance(plain[a], plain[b]) <= int(0.2 * max(len(plain[a]), len(plain[b])) + 1e-9)}
    pairs = splits.split_overlaps(df).cache()
    assert {(r.msg_id_a, r.msg_id_b) for r in pairs.collect()} == want and len(want) > 20
    report = {(r.split, r.source): (r.pairs, r.eval_records, r.train_records, r.exact_pairs) for r in splits.overlap_report(df).collect()}
    named = pairs.join(df.select(F.col("msg_id").alias("eval_id"), F.when(splits.clean_label("split") != "", splits.clean_label("split")).alias("split"), "source"), "eval_id")
    counted = named.groupBy("split", "source").agg(F.count("*").alias("p"), F.countDistinct("eval_id").alias("e"), F.countDistinct("train_id").alias("t"), F.count_if(F.col("distance") == 0).alias("x"))
    assert report == {(r.split, r.source): (r.p, r.e, r.t, r.x) for r in counted.collect()} and any(k[0] is None for k in report)
    assert splits.split_overlaps(df.where("false")).count() == 0
    assert splits.split_overlaps(df.where("split = ' Train'")).count() == 0
