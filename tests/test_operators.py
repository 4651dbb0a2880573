"""Operators against sequential versions and small expected rows."""

import random

from pyspark.sql import functions as F

from dialoom.operators import grouping, joins, quota, repair, reports, splits


def sequential(rows, caps, stop=None):
    used, out, taken = [{} for _ in caps], {}, 0
    for rank, *keys in rows:
        if stop is not None and taken >= stop:
            break
        full = next((i for i, (k, c) in enumerate(zip(keys, caps)) if c is not None and used[i].get(k, 0) >= c), -1)
        if full < 0:
            taken += 1
            for u, k in zip(used, keys):
                u[k] = u.get(k, 0) + 1
        out[rank] = full
    return out


def test_quota_is_sequential(spark, monkeypatch):
    for seed in range(3):
        rnd = random.Random(seed)
        rows = [(i, rnd.choice("abc"), rnd.choice("wxyz"), str(rnd.randint(0, 20))) for i in range(1, 120)]
        df = spark.createDataFrame(rows, "rank long, k0 string, k1 string, k2 string").withColumns({"c0": F.lit(30.0), "c1": F.lit(12.0), "c2": F.lit(2.0)})
        keys, caps = ["k0", "k1", "k2"], ["c0", "c1", "c2"]
        # Walks of any length give the same decisions.
        for walk, stop in ((200, 200), (7, 200), (25, 9)):
            monkeypatch.setattr(quota, "WALK_ROWS", walk)
            done = quota.accepted(df, keys, caps, stop)
            got = {r.rank: r.drop_key for r in quota.decide(df, keys, caps, done, stop).collect()}
            assert got == sequential(rows, (30, 12, 2), stop)


def test_missing_category_is_other(spark):
    rows = [(i, float(-i), c, f"t{i}", f"q{i}", f"p{i}") for i, c in enumerate([None, " ", "other", "x", None])]
    df = spark.createDataFrame(rows, "id int, score double, category string, template string, asked_key string, pair_key string")
    got = {r.id: r.pass_no for r in quota.diverse_topk(df, [F.desc("score")], 4, {"other": 2}).collect()}
    assert got == {0: 1, 1: 1, 3: 1, 2: 2}
    counters = {r.reason: r.n for r in quota.topk_counters(df, [F.desc("score")], 4, {"other": 2}).collect()}
    assert counters == {"drop_category": 2, "selected_pass_1": 3, "selected_pass_2": 1}


def test_fill_takes_a_pair_once(spark):
    rows = [(i, float(-i), k, "q", "c") for i, k in enumerate("aabbc")]
    df = spark.createDataFrame(rows, "id int, score double, t string, q string, category string")
    got = {r.id: r.pass_no for r in quota.diverse_repaired(df, [F.desc("score")], 5, {}, "t", "q", same=("t",)).collect()}
    assert got == {0: 1, 1: 1, 2: 2, 4: 2}  # two of a question; of b and c one each


def test_two_passes(spark):
    rows = [(i, float(100 - i), "c", f"t{i % 3}", f"q{i}", f"p{i}") for i in range(12)]
    df = spark.createDataFrame(rows, "id int, score double, category string, template string, asked_key string, pair_key string")
    got = {r.id: r.pass_no for r in quota.diverse_topk(df, [F.desc("score")], 8, {"c": 4}, 2, 2, 1).collect()}
    # Pass 1: the category's 4 places; pass 2: templates up to 3, whatever the category.
    assert {i for i, p in got.items() if p == 1} == {0, 1, 2, 3} and len(got) == 8 and {i for i, p in got.items() if p == 2} == {4, 5, 6, 7}
    assert quota.category_caps(50, strict=True, sft=True)["product_info"] == 13


def test_ranked_is_a_permutation(spark):
    df = spark.range(1000).withColumn("v", F.col("id") % 7)
    got = quota.ranked(df, [F.desc("v"), F.asc("id")]).orderBy("rank").collect()
    assert [r.rank for r in got] == list(range(1, 1001))
    assert [(r.v, r.id) for r in got] == sorted(((r.v, r.id) for r in got), key=lambda x: (-x[0], x[1]))


def test_best_pair_has_no_fallback(spark):
    ctx = ["退款多久到账呢？"]
    good, blocked = "退款一般三天内到账，已经帮您登记退款了", "退款一般三天内到账，这款也有货，您也可以选，券可以领，退款登记了"
    rows = [(1, 1, ctx, good), (2, 0, ctx, "这个问题不清楚，您看着办吧"), (3, 1, ["发货？"], blocked), (4, 0, ["发货？"], "不知道什么时候发货的呀")]
    cands = grouping.candidates(spark.createDataFrame(rows, "line_no long, label int, context array<string>, response string"))
    pairs = grouping.best_pairs(cands).collect()
    assert [p.pos_line_no for p in pairs] == [1] and pairs[0].neg_line_no == 2
    stats = grouping.group_stats(cands, grouping.best_pairs(cands)).first()
    assert stats.context_groups == 2 and stats.kept + stats.rejected + stats.no_positive + stats.no_negative == 2


def test_runs_and_last_write(spark):
    rows = [(i + 1, 1 - i % 2, k, f"r{i}") for i, k in enumerate("AABBA")]
    df = spark.createDataFrame(rows, "line_no long, label int, k string, response string")
    runs = grouping.run_groups(df, F.col("k")).orderBy("first_line").collect()
    assert [(r.run_key, r.rows) for r in runs] == [("A", 2), ("B", 2), ("A", 1)]
    pairs = grouping.last_write_pairs(df, ["k"]).collect()
    assert {(p.k, p.chosen, p.rejected) for p in pairs} == {("A", "r4", "r1"), ("B", "r2", "r3")}


def test_runs_over_partitions(spark):
    rnd = random.Random(5)
    rows = [(i, rnd.choice([1, 2, None]), rnd.choice("AAB")) for i in range(300)]
    df = spark.createDataFrame(rows, "line_no long, g int, k string").repartition(5)
    for within in (None, ["g"]):
        want, state = {}, {}
        for i, g, k in rows:
            key = g if within else 0
            n, last = state.get(key, (0, object()))
            state[key] = (n + (k != last), k)
            want[i] = state[key][0]
        assert {r.line_no: r.run_id for r in grouping.run_ids(df, F.col("k"), "line_no", within).collect()} == want


def test_trimmed_texts_go_on(spark):
    ctx = ["退款多久到账呢？"]
    rows = [(1, 1, ctx, "退款一般三天内到账，已经帮您登记退款了，请核对一下收货地址"), (2, 0, [" ", *ctx], "这个问题不清楚，您看着办吧，请核对一下收货地址")]
    pairs = grouping.best_pairs(grouping.candidates(spark.createDataFrame(rows, "line_no long, label int, context array<string>, response string"))).collect()
    assert pairs[0].chosen == "退款一般三天内到账，已经帮您登记退款了" and pairs[0].rejected == "这个问题不清楚，您看着办吧" and pairs[0].first_line == 1


def test_splits_and_noise(spark):
    df = spark.range(103).withColumns({"category": F.when(F.col("id") % 4 == 0, "a").otherwise("b"), "score": F.col("id").cast("double"), "chosen": F.lit("c"), "rejected": F.lit("r")})
    split = splits.pattern_split(df, "category", [F.desc("score"), F.asc("id")])
    sizes = {"train": 61, "dev": 21, "test": 21}
    balanced = splits.balance_splits(split, sizes, [F.desc("score"), F.asc("id")])
    assert {r.split: r["count"] for r in balanced.groupBy("split").count().collect()} == sizes
    noisy = splits.add_noise(df, "id", 0.1, 5)
    assert noisy.where("noise_swapped").count() == 10 and noisy.where("noise_swapped and chosen = 'r'").count() == 10
    assert sorted(r.source_index for r in noisy.select("source_index").collect()) == list(range(103))
    assert splits.holdout(df, "id", 0.001).where("is_validation").count() == 1
    again = [r.id for r in splits.sample_indices(df.repartition(7), "id", 9, 1).orderBy("sample_rank").collect()]
    assert again == [r.id for r in splits.sample_indices(df, "id", 9, 1).orderBy("sample_rank").collect()]


def test_index_shapes(spark):
    texts = ['[1, 2]', '{"indices": [3]}', '[{"source_index": 4}]', '[{"index": 5}]', '{"results": [{"source_index": 6}]}', '{"samples": [{"source_index": 7}]}', '{"source_indices": [8]}']
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(splits.read_indices("t")).collect()]
    assert got == [[1, 2], [3], [4], [5], [6], [7], [8]]


def test_replace_prefers_later_rows(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 5.0), (3, 1.0)], "id long, risk double")
    made = spark.createDataFrame([(-1,)], "id long")
    assert sorted(r.id for r in splits.replace_riskiest(df, "id", F.col("risk"), made).collect()) == [-1, 1, 3]


def test_repair(spark):
    rows = [(["退款多久到账呢？"], "退款三天内到账，加我微信聊，退款已经登记了", "好")]
    got = repair.repair_pairs(spark.createDataFrame(rows, "context array<string>, chosen string, rejected string")).first()
    assert "微信" not in got.repaired_chosen and got.repaired_rejected and "rewritten_negative" in got.repair_issues
    clauses = spark.createDataFrame([("a，b。a，c",)], "t string").select(repair.split_clauses("t")).first()[0]
    assert clauses == ["a", "b", "c"]


def test_cascade_and_baseline(spark):
    a = spark.createDataFrame([(1, "x", "p"), (2, "x", "q"), (3, "z", "q")], "i int, h string, r string")
    b = spark.createDataFrame([(10, "x", "p"), (11, "z", "w")], "j int, h string, r string")
    got = {(r.i, r.j, r.level) for r in joins.cascade(a, b, [["h", "r"], ["h"]], "i", "j").collect()}
    assert got == {(1, 10, 0), (3, 11, 1)}
    assert joins.cascade(a, b, [["h", "r"], ["h"]], "i", "j", complete=True).count() == 0
    # Row 1 has no partner at the first level and takes the one that row 2 would match best.
    c = spark.createDataFrame([(10, "x", "q")], "j int, h string, r string")
    assert {(r.i, r.j, r.level) for r in joins.cascade(a, c, [["h", "r"], ["h"]], "i", "j").collect()} == {(1, 10, 1)}
    one = spark.createDataFrame([("s", 6.0), ("l", 8.0), ("z", 1.0)], "run string, m double")
    assert {r.run: r.saving for r in joins.saving(one, "run", "s", "l", "m").collect()} == {"s": 25.0, "l": 0.0, "z": None}
    runs = spark.createDataFrame([("base", 0.0, 2.0), ("x", 1.0, 3.0), ("y", None, 1.0)], "run string, a double, b double")
    out = {r.run: (r.a_delta, r.b_delta) for r in joins.against_baseline(runs, "run", "base", ["a", "b"]).collect()}
    assert out == {"base": (0.0, 0.0), "x": (1.0, 1.0), "y": (None, -1.0)}


def test_reports(spark):
    df = spark.createDataFrame([("3.0790000",), ("x",), (None,), ("12345678",)], "t string")
    assert [r[0] for r in df.select(reports.short_number("t")).collect()] == ["3.079", "", "", "1.23457e+07"]
    log = spark.createDataFrame([(0, 1, 0.1, 4.0, None, 1.0), (1, 2, 0.2, 2.0, None, 1.0), (2, 2, 0.2, None, 3.0, None), (3, 2, 0.2, 1.0, None, 1.0)], "idx int, step int, epoch double, loss double, eval_loss double, learning_rate double")
    assert [(r.step, r.loss, r.smoothed, r.eval_loss) for r in reports.loss_series(log, 2).orderBy("step").collect()] == [(1, 4.0, 4.0, None), (2, 1.0, 2.5, 3.0)]
    meta = spark.createDataFrame([("r",)], "run string")
    out = reports.run_rows(meta, spark.createDataFrame([("r", "0.0")], "run string, m string"), spark.createDataFrame([("r", "9")], "run string, m string"), "run", ["m"]).first()
    assert out.m == 0.0
    pref = spark.createDataFrame([(1.0, 0.0, 2, 2), (0.0, 0.0, 1, 1), (float("nan"), 1.0, 1, 1), (None, 1.0, 1, 1)], "chosen_logprob double, rejected_logprob double, chosen_tokens int, rejected_tokens int")
    row = reports.preference_summary(reports.preference_rows(pref).withColumn("g", F.lit(1)), ["g"]).first()
    assert (row["rows"], row.valid, row.accuracy, row.tie_rate) == (4, 2, 0.5, 0.5)


def test_scenarios_keep_all_wrappers(spark):
    dialogues = spark.createDataFrame([("a",), ("b",)], "dialogue string")
    wrappers = spark.range(1200).withColumnRenamed("id", "wrapper")
    assert splits.scenarios(dialogues, wrappers).distinct().count() == 2400
    assert splits.scenarios(dialogues, wrappers.where("false")).count() == 0
