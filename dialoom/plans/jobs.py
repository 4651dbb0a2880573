"""Whole jobs over files, for spark-submit: python -m dialoom.plans.jobs JOB ..."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from dialoom.functions import chat, clean, predicates as P, scoring
from dialoom.functions.rules import DEFAULT, Pack, load_pack
from dialoom.operators import grouping, quota, repair, reports, splits
from dialoom.session import cut, local_session
from dialoom.sources import readers, writers


def select_pairs(spark: SparkSession, source: str, out: str, top_k: int = 10_000, mode: scoring.Mode = scoring.NORMAL, pack: Pack = DEFAULT) -> DataFrame:
    """Raw lines to ranked pairs: raw pairs, positives, preview and statistics."""
    lines = cut(readers.read_dialogues(spark, source))
    pairs = cut(grouping.best_pairs(cut(grouping.candidates(lines.where("label is not null"), mode, pack)), mode, pack))
    caps = quota.category_caps(top_k, mode.strict, mode.generic, mode.sft)
    picked = cut(quota.diverse_topk(pairs, grouping.pair_order(), top_k, caps))
    writers.write_jsonl(quota.topk_counters(pairs, grouping.pair_order(), top_k, caps), f"{out}/drops")
    writers.write_text(writers.raw_pairs(picked), f"{out}/pairs")
    writers.write_text(writers.raw_pairs(picked, positive_only=True), f"{out}/positives")
    writers.write_jsonl(writers.preview(picked.orderBy("rank")), f"{out}/preview")
    writers.write_jsonl(writers.selection_stats(picked), f"{out}/stats")
    writers.write_jsonl(grouping.label_counts(lines), f"{out}/counters")
    return picked


def repair_job(spark: SparkSession, source: str, out: str, manual: str | None = None, targets: Sequence[int] = (5000, 10_000, 23_000), pack: Pack = DEFAULT) -> dict[int, DataFrame]:
    """Runs of raw lines (and hand-made pairs) repaired, then selected for each
    target. All targets are checked before anything is written, and inputs are
    never overwritten."""
    runs = grouping.run_groups(readers.read_dialogues_strict(spark, source), clean.context_key("context"), "line_no", ["file"])
    groups = runs.where(P.valid_pair("chosen", "rejected")).select(F.split("run_key", "\n").alias("context"), "chosen", "rejected", "file", "first_line", F.lit(0.0).alias("score"), F.lit("train_pool").alias("source"), F.array().cast("array<string>").alias("issues"))
    both = groups.unionByName(readers.read_manual(spark, manual), allowMissingColumns=True)
    repaired = cut(repair.with_keys(repair.repair_pairs(both, pack=pack)))
    have = repaired.count()
    if any(have < n for n in targets):
        raise ValueError(f"{have} repaired pairs are too few for {max(targets)}")
    # Ties keep the order of the input; hand-made pairs, which have no line, by their texts.
    order = repair.order([F.asc_nulls_last("file"), F.asc_nulls_last("first_line"), F.asc(F.md5(F.concat_ws("\n", F.array_join("context", "\n"), "repaired_chosen", "repaired_rejected")))])
    counts = cut(groups.agg(F.count("*").alias("groups")).join(F.broadcast(both.agg(F.count("*").alias("with_manual"))))).withColumn("repaired", F.lit(have)).withColumn("dropped", F.col("with_manual") - have)
    done = {}
    for n in targets:
        picked = cut(quota.diverse_repaired(repaired, order, n, {k: int(n * s) for k, s in quota.REPAIR_SHARES.items()}, "template", "asked_key", "repair_category", same=repair.SAME))
        rows = picked.select("rank", "context", F.col("repaired_chosen").alias("chosen"), F.col("repaired_rejected").alias("rejected"), F.col("repair_score").alias("score"), F.col("repair_category").alias("category"), "source", F.col("repair_issues").alias("issues"))
        writers.write_text(writers.raw_pairs(rows), f"{out}/{n}/pairs")
        writers.write_jsonl(writers.preview(rows.orderBy("rank")), f"{out}/{n}/preview")
        writers.write_jsonl(writers.preference_alpaca(rows, chat.prompt_lines("context"), chat.TASK), f"{out}/{n}/preferences")
        writers.write_jsonl(repair.distributions(rows), f"{out}/{n}/report")
        writers.write_jsonl(counts, f"{out}/{n}/counts")
        done[n] = rows
    return done


def convert_job(spark: SparkSession, source: str, out: str, least_turns: int = 2) -> DataFrame:
    """Raw lines to instruction rows and messages; dropped rows by reason."""
    rows = readers.read_dialogues_loose(spark, source).where("label = 1").withColumn("reason", P.keep_reason("context", "response", least_turns))
    rows = cut(rows)
    kept = rows.where("reason = 'ok'").select("line_no", chat.alpaca(F.lit(chat.TASK), chat.task_prompt("context"), F.col("response")).alias("r")).select("line_no", "r.*")
    writers.write_jsonl(kept, f"{out}/alpaca", [F.asc("line_no")])
    writers.write_jsonl(kept.select("line_no", chat.alpaca_to_messages("instruction", "input", "output").alias("messages")).where("messages is not null").drop("line_no"), f"{out}/messages")
    writers.write_jsonl(rows.groupBy("reason").count(), f"{out}/reasons")
    return kept


def split_job(spark: SparkSession, source: str, out: str) -> DataFrame:
    """A preview to stratified splits of instruction and preference rows."""
    ranked = readers.read_ranked(spark, source, readers.PREVIEW)
    rows = cut(splits.pattern_split(ranked, "category", [F.desc("score"), F.asc("selection_rank")]))
    for name in ("train", "dev", "test"):
        part = rows.where(F.col("split") == name)
        writers.write_jsonl(part.select(F.lit(chat.TASK).alias("instruction"), chat.open_prompt("context").alias("input"), F.col("chosen").alias("output")), f"{out}/{name}_sft")
        writers.write_jsonl(writers.preference_alpaca(part, chat.prompt_lines("context"), chat.TASK), f"{out}/{name}_preferences")
    writers.write_jsonl(splits.split_stats(rows, rank="selection_rank"), f"{out}/stats")
    return rows


def prepare_job(spark: SparkSession, source: str, out: str, ratio: float = 0.05, seed: int = 42) -> DataFrame:
    """Instruction rows: invalid ones counted, exact repeats left out, validation held out."""
    rows = readers.read_records(spark, source, readers.ALPACA)
    # Named by its content: the same on any layout of partitions.
    rows = rows.withColumn("idx", F.sha2(F.to_json(F.struct("instruction", "input", "output")), 256))
    rows = cut(rows.withColumn("state", P.valid_sample("instruction", "input", "output")))
    keys = [clean.plain_text(c) for c in ("instruction", "input", "output")]
    kept = cut(grouping.exact_first(rows.where("state = 'ok'").dropDuplicates(["idx"]), keys, "idx"))
    both = splits.holdout(kept, "idx", ratio, seed).select("is_validation", chat.conversational("instruction", "input", "output").alias("r")).select("is_validation", "r.*")
    for name, test in (("train", "not is_validation"), ("validation", "is_validation")):
        writers.write_jsonl(both.where(test).drop("is_validation"), f"{out}/{name}")
    writers.write_jsonl(rows.groupBy("state").count(), f"{out}/states")
    counts = rows.agg(F.count("*").alias("read"), F.count_if(F.col("state") == "ok").alias("valid")).withColumn("kept", F.lit(kept.count()))
    writers.write_jsonl(counts, f"{out}/counts")
    writers.write_jsonl(writers.first_rows(kept.drop("state"), [F.asc("idx")]), f"{out}/preview")
    return both


def evaluate_job(spark: SparkSession, source: str, out: str, worst: int = 100) -> DataFrame:
    """Predictions to rows with metrics, their means and the worst cases."""
    rows = cut(reports.evaluated(readers.read_records(spark, source, readers.PREDICTION)))
    writers.write_jsonl(rows, f"{out}/rows")
    writers.write_jsonl(reports.metric_means(rows), f"{out}/means")
    writers.write_jsonl(reports.bad_cases(rows, worst, "id"), f"{out}/worst")
    return rows


def noise_job(spark: SparkSession, source: str, out: str, ratio: float = 0.1, seed: int = 42) -> DataFrame:
    """Preference rows with the sides of a share of them swapped."""
    rows = readers.read_records(spark, source, "instruction string, input string, chosen string, rejected string")
    named = rows.withColumn("idx", F.sha2(F.to_json(F.struct(*rows.columns)), 256)).dropDuplicates(["idx"])
    done = cut(splits.add_noise(named, "idx", ratio, seed).drop("idx"))
    writers.write_jsonl(done, out, [F.asc("source_index")])
    return done


def replace_job(spark: SparkSession, source: str, out: str, manual: str) -> DataFrame:
    """Instruction rows of the highest risk replaced by those of another file."""
    rows = readers.read_records(spark, source, readers.ALPACA).withColumn("idx", F.sha2(F.to_json(F.struct("instruction", "input", "output")), 256)).dropDuplicates(["idx"])
    made = readers.read_records(spark, manual, readers.ALPACA).withColumn("idx", F.lit(None).cast("string"))
    done = cut(splits.replace_riskiest(rows, "idx", scoring.record_risk("input", "output"), made).drop("idx"))
    writers.write_jsonl(done, out)
    return done


def telemetry_job(spark: SparkSession, source: str, out: str) -> DataFrame:
    """Peak and 95th percentile of memory per device, as rows and as a table."""
    rows = cut(reports.telemetry_peaks(readers.read_telemetry(spark, source), ["index"]))
    writers.write_jsonl(rows, f"{out}/peaks")
    writers.write_text(spark.createDataFrame([(writers.markdown(rows, {"index": "Device", "peak_mb": "Peak MB", "p95_mb": "P95 MB"}),)], "line string"), f"{out}/table")
    return rows


JOBS = {"select": select_pairs, "repair": repair_job, "convert": convert_job, "split": split_job, "prepare": prepare_job, "evaluate": evaluate_job, "noise": noise_job, "replace": replace_job, "telemetry": telemetry_job}
#: Options of each job besides source and out.
OPTIONS = {
    "select": ("top_k", "mode", "pack"), "repair": ("manual", "targets", "pack"), "convert": ("least_turns",), "split": (), "prepare": ("ratio", "seed"),
    "evaluate": ("worst",), "noise": ("ratio", "seed"), "replace": ("manual",), "telemetry": (),
}


def main(arguments: Sequence[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="dialoom")
    parser.add_argument("job", choices=sorted(JOBS))
    parser.add_argument("source")
    parser.add_argument("out")
    for name, kind in (("top-k", int), ("least-turns", int), ("ratio", float), ("seed", int), ("worst", int), ("manual", str), ("pack", str)):
        parser.add_argument(f"--{name}", type=kind)
    parser.add_argument("--targets", type=lambda text: tuple(map(int, text.split(","))))
    for name in ("strict", "generic", "sft"):
        parser.add_argument(f"--{name}", action="store_true")
    a = parser.parse_args(arguments)
    spark = SparkSession.getActiveSession() or local_session()
    given = {k: v for k, v in vars(a).items() if v is not None and k in OPTIONS[a.job]}
    if a.pack:
        given["pack"] = load_pack("\n".join(r[0] for r in spark.read.text(a.pack, wholetext=True).collect()))
    if "mode" in OPTIONS[a.job]:
        given["mode"] = scoring.Mode(a.strict, a.generic, a.sft)
    JOBS[a.job](spark, a.source, a.out, **given)


if __name__ == "__main__":
    main()
