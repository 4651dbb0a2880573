"""Reports on runs: metrics, logs, telemetry, artifacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from dialoom.functions.clean import col
from dialoom.functions.metrics import char_f1, exact_match, outcome, per_token, rouge_l


def lenient(c: Column | str) -> Column:
    """A number, or null for anything else."""
    return F.expr(f"try_cast(`{c}` as double)") if isinstance(c, str) else c.try_cast("double")


def short_number(c: Column | str) -> Column:
    """Six significant digits without trailing zeros."""
    text = F.format_string("%.6g", lenient(c))
    bare = F.when(text.contains("."), F.regexp_replace(F.regexp_replace(text, "0+$", ""), "\\.$", "")).otherwise(text)
    return F.when(lenient(c).isNotNull(), bare).otherwise(F.lit(""))


def evaluated(df: DataFrame, prediction: str = "prediction", reference: str = "reference") -> DataFrame:
    """exact_match, char_f1 and rouge_l of each row, rounded half to even."""
    return df.withColumns({"exact_match": exact_match(prediction, reference), "char_f1": F.bround(char_f1(prediction, reference), 6), "rouge_l": F.bround(rouge_l(prediction, reference), 6)})


def metric_means(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("rows"), *[F.bround(F.coalesce(F.avg(c), F.lit(0.0)), 6).alias(c) for c in ("exact_match", "char_f1", "rouge_l")])


def bad_cases(df: DataFrame, n: int, order: str) -> DataFrame:
    """The n worst rows."""
    return df.orderBy("char_f1", "rouge_l", "exact_match", order).limit(n)


def preference_rows(df: DataFrame, chosen: str = "chosen_logprob", rejected: str = "rejected_logprob", chosen_tokens: str = "chosen_tokens", rejected_tokens: str = "rejected_tokens") -> DataFrame:
    """Outcome and margins from two log-probabilities."""
    ok = F.col("outcome") != "error"
    rows = df.withColumn("outcome", outcome(chosen, rejected))
    return rows.withColumn("new_margin", F.when(ok, F.col(chosen) - F.col(rejected))).withColumn("normalized_margin", F.when(ok, per_token(chosen, chosen_tokens) - per_token(rejected, rejected_tokens)))


def preference_summary(rows: DataFrame, by: list[str]) -> DataFrame:
    """Per group: rows, valid ones, accuracy (wins of valid), tie rate, mean margins."""
    valid = F.count_if(F.col("outcome") != "error")
    share = lambda kind: F.when(valid > 0, F.bround(F.count_if(F.col("outcome") == kind) / valid, 6)).otherwise(F.lit(0.0))
    mean = lambda c: F.bround(F.coalesce(F.avg(c), F.lit(0.0)), 6)
    return rows.groupBy(*by).agg(F.count("*").alias("rows"), valid.alias("valid"), share("win").alias("accuracy"), share("tie").alias("tie_rate"), mean("new_margin").alias("mean_margin"), mean("normalized_margin").alias("mean_normalized_margin"))


def weighted_loss(df: DataFrame, loss: str = "loss", tokens: str = "tokens", correct: str = "correct", by: list[str] | None = None) -> DataFrame:
    """Loss and accuracy over tokens from rows per batch."""
    total = F.sum(tokens)
    return df.groupBy(*(by or [])).agg(F.when(total > 0, F.sum(F.col(loss) * F.col(tokens)) / total).alias("loss"), F.when(total > 0, F.sum(correct) / total).alias("token_accuracy"), total.alias("tokens"))


def moving_average(value: Column | str, order: str, window: int, by: list[str] | None = None) -> Column:
    """Mean of the last `window` rows, fewer at the start."""
    if window <= 1:
        return col(value)
    spec = W.partitionBy(*(by or [F.lit(0)])).orderBy(order).rowsBetween(-(window - 1), 0)
    return F.avg(col(value)).over(spec)


def loss_series(log: DataFrame, window: int = 1) -> DataFrame:
    """`step, epoch, loss, smoothed, eval_loss, learning_rate` of one run's log;
    of equal steps the last entry counts. One run's log is small."""
    train = log.where("loss is not null").groupBy("step").agg(F.max_by(F.struct("epoch", "loss", "learning_rate"), "idx").alias("t")).select("step", "t.*")
    ev = log.where("eval_loss is not null").groupBy("step").agg(F.max_by("eval_loss", "idx").alias("eval_loss"))
    return train.withColumn("smoothed", moving_average("loss", "step", window)).join(ev, "step", "left").select("step", "epoch", "loss", "smoothed", "eval_loss", "learning_rate")


def telemetry_peaks(df: DataFrame, by: list[str], memory: str = "memory_used_mb") -> DataFrame:
    """Peak and 95th percentile of memory; cells that are no numbers are skipped."""
    value = F.floor(F.expr(f"try_cast(trim(`{memory}`) as double)"))
    return df.withColumn("_m", value).groupBy(*by).agg(F.max("_m").cast("long").alias("peak_mb"), F.percentile_approx("_m", 0.95).cast("long").alias("p95_mb"))


def run_rows(meta: DataFrame, metrics: DataFrame, final: DataFrame, key: str, names: list[str]) -> DataFrame:
    """One row per run; a metric comes from `metrics`, else from `final`. A metric
    of 0 is a metric."""
    a = metrics.select(key, *[lenient(n).alias(f"_a_{n}") for n in names])
    b = final.select(key, *[lenient(n).alias(f"_b_{n}") for n in names])
    joined = meta.join(a, key, "left").join(b, key, "left")
    return joined.select(*meta.columns, *[F.coalesce(f"_a_{n}", f"_b_{n}").alias(n) for n in names])


def artifacts(files: DataFrame) -> DataFrame:
    """Checkpoints and hashes of files read as binaryFile: `path, step, sha256,
    latest, same_as_root` (a root file with the hash of the latest step's)."""
    rows = files.select("path", F.regexp_extract("path", "checkpoint-(\\d+)", 1).try_cast("long").alias("step"), F.sha2("content", 256).alias("sha256"), F.regexp_extract("path", "([^/]+)$", 1).alias("name"))
    top = rows.agg(F.max("step").alias("_top"))
    rows = rows.join(F.broadcast(top)).withColumn("latest", F.coalesce(F.col("step") == F.col("_top"), F.lit(False))).drop("_top")
    newest = rows.where("latest").select("name", F.col("sha256").alias("_h"))
    return rows.join(newest, "name", "left").withColumn("same_as_root", F.when(F.col("step").isNull(), F.coalesce(F.col("sha256") == F.col("_h"), F.lit(False)))).drop("_h")


def checked_summary(summary: DataFrame) -> DataFrame:
    """The gate after a run: stage post_train and equal adapter hashes."""
    return summary.withColumn("gate", F.when(F.coalesce("stage", F.lit("")) != "post_train", "stage").when(~F.col("adapter_sha256").eqNullSafe(F.col("latest_sha256")), "hash").otherwise("ok"))


def stamp() -> Column:
    """The time of the query as `yyyymmdd_HHMMSS`, for names of runs and backups."""
    return F.date_format(F.current_timestamp(), "yyyyMMdd_HHmmss")


def run_steps(matrix: DataFrame, done: DataFrame, names: list[str] | None = None, mode: str = "all", key: str = "run") -> DataFrame:
    """`matrix` with `step` for each run (all those of `names`, or all) and each step
    of the mode (train, eval, collect, all of them), and `skip` where `done`
    (`key, step, seconds`) has it already; `seconds` is what it took."""
    steps = {"all": ["train", "eval", "collect"]}.get(mode, [mode])
    rows = matrix.where(F.col(key).isin(*names)) if names else matrix
    rows = rows.withColumn("step", F.explode(F.array(*[F.lit(x) for x in steps])))
    known = done.groupBy(key, "step").agg(F.max("seconds").alias("seconds"))
    return rows.join(known, [key, "step"], "left").withColumn("skip", F.col("seconds").isNotNull())
