"""Readers: dialogue lines, JSON and JSONL, previews, logs, telemetry.

Schemas are declared; nothing is inferred where a schema can be given. File order
is part of the data, so text readers give a line number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from dialoom.functions.clean import clean_document, clean_turn, context_key, repair_clean, strip, without_agent
from dialoom.operators.quota import ranked
from dialoom.session import cut

ALPACA = "instruction string, input string, output string"
MESSAGES = "messages array<struct<role:string,content:string>>"
PREVIEW = "score double, category string, context array<string>, chosen string, rejected string, chosen_issues array<string>, rejected_issues array<string>, pos_line_no bigint, neg_line_no bigint"
PREDICTION = "id int, source_index int, prompt string, prediction string, reference string, messages array<struct<role:string,content:string>>"
TRAINER_LOG = "log_history array<struct<step:int,epoch:double,loss:double,eval_loss:double,learning_rate:double,mean_token_accuracy:double>>"
TELEMETRY = "timestamp string, index string, name string, memory_used_mb string, memory_total_mb string, utilization_gpu_pct string, power_draw_w string"


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """`file, line_no, line`: physical lines from 1, the empty one after the last
    line end left out. A file of any size is read in splits; the lines before a
    split are counted once, not collected."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"), F.col("value").alias("line"))
    lines = cut(lines)
    sizes = lines.groupBy("file", "_block").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy("file").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    local = F.row_number().over(W.partitionBy("file", "_block").orderBy("_at"))
    return lines.withColumn("_local", local).join(sizes.withColumn("_before", before).drop("_n"), ["file", "_block"]).select("file", (F.col("_before") + F.col("_local")).alias("line_no"), "line")


def _fields(lines: DataFrame) -> DataFrame:
    return lines.withColumn("_f", F.split("line", "\t", -1))


def _parsed(lines: DataFrame, clean) -> DataFrame:
    f = F.col("_f")
    context = F.transform(F.filter(F.slice(f, 2, F.greatest(F.size(f) - 2, F.lit(0))), lambda x: strip(x) != ""), clean)
    label = F.when(F.size(f) >= 3, strip(F.element_at(f, 1)).try_cast("int"))
    return _fields(lines).withColumn("label", label).withColumn("context", context).withColumn("response", F.when(F.size(f) >= 3, clean(F.element_at(f, -1)))).drop("_f")


def read_dialogues(spark: SparkSession, path: str) -> DataFrame:
    """`file, line_no, label, context, response` of `label TAB turn... TAB reply`;
    label is null where a line does not parse (fewer than 3 fields, a label other
    than 0 and 1, no turn or reply left)."""
    rows = _parsed(numbered_lines(spark, path), clean_turn)
    ok = F.col("label").isin(0, 1) & (F.size("context") > 0) & (F.col("response") != "")
    return rows.withColumn("label", F.when(F.coalesce(ok, F.lit(False)), F.col("label"))).drop("line")


def read_dialogues_loose(spark: SparkSession, path: str) -> DataFrame:
    """The same with any whole label, converter cleaning and no agent marker in
    front of the reply; short lines are left out."""
    rows = _parsed(numbered_lines(spark, path), clean_document).where("label is not null")
    return rows.withColumn("response", without_agent("response")).drop("line")


def read_dialogues_strict(spark: SparkSession, path: str, clean=repair_clean) -> DataFrame:
    """The same, but a short line is an error. `clean=None` leaves texts as they are."""
    lines = numbered_lines(spark, path).where(F.col("line") != "")
    lines = lines.withColumn("line", F.when(F.size(F.split("line", "\t", -1)) < 3, F.raise_error(F.concat(F.lit("fewer than 3 fields in line "), F.col("line_no").cast("string"))).cast("string")).otherwise(F.col("line")))
    return _parsed(lines, clean or (lambda c: c)).drop("line")


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON arrays or JSONL, told by the name; rows inside an object's `results` are
    taken out, whatever the schema."""
    if path.rstrip("/*").endswith(".jsonl"):
        return spark.read.schema(schema).json(path)
    names = spark.createDataFrame([], schema).columns
    rows = spark.read.option("multiLine", True).schema(f"{schema}, results array<struct<{schema}>>").json(path)
    return rows.select(F.inline(F.coalesce("results", F.array(F.struct(*names)))))


def read_ranked(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSONL rows with `selection_rank`, their line number; blank lines are no rows."""
    lines = numbered_lines(spark, path).where(strip("line") != "")
    return lines.select(F.from_json("line", schema).alias("r"), F.col("line_no").alias("selection_rank")).select("r.*", "selection_rank")


def preview_meta(df: DataFrame, rank: str = "selection_rank") -> DataFrame:
    """`context_key, pos_line_no, neg_line_no, source_score`; the last row of a key counts."""
    row = F.struct("pos_line_no", "neg_line_no", F.col("score").alias("source_score"))
    return df.groupBy(context_key("context").alias("context_key")).agg(F.max_by(row, rank).alias("m")).select("context_key", "m.*")


def with_meta(groups: DataFrame, meta: DataFrame, key: str = "run_key", shifted: bool = False, order: str = "first_line") -> DataFrame:
    """Groups with their preview data; defaults are score 0 and no line numbers.
    `shifted` looks each run up under the key of the run after it (the last under
    its own), as an older program did."""
    rows = groups.withColumn("_look", F.col(key))
    if shifted:
        # Ranked in range partitions, then joined with the run after it: no global window.
        rows = cut(ranked(groups, [F.asc(order)]))
        after = rows.select((F.col("rank") - 1).alias("rank"), F.col(key).alias("_next"))
        rows = rows.join(after, "rank", "left").withColumn("_look", F.coalesce("_next", key)).drop("rank", "_next")
    return rows.join(meta.withColumnRenamed("context_key", "_look"), "_look", "left").withColumn("source_score", F.coalesce("source_score", F.lit(0.0))).drop("_look")


def read_manual(spark: SparkSession, path: str | None) -> DataFrame:
    """Hand-made preference pairs with fixed score, source and issue; no file, no rows."""
    from dialoom.functions.chat import lines_to_context

    schema = "input string, prompt string, chosen string, rejected string"
    rows = spark.read.option("multiLine", True).schema(schema).json(path) if path else spark.createDataFrame([], schema)
    out = rows.select(lines_to_context(F.coalesce("input", "prompt", F.lit(""))).alias("context"), repair_clean("chosen").alias("chosen"), repair_clean("rejected").alias("rejected"))
    out = out.where("size(context) > 0 and chosen <> '' and rejected <> ''")
    return out.withColumn("score", F.lit(19.0)).withColumn("source", F.lit("manual_round2")).withColumn("issues", F.array(F.lit("manual_source")))


def read_telemetry(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TELEMETRY).option("header", True).csv(path)


def tolerant_json(c: Column, schema: str) -> Column:
    """A JSON text, or an object with `_load_error` where it is malformed; null counts
    as an empty object."""
    return F.from_json(F.coalesce(c, F.lit("{}")), f"{schema}, _load_error string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_load_error"})


def read_object(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object of a file as a row; a file that is not there counts as an empty
    object, a malformed one gives `_load_error`."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
    text = spark.read.text(path, wholetext=True) if there else spark.createDataFrame([("{}",)], "value string")
    return text.select(tolerant_json(F.col("value"), schema).alias("r")).select("r.*")


def read_trainer_log(spark: SparkSession, path: str) -> DataFrame:
    """`run, idx, step, epoch, loss, ...` from trainer_state.json of each run: the one
    in the run's folder, else that of its highest checkpoint."""
    files = spark.read.option("multiLine", True).schema(TRAINER_LOG).json(path).withColumn("path", F.col("_metadata.file_path"))
    run = F.regexp_replace(F.regexp_extract("path", "^(.*?)(/checkpoint-\\d+)?/[^/]+$", 1), "^file:/+", "/")
    step = F.when(F.regexp_extract("path", "/checkpoint-(\\d+)/", 1) == "", 2**62).otherwise(F.regexp_extract("path", "/checkpoint-(\\d+)/", 1).try_cast("long"))
    best = files.withColumn("run", run).groupBy("run").agg(F.max_by("log_history", step).alias("log_history"))
    return best.select("run", F.posexplode("log_history").alias("idx", "e")).select("run", "idx", "e.*")
