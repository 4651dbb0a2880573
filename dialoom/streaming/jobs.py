"""Streaming variants: dialogue lines cleaned and deduplicated as they come, peak
telemetry per window. Both keep bounded state by a watermark."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from dialoom.functions import predicates as P
from dialoom.functions.clean import clean_turn, mask_key, masked_context
from dialoom.session import keep, shared_folder


def clean_stream(rows: DataFrame, time: str = "logged_at", late: str = "1 hour") -> DataFrame:
    """Rows `context, response` with keys, only those worth keeping, each pair once
    within the watermark."""
    turns = F.transform("context", lambda t: clean_turn(F.coalesce(t, F.lit(""))))
    out = rows.withColumn("context_key", masked_context(turns)).withColumn("reply", clean_turn(F.coalesce("response", F.lit("")))).withColumn("reply_key", mask_key("reply"))
    out = out.where(P.keep_reason("context", "reply") == "ok")
    return out.withWatermark(time, late).dropDuplicatesWithinWatermark(["context_key", "reply_key"])


def window_counts(rows: DataFrame, by: list[str], time: str = "logged_at", size: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Rows per window and group; a late row is dropped once its window is closed."""
    return rows.withWatermark(time, late).groupBy(F.window(time, size), *by).agg(F.count("*").alias("rows"))


def peak_stream(telemetry: DataFrame, time: str = "ts", value: str = "memory_used_mb", by: tuple[str, ...] = ("index",), size: str = "5 seconds", late: str = "1 minute") -> DataFrame:
    """Largest value per window; cells that are no numbers are skipped."""
    number = F.floor(F.expr(f"try_cast(trim(cast(`{value}` as string)) as double)"))
    return telemetry.withWatermark(time, late).groupBy(F.window(time, size), *by).agg(F.max(number).alias("peak"))


def run_once(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """What a stream has to say about all data that is there: run until that is read,
    each result of a batch written to the shared folder in place of the one before
    (`append`: beside it). State and progress are kept there too, so a lost executor,
    or the driver started again, goes on where it was."""
    spark = stream.sparkSession
    folder = f"{shared_folder(spark)}/dialoom-stream-{uuid.uuid4().hex}"
    keep(spark, folder)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{folder}/rows")

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def read_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Table `name` of a data folder as a stream of its files. Times without a zone
    are read as times, which watermarks need."""
    path = f"{folder}/{name}.parquet"
    # As a pattern, the name may be that of one file or of a folder.
    rows = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{folder}/{name}.parque[t]")
    return rows.withColumns({c: F.col(c).cast("timestamp") for c, kind in rows.dtypes if kind == "timestamp_ntz"})
