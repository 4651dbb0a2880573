"""Sinks. Tables of any size are written by Spark as JSONL, text or CSV folders;
single JSON arrays and Markdown are for reports and are bounded."""

from __future__ import annotations

import json
import os

from pyspark.sql import Column, DataFrame, functions as F

from dialoom.functions.clean import cell, col

#: Rows that a single-file sink takes.
REPORT_ROWS = 100_000


def raw_line(label: Column | str, context: Column | str, response: Column | str) -> Column:
    """`label TAB turn... TAB reply`."""
    return F.concat_ws("\t", col(label).cast("string"), F.array_join(col(context), "\t"), col(response))


def raw_pairs(pairs: DataFrame, order: str = "rank", positive_only: bool = False) -> DataFrame:
    """`line` in file order: for each pair its chosen line, then its rejected one."""
    kinds = F.array(F.struct(F.lit(1).alias("label"), F.col("chosen").alias("reply")), *([] if positive_only else [F.struct(F.lit(0).alias("label"), F.col("rejected").alias("reply"))]))
    rows = pairs.select(order, "context", F.posexplode(kinds).alias("_i", "_x"))
    return rows.orderBy(order, "_i").select(raw_line("_x.label", "context", "_x.reply").alias("line"))


def preview(pairs: DataFrame) -> DataFrame:
    """Preview rows; the score rounded half to even at 4 digits."""
    names = [c for c in ("category", "source", "context", "chosen", "rejected", "chosen_issues", "rejected_issues", "issues", "pos_line_no", "neg_line_no") if c in pairs.columns]
    return pairs.select(F.bround("score", 4).alias("score"), *names)


def preference_alpaca(pairs: DataFrame, prompt: Column, instruction: str) -> DataFrame:
    return pairs.select(F.lit(instruction).alias("instruction"), prompt.alias("input"), "chosen", "rejected")


def selection_stats(pairs: DataFrame, category: str = "category", template: str = "template", question: str = "asked_key", n: int = 80) -> DataFrame:
    """`kind, value, n`: rows per category, most frequent templates and questions."""
    parts = [pairs.groupBy(F.lit("category").alias("kind"), F.col(category).alias("value")).agg(F.count("*").alias("n"))]
    for kind, name in (("template", template), ("question", question)):
        parts.append(pairs.groupBy(F.lit(kind).alias("kind"), F.col(name).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(n))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def write_jsonl(df: DataFrame, path: str, order: list[Column] | None = None) -> None:
    (df.orderBy(*order) if order else df).write.mode("errorifexists").json(path)


def write_text(df: DataFrame, path: str, column: str = "line") -> None:
    df.select(column).write.mode("errorifexists").text(path)


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    df.select(*columns).write.mode("errorifexists").option("header", True).csv(path)


def bounded(df: DataFrame, most: int = REPORT_ROWS) -> list:
    """Rows of a report; more than `most` are refused, not cut off."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows: write them as a folder")
    return rows


def write_json_array(df: DataFrame, path: str) -> None:
    """One readable JSON array; for reports."""
    rows = [json.loads(r[0]) for r in bounded(df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})))]
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as out:
        json.dump(rows, out, ensure_ascii=False, indent=2)


def markdown(df: DataFrame, columns: dict[str, str], percent: tuple[str, ...] = (), signed: tuple[str, ...] = (), empty: str = "no rows") -> str:
    """A table with the given headings: numbers with four digits, percent or signs."""
    shown = []
    for name in columns:
        number = dict(df.dtypes)[name] in ("double", "float")
        value = F.format_string("%.2f%%", F.col(name) * 100) if name in percent else F.format_string("%+.4f", name) if name in signed else F.format_string("%.4f", name) if number else cell(name)
        shown.append(F.when(F.col(name).isNull(), "").otherwise(value).alias(name))
    head = "| " + " | ".join(columns.values()) + " |\n|" + "|".join([" --- "] * len(columns)) + "|\n"
    lines = [r[0] for r in bounded(df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *shown), F.lit(" |"))))]
    return head + "\n".join(lines or ["| " + " | ".join([empty] + [""] * (len(columns) - 1)) + " |"]) + "\n"


def first_rows(df: DataFrame, order: list[Column], n: int = 2) -> DataFrame:
    return df.orderBy(*order).limit(n)


def run_summary(df: DataFrame, **settings: str) -> DataFrame:
    """One row of counts and settings."""
    return df.agg(F.count("*").alias("rows")).withColumns({k: F.lit(v) for k, v in settings.items()} or {"stage": F.lit("pre_train")})


def backup(spark, paths: list[str], root: str, stamp: str) -> str:
    """Copies of those of the paths that exist, in a folder named by the stamp; the
    folder. Outputs never replace inputs here, so this is for keeping a state."""
    hadoop = spark._jvm.org.apache.hadoop
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    folder = f"{root}/backup_{stamp}"
    for path in paths:
        source, target = hadoop.fs.Path(path), hadoop.fs.Path(f"{folder}/{path.rstrip('/').rsplit('/', 1)[-1]}")
        if source.getFileSystem(conf).exists(source):
            hadoop.fs.FileUtil.copy(source.getFileSystem(conf), source, target.getFileSystem(conf), target, False, True, conf)
    return folder
