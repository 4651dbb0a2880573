"""Queries of the training-data problems, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from dialoom.llm import balance, copies, encode, lookalike, pack, pairs, privacy, residue, spam, splits
from dialoom.session import spread, table

#: Populations of problem 3 and their keys.
POPULATIONS = {"candidate": "line_no", "group_selection": "group_id"}


def _wide(spark: SparkSession, d: str, name: str = "candidate") -> DataFrame:
    """A table for work that is heavy per row."""
    return spread(table(spark, d, name))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.look_alike_pairs(_wide(spark, d, "candidate"))


def p1_classes(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.look_alike_classes(_wide(spark, d, "candidate"))


def p1_forms(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.normalize_columns(_wide(spark, d, "candidate").select("line_no", "context", "response"), ["context", "response"])


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return copies.copies(_wide(spark, d, "candidate"))


def p2_collapsed(spark: SparkSession, d: str) -> DataFrame:
    return copies.collapse(_wide(spark, d, "candidate")).select("line_no", "n_copies")


def _balanced(spark: SparkSession, d: str) -> list[balance.Balanced]:
    shares = table(spark, d, "target_share")
    return [balance.balanced_sample(table(spark, d, name), shares, name, key) for name, key in POPULATIONS.items()]


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    one, two = _balanced(spark, d)
    return one.report.unionByName(two.report).where("not met").select("population", "category")


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    one, two = _balanced(spark, d)
    report = one.report.unionByName(two.report).drop("imbalance")
    return report.withColumn("needed", F.round(F.col("needed") * 1000).cast("long"))


def p3_sample(spark: SparkSession, d: str) -> DataFrame:
    picked = [b.sample.select(F.lit(name).alias("population"), F.col(key).alias("row_id"), "category") for b, (name, key) in zip(_balanced(spark, d), POPULATIONS.items())]
    return picked[0].unionByName(picked[1])


def _replies(spark: SparkSession, d: str) -> DataFrame:
    return residue.reply_records(_wide(spark, d, "candidate"), _wide(spark, d, "repair_group"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue(_replies(spark, d)).select("record_kind", "record_id")


def p4_kept(spark: SparkSession, d: str) -> DataFrame:
    records = _replies(spark, d)
    return residue.without_residue(records, residue.residue(records)).select("record_kind", "record_id")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return privacy.personal_data(_wide(spark, d, "candidate"))


def p5_sanitized(spark: SparkSession, d: str) -> DataFrame:
    return privacy.sanitize(_wide(spark, d, "candidate"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return splits.split_overlaps(_wide(spark, d, "messages_sft")).select("msg_id_a", "msg_id_b")


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return splits.overlap_report(_wide(spark, d, "messages_sft"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.defects(_wide(spark, d, "candidate"), _wide(spark, d, "repair_group"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.encode_texts(_wide(spark, d, "documents"))


def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    return pack.pack_texts(_wide(spark, d, "documents"), table(spark, d, "pack_capacity"))


def p9_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Per capacity: documents that are packed whole, containers over their tokens."""
    sizes = table(spark, d, "pack_capacity")
    rows = p9_containers(spark, d)
    bins = rows.groupBy("pack_name", "bin_id").agg(F.sum("n_tokens").alias("n")).join(F.broadcast(sizes), "pack_name")
    over = bins.groupBy("pack_name").agg(F.count_if(F.col("n") > F.col("capacity_tokens")).alias("over_full"))
    docs = rows.groupBy("pack_name", "doc_id").agg(F.count("*").alias("n"), F.max("piece_no").alias("m")).groupBy("pack_name").agg(F.count("*").alias("documents"), F.count_if(F.col("n") != F.col("m") + 1).alias("incomplete"))
    return docs.join(over, "pack_name")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return spam.spam_pages(_wide(spark, d, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_classes, p1_forms, p2_found, p2_collapsed, p3_found, p3_report, p3_sample, p4_found, p4_kept, p5_found, p5_sanitized, p6_found, p6_report, p7_found, p8_ids, p9_containers, p9_coverage, p10_found)}


#: Equivalent SQL where it is simple enough to be trusted.
ORACLE = {
    "p9_coverage": "SELECT pack_name, (SELECT count(*) FROM documents) AS documents, 0 AS incomplete, 0 AS over_full FROM pack_capacity",
    "p3_report": """
        WITH rows_ AS (
          SELECT 'candidate' AS population, category FROM candidate
          UNION ALL SELECT 'group_selection', category FROM group_selection),
        keyed AS (SELECT population, regexp_replace(lower(trim(category)), '[ _-]+', '_', 'g') AS k FROM rows_),
        sizes AS (SELECT population, count(*) AS n FROM rows_ GROUP BY 1),
        have AS (SELECT population, k, count(*) AS n FROM keyed WHERE k IS NOT NULL AND k <> '' GROUP BY 1, 2),
        plan AS (
          SELECT t.population, t.category, coalesce(h.n, 0)::BIGINT AS available, floor(t.sample_rate * s.n + 0.5)::BIGINT AS sample_size, t.min_rows, t.target_share
          FROM target_share t JOIN sizes s USING (population)
          LEFT JOIN have h ON h.population = t.population AND h.k = regexp_replace(lower(trim(t.category)), '[ _-]+', '_', 'g')),
        goal AS (
          SELECT *, greatest(min_rows::DOUBLE, target_share * sample_size) AS needed, least(available, greatest(min_rows, round(target_share * sample_size)::BIGINT)) AS wanted FROM plan)
        SELECT population, category, available, sample_size, round(needed * 1000)::BIGINT AS needed, wanted, wanted AS drawn, available + 1e-9 >= needed AS met FROM goal""",
    "p3_found": """
        WITH rows_ AS (
          SELECT 'candidate' AS population, category FROM candidate
          UNION ALL SELECT 'group_selection', category FROM group_selection),
        keyed AS (SELECT population, regexp_replace(lower(trim(category)), '[ _-]+', '_', 'g') AS k FROM rows_),
        sizes AS (SELECT population, count(*) AS n FROM rows_ GROUP BY 1),
        have AS (SELECT population, k, count(*) AS n FROM keyed WHERE k IS NOT NULL AND k <> '' GROUP BY 1, 2)
        SELECT t.population, t.category
        FROM target_share t JOIN sizes s USING (population)
        LEFT JOIN have h ON h.population = t.population AND h.k = regexp_replace(lower(trim(t.category)), '[ _-]+', '_', 'g')
        WHERE coalesce(h.n, 0) + 1e-9 < greatest(t.min_rows, t.target_share * floor(t.sample_rate * s.n + 0.5))""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
