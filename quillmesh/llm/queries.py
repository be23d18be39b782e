"""The registered queries opN_<name>: each applies its operator, with production parameters, to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, divergence, embedding_dedup, hard_negatives, html_text, id_files, licenses, minhash_dedup, packing, pii, quality, toxicity, url_filter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"))


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def vocabulary(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op10_token_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return id_files.round_trip(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.verdicts(table(spark, sf_dir, "pages"), url_filter.rule_table(spark))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives.hard_negatives(rows)


def linked_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3's operator over a table that Spark derives from embeddings, so that its rows hold links."""
    t, step = table(spark, sf_dir, "embeddings"), F.array(F.lit(0.0), F.lit(0.05), F.lit(0.3))
    rows = t.select(F.col("vec_id").alias("base"), F.col("label").alias("own"), F.col("embedding").alias("v"), F.posexplode(step).alias("k", "step"))
    wide = rows.select(
        (3 * F.col("base") + F.col("k")).alias("vec_id"),
        F.when((F.col("base") % 6 == 5) & (F.col("k") == 2), F.col("own") + 1).otherwise(F.col("own")).alias("label"),
        F.transform("v", lambda x, i: x.cast("double") * (1 + F.col("step") * ((i + F.col("base")) % 5 - 2))).alias("embedding"),
    )
    return embedding_dedup.near_duplicates(wide)


def linked_copies_sql() -> str:
    wide = """wide AS (SELECT 3 * vec_id + k AS vec_id, CASE WHEN vec_id % 6 = 5 AND k = 2 THEN label + 1 ELSE label END AS label,
    list_transform(embedding, lambda x, i: CAST(x AS DOUBLE) * (1 + step * ((i - 1 + vec_id) % 5 - 2))) AS embedding FROM embeddings, (VALUES (0, 0.0::DOUBLE), (1, 0.05::DOUBLE), (2, 0.3::DOUBLE)) s(k, step))"""
    return embedding_dedup.ORACLE_SQL.replace("FROM embeddings", "FROM wide").replace("WITH RECURSIVE v AS", f"WITH RECURSIVE {wide},\nv AS")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_toxicity, op2_license_scan, op3_embedding_near_dedup, op4_pii, op5_quality, op6_benchmark_decontamination, op7_html_text, op8_minhash_near_dedup, op9_best_fit_packing, op10_token_id_files,
        op11_source_divergence, op12_url_filter, op13_hard_negatives,
    )
    return {f.__name__: f for f in (*every, linked_copies)}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_license_scan": licenses.oracle(), "op3_embedding_near_dedup": embedding_dedup.ORACLE_SQL, "op6_benchmark_decontamination": decontaminate.ORACLE_SQL,
        "op11_source_divergence": divergence.ORACLE_SQL, "op12_url_filter": url_filter.oracle(), "op13_hard_negatives": hard_negatives.ORACLE_SQL,
        "linked_copies": linked_copies_sql(),
    }
