"""The queries op1 to op10 over the table documents, with production parameters, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, license_scan, lm_score, mixing, packing, quality_gam, quality_rules, secrets, simhash, suffix_dedup
from .common import documents


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(documents(spark, sf_dir)))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicated(documents(spark, sf_dir))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(documents(spark, sf_dir))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir))


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.scored(documents(spark, sf_dir))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.classes(documents(spark, sf_dir))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.cluster(documents(spark, sf_dir), words=3, radius=2)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "component_size")


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return mixing.schedule(docs, mixing.plan_of(docs))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality_gam.judged(docs, quality_gam.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality_rules.judged(docs, quality_rules.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


QUERIES = {f.__name__: f for f in (op1_secret_scan, op2_suffix_dedup, op3_license_scan, op4_best_fit_packing, op5_lm_score, op6_exact_dedup, op7_simhash_near_dedup, op8_source_mixing, op9_quality_classifier, op10_quality_rules)}

ORACLE_SQL = {
    "op6_exact_dedup": r"""
        with d as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as norm from documents),
        g as (select doc_id, min(doc_id) over (partition by norm) as keep_id, count(*) over (partition by norm) as group_size, sha256(norm) as text_sha256 from d)
        select doc_id, keep_id, group_size, doc_id is not distinct from keep_id as kept, text_sha256 from g""",
}
