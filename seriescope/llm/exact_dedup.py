"""Exact deduplication by 128-bit content hash.

Texts are equal when they are identical after each run of white space became one space. Rows are grouped by the MD5 of the
normalised text; inside a group the bytes are compared, as the normalised text is a second grouping key: a collision becomes
a class of its own. Copies merge before the shuffle, so a text is sent once for each task that read it.

Defined cases: a null text is the empty text; a null id keeps its row, and is the id that stays only where no member has
another; repeated rows with one id are members of one class; an empty table gives an empty result; further columns pass
through ``deduplicate`` unchanged, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, materialized, text_of, with_hot_rows_broadcast


def _normalised(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    norm = docs.select(F.col(id_col).alias("doc_id"), F.regexp_replace(text_of(text_col), SPACE, " ").alias("norm"))
    return norm.withColumn("md5", F.md5(F.col("norm").cast("binary")))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    norm = _normalised(docs, id_col, text_col)
    rows = materialized(norm.select("doc_id", F.concat("md5", F.sha2("norm", 256)).alias("key")), "exact-rows")
    groups = norm.groupBy("md5", "norm").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    groups = materialized(groups.select(F.concat("md5", F.sha2("norm", 256)).alias("key"), "keep_id", "group_size"), "exact-groups")
    out = with_hot_rows_broadcast(rows, groups, "key", "group_size", rows.count())
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.substring("key", 33, 64).alias("text_sha256"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one for each class, with all their columns."""
    names = docs.columns
    kept = classes(docs, id_col, text_col).where("kept").select(F.col("doc_id").alias("_keep"), F.col("text_sha256").alias("_sha")).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.col(id_col).alias("_id"), F.sha2(F.regexp_replace(text_of(text_col), SPACE, " "), 256).alias("_text"))
    left = rows.join(kept, F.col("_id").eqNullSafe(F.col("_keep")) & (F.col("_text") == F.col("_sha")), "left_semi")
    once = left.withColumn("_n", F.row_number().over(Window.partitionBy("_id", "_text").orderBy(F.length(f"_row.{text_col}"), f"_row.{text_col}"))).where("_n = 1")
    return once.select(*[F.col(f"_row.`{c}`").alias(c) for c in names])
