"""A corpus pipeline: quality rules, exact deduplication, near-deduplication, mixing and packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of documents. Stages are
written as Parquet and read again, so each works on all that its predecessor kept.

In every stage null texts count as empty, rows without an id or with a repeated one are documents of their own, an empty table
gives an empty result, and further columns are passed through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from seriescope.llm import exact_dedup, mixing, packing, quality_rules, simhash
from seriescope.llm.common import documents, materialized

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules learned from the labels; rejected documents go. Repeated rows are judged each; null and empty texts have no
    words, and go. Without labels the base rule alone decides."""
    rules = quality_rules.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_rules.apply_rules(docs, rules)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of texts that are equal but for white space: that with the least id (none only where no member
    has one), and of several rows under that id the shortest text, then the least one; of rows alike in both one stays."""
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies (five words, a similarity of 0.8 or more, or two bits of a fingerprint at
    most): that with the least id, and of several texts under that id the one whose hash is least. Texts without any word
    link with each other."""
    return simhash.deduplicate(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at tempered weights; rows of small sources are repeated, none is lost. A null source is a source; rows alike are
    rows each; a source without words is passed once."""
    return mixing.mixed(docs, mixing.plan_of(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids, packed into sequences. A row that mixing repeated is packed as often; ties go by a number of the piece."""
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", keep_good),
    ("exact_dedup", drop_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("source_mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: No SQL: learned rules, fingerprints and packing are beyond it; tests compare each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialized(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
