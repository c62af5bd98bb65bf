"""Tables as series: rows of labels (in order), a time and an order of arrival."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def label_array(**labels: Column) -> Column:
    """Labels in the order given; those with a null value are absent."""
    return F.filter(F.array(*[F.struct(F.lit(k).alias("name"), v.cast("string").alias("value")) for k, v in labels.items()]), lambda x: x["value"].isNotNull())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def from_events(events: DataFrame, **more: Column) -> DataFrame:
    """labels, ts, arrival. ``more`` adds labels."""
    labels = label_array(__name__=F.col("event_type"), user_id=F.col("user_id"), k=F.get_json_object("props", "$.k"), **more)
    return events.select(labels.alias("labels"), "ts", F.col("event_id").alias("arrival"))


def from_lineitem(lineitem: DataFrame) -> DataFrame:
    labels = label_array(__name__=F.lit("lineitem"), job=F.col("l_returnflag"), instance=F.col("l_linestatus"), part=F.col("l_partkey"), supp=F.col("l_suppkey"))
    return lineitem.select(labels.alias("labels"), F.col("l_shipdate").alias("ts"), (F.col("l_orderkey") * 16 + F.col("l_linenumber")).alias("arrival"))


def from_documents(documents: DataFrame) -> DataFrame:
    return documents.select(label_array(__name__=F.col("source"), lang=F.col("lang"), doc_id=F.col("doc_id")).alias("labels"))


def events(spark: SparkSession, sf_dir: str, **more: Column) -> DataFrame:
    return from_events(table(spark, sf_dir, "events"), **more)


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_lineitem(table(spark, sf_dir, "lineitem"))
