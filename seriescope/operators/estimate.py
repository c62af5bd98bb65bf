"""Distinct series: exact, or by mergeable sketches."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.spec import StreamSpec
from .limit import enforced
from .series import contributes, group_key, grouped, identity


def error_bound(p: int, exact: Column) -> Column:
    """Four standard errors of a sketch of precision ``p``, 2 at least."""
    return F.greatest(F.lit(2.0), exact * (4 * 1.04 / math.sqrt(2**p)))


def cardinality(series: DataFrame, keys: Sequence[str] = (), exact: bool = True, p: int = 14) -> DataFrame:
    """key, value: distinct series of each group; with no keys one row for all."""
    rows = grouped(series, keys)
    count = F.count_distinct("fp") if exact else F.hll_sketch_estimate(F.hll_sketch_agg("fp", p))
    if not keys:
        return rows.agg(count.alias("value")).select(F.array().cast("array<string>").alias("key"), "value")
    return rows.groupBy("key").agg(count.alias("value"))


def sketch_check(series: DataFrame, keys: Sequence[str], p: int) -> DataFrame:
    """key, value (exact), within_bound: whether the sketch's estimate is as near as its precision promises."""
    rows = grouped(series, keys)
    both = rows.groupBy("key").agg(F.count_distinct("fp").alias("value"), F.hll_sketch_estimate(F.hll_sketch_agg("fp", p)).alias("estimate"))
    return both.select("key", "value", (F.abs(F.col("estimate") - F.col("value")) <= error_bound(p, F.col("value"))).alias("within_bound"))


def inserts(series: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The number of contributing series rows, repeated ones too."""
    return series.where(contributes(F.col("labels"), keys)).agg(F.count("*").alias("inserts"))


def group_count(series: DataFrame, keys: Sequence[str]) -> DataFrame:
    return grouped(series, keys).select("key").distinct().agg(F.count("*").alias("value"))


def assigned(series: DataFrame, specs: Sequence[StreamSpec], *more: str) -> DataFrame:
    """stream, key, fp and ``more``: every series once for each stream that it contributes to. One scan serves all streams."""
    labels = F.col("labels")
    options = [F.when(contributes(labels, s.group_by), F.struct(F.lit(i).alias("stream"), group_key(labels, s.group_by).alias("key"))) for i, s in enumerate(specs)]
    each = series.select(identity(series).alias("fp"), F.explode(F.array_compact(F.array(*options))).alias("at"), *more)
    return each.select("at.stream", "at.key", "fp", *more)


def multi_stream(series: DataFrame, specs: Sequence[StreamSpec], limits: bool = True) -> DataFrame:
    """stream, key, value for several streams from one scan, of all rows as one generation. Of a stream with more groups than its
    limit, those that arrive first count (by the column ``arrival``, if there is one, else by their keys); without ``limits``
    all groups do."""
    if not limits:
        return assigned(series, specs).groupBy("stream", "key").agg(F.count_distinct("fp").alias("value"))
    arrival = F.col("arrival") if "arrival" in series.columns else F.lit(0).cast("long")
    rows = assigned(series.withColumn("arrival", arrival), specs, "arrival").withColumn("gen", F.lit(0).cast("long"))
    return enforced(rows, specs)[0].groupBy("stream", "key").agg(F.count_distinct("fp").alias("value"))
