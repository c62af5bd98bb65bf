"""Questions asked of estimates: duplicates, churn, top groups, limit usage, label values and alerts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def without(df: DataFrame, label: str = "instance", value: str = "value") -> DataFrame:
    """The largest value of rows that are alike but for one label."""
    keys = [c for c in df.columns if c not in (label, value)]
    return df.groupBy(*keys).agg(F.max(value).alias(value))


def total_by(df: DataFrame, *keys: str, value: str = "value") -> DataFrame:
    return df.groupBy(*keys).agg(F.sum(value).alias(value))


def churn(estimates: DataFrame, short: str, long: str, *keys: str) -> DataFrame:
    """churn_pct: what share of the series of the long interval is not in the short one. Rows without a partner vanish."""
    sides = estimates.where(F.col("interval").isin(short, long)).groupBy(*keys).agg(
        F.sum(F.when(F.col("interval") == short, F.col("value"))).alias("short"), F.sum(F.when(F.col("interval") == long, F.col("value"))).alias("long")
    )
    known = sides.where("short is not null and long > 0")
    return known.select(*keys, F.round((F.col("long") - F.col("short")) / F.col("long") * 100, 6).alias("churn_pct"))


def top(df: DataFrame, n: int, value: str, *ties: str) -> DataFrame:
    return df.orderBy(F.desc(value), *ties).limit(n)


def top_each(df: DataFrame, n: int, per: str, value: str, *ties: str) -> DataFrame:
    """The n largest at each moment."""
    place = F.row_number().over(Window.partitionBy(per).orderBy(F.desc(value), *ties))
    return df.withColumn("_place", place).where(F.col("_place") <= n).drop("_place")


def limit_usage(sizes: DataFrame, limits: DataFrame, *keys: str) -> DataFrame:
    """usage: size over limit, joined on all labels."""
    return sizes.join(limits.withColumnRenamed("value", "limit"), list(keys)).select(*keys, F.round(F.try_divide(F.col("value"), F.col("limit")), 6).alias("usage"))


def matches(col: str, op: str, text: str) -> Column:
    """Label matchers: =, !=, =~ and !~; patterns match whole values."""
    c = F.coalesce(F.col(col), F.lit(""))
    if op in ("=", "!="):
        return (c == text) if op == "=" else (c != text)
    if op not in ("=~", "!~"):
        raise ValueError(f"unknown matcher {op!r}")
    hit = c.rlike(f"^(?:{text})$")
    return hit if op == "=~" else ~hit


def label_values(df: DataFrame, label: str, *conditions: Column) -> DataFrame:
    for c in conditions:
        df = df.where(c)
    return df.select(label).where(F.col(label).isNotNull()).distinct()


def alerts(df: DataFrame, condition: Column, hold_s: int, step_s: int, keys: Sequence[str], at: str = "as_of") -> DataFrame:
    """keys, since, until: spans in which ``condition`` holds at every step, for ``hold_s`` seconds at least."""
    seconds = F.unix_seconds(F.col(at).cast("timestamp"))
    line = Window.partitionBy(*keys).orderBy(at)
    hits = df.where(condition).withColumn("_s", seconds)
    new = F.when(F.col("_s") - F.lag("_s").over(line) <= step_s, 0).otherwise(1)
    islands = hits.withColumn("_new", new).withColumn("_island", F.sum("_new").over(line))
    spans = islands.groupBy(*keys, "_island").agg(F.min(at).alias("since"), F.max(at).alias("until"), (F.max("_s") - F.min("_s")).alias("_held"))
    return spans.where(F.col("_held") >= hold_s).drop("_held", "_island")
