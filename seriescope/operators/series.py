"""Identity of a series, and the key of the group it belongs to."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def prune(labels: Column, names: Sequence[str]) -> Column:
    return F.filter(labels, lambda x: x["name"].isin(*names)) if names else F.filter(labels, lambda x: F.lit(False))


def fingerprint(labels: Column, sort_labels: bool = False) -> Column:
    """64-bit identity of a label set in the order it came in; ``sort_labels`` makes the order irrelevant."""
    return F.xxhash64(F.array_sort(labels) if sort_labels else labels)


def identity(series: DataFrame) -> Column:
    """The identity that the source gave the series (``fp``), or the fingerprint of its labels."""
    return F.col("fp") if "fp" in series.columns else fingerprint(F.col("labels"))


def label_value(labels: Column, name: str) -> Column:
    """The first label of that name, or null."""
    return F.get(F.filter(labels, lambda x: x["name"] == name), F.lit(0))["value"]


def group_key(labels: Column, keys: Sequence[str]) -> Column:
    """Values of the keys; absent labels are empty."""
    return F.array(*[F.coalesce(label_value(labels, k), F.lit("")) for k in keys]) if keys else F.array().cast("array<string>")


def contributes(labels: Column, keys: Sequence[str]) -> Column:
    """A grouped stream counts series that have any of its labels; a global one counts all."""
    return F.exists(labels, lambda x: x["name"].isin(*keys)) if keys else F.lit(True)


def grouped(series: DataFrame, keys: Sequence[str], *more: str) -> DataFrame:
    """key, fp and the columns ``more`` of the series that contribute."""
    return series.where(contributes(F.col("labels"), keys)).select(group_key(F.col("labels"), keys).alias("key"), identity(series).alias("fp"), *more)


def flat(df: DataFrame, keys: Sequence[str], key: str = "key") -> DataFrame:
    """The key's values as columns by_<label>, in place of the key."""
    return df.select(*[F.get(key, F.lit(i)).alias(f"by_{k.strip('_') or k}") for i, k in enumerate(keys)], *[c for c in df.columns if c != key])
