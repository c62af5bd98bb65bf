"""Sketch tables: mergeable partial counts that jobs write and others merge."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.spec import StreamSpec
from .generations import epoch_us, generation
from .limit import admissions
from .series import grouped

#: What identifies a stream in the tables of several jobs.
STREAM = ("interval", "group_by_keys", "labels")


def _described(rows: DataFrame, spec: StreamSpec, node: str, *more: Column | str) -> DataFrame:
    static = F.array(*[F.struct(F.lit(k).alias("name"), F.lit(v).alias("value")) for k, v in sorted(spec.labels.items())]).cast("array<struct<name:string,value:string>>")
    return rows.select(F.lit(node).alias("node"), F.lit(spec.interval_text).alias("interval"), F.lit(spec.keys_text).alias("group_by_keys"), static.alias("labels"), "key", F.lit(spec.hll_precision).alias("p"), "sketch", *more)


def sketch(series: DataFrame, spec: StreamSpec, node: str = "") -> DataFrame:
    """node, interval, group_by_keys, labels, key, p, sketch: the partial state of one job over all of ``series``."""
    made = grouped(series, spec.group_by).groupBy("key").agg(F.hll_sketch_agg("fp", spec.hll_precision).alias("sketch"))
    return _described(made, spec, node)


def snapshot(series: DataFrame, spec: StreamSpec, us: int, node: str = "") -> DataFrame:
    """The state of one job at a moment: a sketch for each group of the generation of that moment and the one before it, under the
    stream's limit; a group that the present generation rejects has no sketch. ``group_limit`` goes along for merged results."""
    arrival = F.col("arrival") if "arrival" in series.columns else epoch_us(F.col("ts"))
    seen = series.where(epoch_us(F.col("ts")) <= us).withColumn("_arrival", arrival)
    rows = grouped(seen, spec.group_by, "ts", "_arrival").withColumn("gen", generation(F.col("ts"), spec.half_us))
    now = us // spec.half_us
    recent = rows.where(F.col("gen").isin(now - 1, now))
    limit = F.lit(spec.group_limit if spec.group_by else 0).cast("long").alias("group_limit")
    if not spec.group_by:
        return _described(recent.groupBy("key").agg(F.hll_sketch_agg("fp", spec.hll_precision).alias("sketch")), spec, node, limit)
    # Who is admitted now depends on who was before, as far back as generations follow each other under a reached limit.
    told = admissions(rows.groupBy("gen", "key").agg(F.min("_arrival").alias("first_seen")), spec.group_limit).where(F.col("gen").isin(now - 1, now))
    kept = recent.join(told.where("admitted"), ["gen", "key"], "left_semi").groupBy("key").agg(F.hll_sketch_agg("fp", spec.hll_precision).alias("sketch"))
    rejected = told.where((F.col("gen") == now) & ~F.col("admitted")).select("key", F.lit(None).cast("binary").alias("sketch"))
    return _described(kept.unionAll(rejected), spec, node, limit)


def write(sketches: DataFrame, path: str) -> None:
    sketches.write.mode("overwrite").parquet(path)


def read(spark: SparkSession, paths: Sequence[str]) -> tuple[DataFrame | None, list[str]]:
    """Sketches of all nodes that there are, and the paths of those that are missing: a lost node gives a partial result. Any
    other fault of a path, such as another schema, is an error."""
    found, lost = None, []
    for path in paths:
        try:
            one = spark.read.parquet(path)
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):  # missing, or not yet written
                raise
            lost.append(path)
            continue
        found = one if found is None else found.unionByName(one)
    return found, lost


def merged(sketches: DataFrame) -> DataFrame:
    """interval, group_by_keys, labels, key, value over all nodes. Streams that differ in interval or labels stay apart;
    sketches of different precision are an error."""
    return sketches.where("sketch is not null").groupBy(*STREAM, "key").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch", False)).alias("value"))


def merged_summary(sketches: DataFrame, rejected: DataFrame | None = None) -> DataFrame:
    """interval, group_by_keys, value: groups over all nodes; ``rejected`` (interval, group_by_keys, key) adds keys that some
    node rejected, each once however many did, and only where no node admitted it."""
    keys = sketches.where(F.size("key") > 0).select("interval", "group_by_keys", "key")
    if rejected is not None:
        keys = keys.unionByName(rejected.select("interval", "group_by_keys", "key"))
    return keys.distinct().groupBy("interval", "group_by_keys").agg(F.count("*").alias("value"))


def merged_limits(snapshots: DataFrame) -> DataFrame:
    """interval, group_by_keys, live, rejected, group_count, group_limit of grouped streams over the snapshots of all nodes: a key is
    live if some node admits it, and rejected, once, if no node does."""
    keys = snapshots.where(F.size("key") > 0).groupBy("interval", "group_by_keys", "key").agg(F.max(F.col("sketch").isNotNull()).alias("live"), F.max("group_limit").alias("group_limit"))
    sums = keys.groupBy("interval", "group_by_keys").agg(F.count_if("live").alias("live"), F.count_if(~F.col("live")).alias("rejected"), F.count("*").alias("group_count"), F.max("group_limit").alias("group_limit"))
    return sums.select("interval", "group_by_keys", "live", "rejected", "group_count", "group_limit")
