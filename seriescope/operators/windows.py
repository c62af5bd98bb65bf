"""Two-generation windows: an estimate covers the current half interval and the one before it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.spec import StreamSpec
from .estimate import assigned, error_bound
from .generations import at_us, epoch_us, generation
from .limit import enforced
from .series import grouped


def windowed(series: DataFrame, spec: StreamSpec) -> DataFrame:
    """key, window_start, window_end, value: estimates at the end of every generation in which a group is alive."""
    rows = grouped(series, spec.group_by, "ts").select("key", "fp", generation(F.col("ts"), spec.half_us).alias("gen")).distinct()
    # A series counts in its own generation and the next: one distinct row each, not one per sighting.
    seen = rows.withColumn("at", F.explode(F.array(F.col("gen"), F.col("gen") + 1)))
    out = seen.groupBy("key", "at").agg(F.count_distinct("fp").alias("value"))
    return out.select("key", at_us((F.col("at") - 1) * spec.half_us).alias("window_start"), at_us((F.col("at") + 1) * spec.half_us).alias("window_end"), "value")


def windowed_sketches(series: DataFrame, spec: StreamSpec) -> DataFrame:
    """key, gen, value (exact), within_bound, live (seen in this generation itself). One sketch per key and generation, which
    counts in its own generation and the next, as sightings do."""
    rows = grouped(series, spec.group_by, "ts").select("key", "fp", generation(F.col("ts"), spec.half_us).alias("gen"))
    both = F.explode(F.array(F.col("gen"), F.col("gen") + 1))
    sketches = rows.groupBy("key", "gen").agg(F.hll_sketch_agg("fp", spec.hll_precision).alias("sketch")).select("key", F.col("gen").alias("own"), "sketch", both.alias("gen"))
    estimates = sketches.groupBy("key", "gen").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate"), (F.max("own") == F.col("gen")).alias("live"))
    exact = rows.distinct().withColumn("gen", both).groupBy("key", "gen").agg(F.count_distinct("fp").alias("value"))
    within = F.abs(F.col("estimate") - F.col("value")) <= error_bound(spec.hll_precision, F.col("value"))
    return exact.join(estimates, ["key", "gen"]).select("key", "gen", "value", within.alias("within_bound"), "live")


def as_of(series: DataFrame, spec: StreamSpec, us: int, reset_us: int | None = None, bucket: Column | None = None) -> DataFrame:
    """key, value at a moment. ``reset_us``: sightings before it are forgotten. ``bucket`` (0 to buckets - 1): rotation is
    staggered, each bucket on a grid of its own."""
    step = spec.half_us // spec.buckets if bucket is not None else 0
    half = step * spec.buckets if bucket is not None else spec.half_us
    shift = bucket * F.lit(step) if bucket is not None else F.lit(0)
    seen = series.where((epoch_us(F.col("ts")) <= us) & (generation(F.col("ts"), half, shift) >= F.floor((F.lit(us) - shift) / F.lit(half)) - 1))
    if reset_us is not None:
        seen = seen.where(epoch_us(F.col("ts")) >= reset_us)
    return grouped(seen, spec.group_by).groupBy("key").agg(F.count_distinct("fp").alias("value"))


def estimates(series: DataFrame, specs: Sequence[StreamSpec], exact: bool = True) -> DataFrame:
    """as_of, interval, group_by_keys, group_by_values, value: all streams at the end of every generation, from one scan,
    with a summary row (keys ``__group__``) for grouped streams. Groups beyond a stream's limit count in its summary only."""
    arrival = F.col("arrival") if "arrival" in series.columns else epoch_us(F.col("ts"))
    rows = assigned(series.withColumn("arrival", arrival), specs, "ts", "arrival")
    halves = F.create_map(*[x for i, s in enumerate(specs) for x in (F.lit(i), F.lit(s.half_us))])
    rows = rows.select("stream", "key", "fp", halves[F.col("stream")].alias("half"), F.floor(epoch_us(F.col("ts")) / halves[F.col("stream")]).cast("long").alias("gen"), "arrival")
    rows, rejected = enforced(rows, specs)
    rows = rows.drop("arrival")
    both = F.explode(F.array(F.col("gen"), F.col("gen") + 1))
    if exact:
        counts = rows.distinct().withColumn("gen", both).groupBy("stream", "key", "half", "gen").agg(F.count_distinct("fp").alias("value"))
    else:
        parts = []
        for p in sorted({s.hll_precision for s in specs}):
            mine = rows.where(F.col("stream").isin([i for i, s in enumerate(specs) if s.hll_precision == p]))
            made = mine.groupBy("stream", "key", "half", "gen").agg(F.hll_sketch_agg("fp", p).alias("sketch")).withColumn("gen", both)
            parts.append(made.groupBy("stream", "key", "half", "gen").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("value")))
        counts = parts[0]
        for other in parts[1:]:
            counts = counts.unionAll(other)
    name = lambda values: F.create_map(*[x for i, v in enumerate(values) for x in (F.lit(i), F.lit(v))])[F.col("stream")]
    when = at_us((F.col("gen") + 1) * halves[F.col("stream")]).alias("as_of")
    named = [when, name([s.interval_text for s in specs]).alias("interval"), name([s.keys_text for s in specs]).alias("group_by_keys")]
    lines = counts.select(*named, F.array_join("key", ",").alias("group_by_values"), "value")
    groups = counts.where(F.size("key") > 0).select(*named)
    if rejected is not None:
        groups = groups.unionAll(rejected.select(*named))
    sums = groups.groupBy("as_of", "interval", "group_by_keys").agg(F.count("*").alias("value"))
    return lines.unionAll(sums.select("as_of", "interval", F.lit("__group__").alias("group_by_keys"), F.col("group_by_keys").alias("group_by_values"), "value"))
