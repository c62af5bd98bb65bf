"""Group limits: the first groups to arrive are admitted, others are only counted."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.spec import StreamSpec
from .series import grouped
from .generations import generation

#: Parts in which the earliest groups of a generation are looked for before the generation as a whole is.
PARTS = 256


def first_seen(series: DataFrame, keys: Sequence[str], half_us: int | None = None) -> DataFrame:
    """gen, key, first_seen: groups with their first arrival; one generation (0) without a half interval."""
    rows = grouped(series, keys, "ts", "arrival").withColumn("gen", generation(F.col("ts"), half_us) if half_us else F.lit(0).cast("long"))
    return rows.groupBy("gen", "key").agg(F.min("arrival").alias("first_seen"))


def admitted_once(series: DataFrame, keys: Sequence[str], limit: int) -> DataFrame:
    """key, place: the groups of a single generation that a limit admits, by arrival."""
    groups = first_seen(series, keys)
    top = groups.orderBy("first_seen", "key").limit(limit)
    return top.select("key", F.row_number().over(Window.partitionBy("gen").orderBy("first_seen", "key")).alias("place"))


def limited(series: DataFrame, keys: Sequence[str], limit: int) -> DataFrame:
    """key, value of the admitted groups of one generation."""
    kept = admitted_once(series, keys, limit).select("key")
    return grouped(series, keys).join(kept, "key", "left_semi").groupBy("key").agg(F.count_distinct("fp").alias("value"))


def summary(series: DataFrame, keys: Sequence[str], limit: int) -> DataFrame:
    """live, rejected, group_count, group_limit of one generation."""
    n = first_seen(series, keys).agg(F.count("*").alias("n"))
    live = F.least(F.col("n"), F.lit(limit))
    return n.select(live.alias("live"), (F.col("n") - live).alias("rejected"), F.col("n").alias("group_count"), F.lit(limit).cast("long").alias("group_limit"))


def earliest(groups: DataFrame, limit: Column | int) -> DataFrame:
    """The keys (stream, key) that are among the first ``limit`` to arrive in some generation. Parts of a generation send their own
    first ones only, so no task ranks all groups."""
    order = ("first_seen", "key")
    limit = limit if isinstance(limit, Column) else F.lit(limit)
    part = F.pmod(F.xxhash64("key"), F.lit(PARTS))
    ranked = groups.withColumn("part", part).withColumn("place", F.row_number().over(Window.partitionBy("stream", "gen", "part").orderBy(*order))).where(F.col("place") <= limit)
    return ranked.withColumn("place", F.row_number().over(Window.partitionBy("stream", "gen").orderBy(*order))).where(F.col("place") <= limit).select("stream", "key").distinct()


def chains(groups: DataFrame, limit: Column | int) -> DataFrame:
    """stream, gen, chain, full: generations that must be judged one after the other share a chain. A generation starts one if the
    one before it is missing, or if its groups and those of the one before it fit the limit together: then all its groups are
    admitted, whatever was before. ``full``: some generation of the chain doesn't fit."""
    limit = limit if isinstance(limit, Column) else F.lit(limit)
    both = groups.select("stream", "key", "gen", F.explode(F.array(F.col("gen"), F.col("gen") + 1)).alias("at"))
    sizes = both.groupBy("stream", F.col("at").alias("gen"), "key").agg(F.max(F.col("gen") == F.col("at")).alias("own")).groupBy("stream", "gen").agg(F.count("*").alias("n"), F.max("own").alias("own"))
    line = Window.partitionBy("stream").orderBy("gen")
    fits = F.col("n") <= limit
    start = F.coalesce(F.lag("gen").over(line) != F.col("gen") - 1, F.lit(True)) | fits
    told = sizes.where("own").withColumn("fits", fits).withColumn("chain", F.sum(start.cast("int")).over(line))
    return told.select("stream", "gen", "chain", F.max(~F.col("fits")).over(Window.partitionBy("stream", "chain")).alias("full"))


def admissions(groups: DataFrame, limit: int | Mapping[int, int]) -> DataFrame:
    """gen, key, first_seen, admitted over many generations. Groups admitted in the generation before come back unchecked;
    new ones take the slots that it left free, in order of arrival. Groups with a column ``stream`` are judged for each stream,
    under a limit of its own (a mapping), and keep that column.

    Where the limit isn't reached, nothing is judged in order: such generations cut the history into chains that run side by
    side. In a chain the rule is sequential; a key enters only from among the first ``limit`` of a generation (at most as many
    keys stand before it as were admitted last, and came back, or now), so rows of early keys alone go through its pass, which
    remembers two sets no larger than the limit.
    """
    streams = "stream" in groups.columns
    rows = groups.select(F.col("stream") if streams else F.lit(0).alias("stream"), "gen", "key", "first_seen")
    bound = limit if isinstance(limit, int) else F.create_map(*[F.lit(x) for kv in limit.items() for x in kv])[F.col("stream")]
    most = {0: limit} if isinstance(limit, int) else dict(limit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain, now, before, mine, free = None, None, frozenset(), set(), 0
        for batch in batches:
            said = []
            for stream, link, gen, key in zip(*[batch.column(k).to_pylist() for k in range(4)]):
                key = tuple(key)
                if (stream, link) != chain:
                    chain, now, mine = (stream, link), None, set()
                if gen != now:
                    before = frozenset(mine) if now is not None and gen == now + 1 else frozenset()
                    now, mine, free = gen, set(), most[stream] - len(before)
                if key in before:
                    ok = True
                else:
                    ok = free > 0
                    free -= ok
                if ok:
                    mine.add(key)
                said.append(ok)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("stream", "gen", "key", "first_seen")], pa.array(said, pa.bool_())], names=["stream", "gen", "key", "first_seen", "admitted"])

    told = rows.join(chains(rows, bound), ["stream", "gen"])
    calm = told.where("not full").select("stream", "gen", "key", "first_seen", F.lit(True).alias("admitted"))
    full = told.where("full")
    early = earliest(full, bound)
    order = ["stream", "chain", "gen", "first_seen", "key"]
    ordered = full.join(early, ["stream", "key"], "left_semi").select("stream", "chain", "gen", "key", "first_seen").repartition("stream", "chain").sortWithinPartitions(*order)
    judged = ordered.mapInArrow(run, "stream int, gen long, key array<string>, first_seen long, admitted boolean")
    never = full.join(early, ["stream", "key"], "left_anti").select("stream", "gen", "key", "first_seen", F.lit(False).alias("admitted"))
    out = calm.unionAll(judged).unionAll(never)
    return out if streams else out.drop("stream")


def reach_limit(rows: DataFrame, specs: Sequence[StreamSpec]) -> list[int]:
    """The grouped streams that have more groups than their limit in two generations on end; rows have stream, gen, key."""
    limits = {i: s.group_limit for i, s in enumerate(specs) if s.group_by}
    if not limits:
        return []
    bound = F.create_map(*[F.lit(x) for kv in limits.items() for x in kv])[F.col("stream")]
    both = rows.where(F.col("stream").isin(list(limits))).select("stream", "key", "gen").distinct().select("stream", "key", F.explode(F.array(F.col("gen"), F.col("gen") + 1)).alias("gen")).distinct()
    over = both.groupBy("stream", "gen").agg(F.count("*").alias("n")).where(F.col("n") > bound)
    return sorted(r["stream"] for r in over.select("stream").distinct().collect())  # at most one row for each stream


def enforced(rows: DataFrame, specs: Sequence[StreamSpec]) -> tuple[DataFrame, DataFrame | None]:
    """The rows (stream, gen, key, arrival, ...) of admitted groups, and the groups that were rejected (stream, gen, key; None
    where no stream reaches its limit: only those that do are judged)."""
    over = reach_limit(rows, specs)
    if not over:
        return rows, None
    mine = rows.where(F.col("stream").isin(over))
    first = mine.groupBy("stream", "gen", "key").agg(F.min("arrival").alias("first_seen"))
    told = admissions(first, {i: specs[i].group_limit for i in over})
    kept = mine.join(told.where("admitted"), ["stream", "gen", "key"], "left_semi").select(*rows.columns)
    return rows.where(~F.col("stream").isin(over)).unionAll(kept), told.where("not admitted").select("stream", "gen", "key")


def limited_windows(series: DataFrame, spec: StreamSpec) -> DataFrame:
    """gen, key, value: estimates of the visible groups at the end of each generation under the stream's limit."""
    told = admissions(first_seen(series, spec.group_by, spec.half_us), spec.group_limit).where("admitted").select("gen", "key")
    rows = grouped(series, spec.group_by, "ts").select("key", "fp", generation(F.col("ts"), spec.half_us).alias("gen")).distinct()
    kept = rows.join(told, ["gen", "key"], "left_semi").withColumn("gen", F.explode(F.array(F.col("gen"), F.col("gen") + 1)))
    return kept.groupBy("gen", "key").agg(F.count_distinct("fp").alias("value"))


def limit_history(series: DataFrame, spec: StreamSpec) -> DataFrame:
    """gen, live, rejected, group_count of each generation."""
    told = admissions(first_seen(series, spec.group_by, spec.half_us), spec.group_limit)
    # An admitted group is live in its own generation and the next, a rejected one counts in its own: one pass over both.
    own, after = F.struct("gen", (~F.col("admitted")).alias("rejected")), F.struct((F.col("gen") + 1).alias("gen"), F.lit(False).alias("rejected"))
    each = told.select("key", "admitted", F.explode(F.array(own, after)).alias("at")).where(F.col("admitted") | F.col("at.rejected")).select("key", "admitted", "at.*")
    groups = each.groupBy("gen", "key").agg(F.max("admitted").alias("live"), F.max("rejected").alias("rejected"))
    sums = groups.groupBy("gen").agg(F.count_if("live").alias("live"), F.count_if("rejected").alias("rejected"))
    return sums.withColumn("group_count", F.col("live") + F.col("rejected"))
