"""Continuous estimates: hopping windows over a stream of series, and a cached view of the latest result."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.series import contributes, fingerprint, group_key
from ..plans.spec import StreamSpec


def hopping(series: DataFrame, spec: StreamSpec, late: str = "0 seconds") -> DataFrame:
    """window_start, window_end, key, value (approximate). ``series`` has labels and ts; batch or stream. Times are made
    zoned first, as watermarks need that."""
    labels = F.col("labels")
    rows = series.where(contributes(labels, spec.group_by)).select(F.col("ts").cast("timestamp").alias("ts"), group_key(labels, spec.group_by).alias("key"), fingerprint(labels).alias("fp"))
    if rows.isStreaming:
        rows = rows.withWatermark("ts", late)
    span = F.window("ts", f"{spec.interval_us} microseconds", f"{spec.half_us} microseconds")
    out = rows.groupBy(span.alias("w"), "key").agg(F.approx_count_distinct("fp", rsd=min(0.39, 1.04 / 2 ** (spec.hll_precision / 2))).alias("value"))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "key", "value")


def start(estimates: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update", once: bool = False) -> StreamingQuery:
    """Run a stream into ``sink(batch, epoch)``. A new checkpoint folder is a reset: nothing seen before counts."""
    writer = estimates.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(sink)
    return (writer.trigger(availableNow=True) if once else writer).start()


class CachedResult:
    """Rows of a result, computed anew when they are older than ``ttl`` seconds; 0 computes them always."""

    def __init__(self, make: Callable[[], DataFrame], ttl: float = 30.0, clock: Callable[[], float] = time.monotonic):
        self.make, self.ttl, self.clock, self.rows, self.at = make, ttl, clock, None, 0.0

    def get(self) -> list[Row]:
        if self.rows is None or self.ttl <= 0 or self.clock() - self.at >= self.ttl:
            self.rows, self.at = self.make().collect(), self.clock()
        return self.rows
