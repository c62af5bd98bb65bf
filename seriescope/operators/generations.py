"""Half intervals on the grid from the Unix epoch."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def epoch_us(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def generation(ts: Column, half_us: int, shift: Column | int = 0) -> Column:
    """Number of the half interval on the grid from the Unix epoch; ``shift`` moves the grid (microseconds)."""
    return F.floor((epoch_us(ts) - shift) / F.lit(half_us)).cast("long")


def at_us(us: Column) -> Column:
    return F.timestamp_micros(us).cast("timestamp_ntz")
